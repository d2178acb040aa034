"""As-of join against brute force."""

import datetime as dt
import random

import pytest

from vintagekit.operators.asof import asof_join

DAY = dt.date(2024, 1, 1)


def tables(spark, n=300):
    rnd = random.Random(11)

    def key():
        return None if rnd.random() < 0.05 else 0 if rnd.random() < 0.5 else rnd.randrange(12)  # 0 is hot

    def day(span):
        return None if rnd.random() < 0.05 else DAY + dt.timedelta(days=rnd.randrange(span))

    left = [(i, key(), day(900)) for i in range(n)] + [(n, 99, DAY), (0, 0, DAY)]
    right = [(key(), day(700), rnd.randrange(3), i) for i in range(n)] + [(7, DAY, 1, 1000), (7, DAY, 1, 1000)]
    return (spark.createDataFrame(left, "id int, k int, at date"), spark.createDataFrame(right, "k int, seen date, rank int, score int"), left, right)


def brute(left, right, direction, tolerance, prefer):
    out = []
    for i, k, at in left:
        best = None
        for rk, seen, rank, score in right:
            if None in (k, at, rk, seen) or k != rk:
                continue
            gap = (seen - at).days
            if (direction == "backward" and gap > 0) or (direction == "forward" and gap < 0) or (tolerance is not None and abs(gap) > tolerance):
                continue
            other = (gap > 0) == (prefer == "backward") and gap != 0
            mine = (abs(gap), other, -rank, -score)
            if best is None or mine < best[0]:
                best = mine, score, gap
        out.append((i, k, at, *(best[1:] if best else (None, None))))
    return sorted(map(str, out))


@pytest.mark.parametrize("direction, tolerance, prefer", [
    ("backward", None, "backward"), ("forward", None, "backward"), ("nearest", None, "backward"), ("nearest", None, "forward"),
    ("backward", 5, "backward"), ("forward", 0, "backward"), ("nearest", 3, "forward")])
@pytest.mark.parametrize("width", [10, 366, 100000])
def test_against_brute_force(spark, direction, tolerance, prefer, width):
    a, b, left, right = tables(spark)
    got = asof_join(a, b, ["k"], "at", "seen", ["score"], direction, tolerance, ["rank", "score"], width, prefer)
    assert got.columns == ["id", "k", "at", "score", "gap"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(left, right, direction, tolerance, prefer)


def test_timestamps_and_numbers(spark):
    t = dt.datetime(2024, 1, 1, 12)
    a = spark.createDataFrame([(1, t, 10.0)], "k int, t timestamp, x double")
    b = spark.createDataFrame([(1, t - dt.timedelta(seconds=2), 9.5, "r")], "k int, u timestamp, y double, v string")
    assert asof_join(a, b, ["k"], "t", "u", ["v"], width=3.6e9).first()[3:] == ("r", -2_000_000)
    assert asof_join(a, b, ["k"], "x", "y", ["v"], width=1.0).first()[3:] == ("r", -0.5)


def test_empty_sides_and_names(spark):
    a, b, left, _ = tables(spark)
    none = asof_join(a, b.limit(0), ["k"], "at", "seen", ["score"])
    assert none.count() == len(left) and none.where("score is not null").count() == 0
    assert asof_join(a.limit(0), b, ["k"], "at", "seen", ["score"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(a, b.withColumnRenamed("score", "id"), ["k"], "at", "seen", ["id"])
    with pytest.raises(ValueError, match="direction"):
        asof_join(a, b, ["k"], "at", "seen", ["score"], "sideways")


def test_no_task_orders_a_whole_key(spark):
    a, b, _, _ = tables(spark)
    plan = asof_join(a, b, ["k"], "at", "seen", ["score"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition" in line and "_t#" in line.split("windowspecdefinition")[1]:
            assert "_slice#" in line.split("windowspecdefinition")[1]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_left_rows_of_one_time_are_looked_up_once(spark, direction):
    left = spark.range(500).selectExpr("cast(id as int) as id", "0 as k", "date_add(date'2024-01-01', cast(id % 5 as int)) as at")
    right = spark.createDataFrame([(0, DAY + dt.timedelta(days=2), 7)], "k int, seen date, score int")
    out = asof_join(left, right, ["k"], "at", "seen", ["score"], direction)
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("_l#" in line for line in windows)
    rows = out.collect()
    found = {"backward": {2, 3, 4}, "forward": {0, 1, 2}, "nearest": set(range(5))}[direction]
    assert len(rows) == 500 and all((r["score"] == 7) == (r["id"] % 5 in found) for r in rows)
