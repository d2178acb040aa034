"""The stored counts by month equal a recompute from the accounts."""

import random

import pytest
from pyspark.sql import functions as F

from vintagekit.operators import cube as CU
from vintagekit.operators import rank as R


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(2)
    rows = [(f"2025-{rnd.randint(1, 5):02d}-01", rnd.choice(["a", "b"]), i, rnd.randint(400, 460), int(rnd.random() < 0.3), rnd.choice([None, 1000.0, 2500.5]))
            for i in range(900)]
    return spark.createDataFrame(rows, "day string, read_key string, account int, bhvr_score int, bad int, creditline double").withColumn(
        "vintage", F.to_date("day"))


def rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("months", [[], ["2025-02"], ["2025-05", "2025-01", "2031-01"], ["2031-01"]])
def test_selections_equal_a_recompute(spark, pairs, tmp_path, months):
    path = str(tmp_path / "cube")
    for part in (F.month("vintage") <= 2, F.month("vintage") > 2):
        CU.write_months(CU.month_cube(pairs.where(part), ["read_key"], F.col("vintage")), path)
    assert CU.stored_months(spark, path) == [f"2025-{m:02d}" for m in range(1, 6)]
    own = pairs.where(F.date_format("vintage", "yyyy-MM").isin(months)) if months else pairs
    state = CU.select_months(spark, path, months)
    for groups in (["read_key"], []):
        want = R.tie_aware_deciles(own, groups)
        assert rows(CU.deciles(state, groups)) == rows(want)
        assert rows(R.gains_curve(CU.deciles(state, groups), groups)) == rows(R.gains_curve(want, groups))
    stats = R.population_stats(own, ["read_key"])
    assert rows(CU.kpis(state, ["read_key"]).drop("d1_d10_lift", "lift_label")) == rows(stats)
    full = R.month_stats(own.withColumn(CU.MONTH, F.date_format("vintage", "yyyy-MM")), CU.MONTH, ["read_key"])
    assert rows(CU.month_stats(state, ["read_key"])) == rows(full)


def test_cubes_of_separate_accounts_merge(spark, pairs):
    half = F.col("account") % 2
    a, b, whole = (CU.month_cube(p, ["read_key"], F.col("vintage")) for p in (pairs.where(half == 0), pairs.where(half == 1), pairs))
    assert rows(CU.merge_cubes(a, b)) == rows(whole)


def test_no_months_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        CU.select_months(spark, str(tmp_path / "none"))
