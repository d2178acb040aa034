"""Columnar payload and the rules of the staged copies."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from vintagekit.config import StudyConfig
from vintagekit.operators import payload as PL
from vintagekit.sources import cache as CA

READS = StudyConfig().reads


def payload(spark, n=500):
    rows = [(f"d{i % 7 // 5}", "P", "x", 10_000 - i, f"2025-{i % 4 + 1:02d}", 400 + i % 99, None if i % 9 == 0 else 5.5 * i, "p" * (i % 3), "web", *([i % 2, i % 5 % 2] * len(READS)))
            for i in range(n)]
    flags = ", ".join(f"{p}_{r.key} int" for r in READS for p in ("e", "b"))
    return spark.createDataFrame(rows, f"dataset_id string, prism string, population string, creditaccountid long, board_month string, score int, cl double, program string, channel string, {flags}")


@pytest.mark.parametrize("chunk", [1, 64, 100_000])
def test_chunks_are_bounded_ordered_and_whole(spark, chunk):
    df = payload(spark)
    chunks, meta = PL.columnar_payload(df, READS, chunk, ranges=5)
    got = PL.unpack_payload(chunks, meta, READS)
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))
    rows = chunks.orderBy("dataset_id", "chunk").collect()
    for d in {r.dataset_id for r in rows}:
        own = [r for r in rows if r.dataset_id == d]
        accounts = [a for r in own for a in r.creditaccountid]
        assert accounts == sorted(accounts) and all(len(r.score) <= chunk for r in own) and all(len(r.score) == chunk for r in own[:-1])
    m = {r.dataset_id: r for r in meta.collect()}
    assert sum(r.n for r in m.values()) == 500 and m["d0"].months == ["2025-01", "2025-02", "2025-03", "2025-04"] and m["d0"].programs == ["", "p", "pp"]
    assert sum(r.chunks for r in m.values()) == len(rows)


def test_empty_payload(spark):
    chunks, meta = PL.columnar_payload(payload(spark).limit(0), READS)
    assert chunks.count() == meta.count() == 0


def test_two_builders_leave_one_whole_copy(spark, tmp_path):
    path, gate, out = str(tmp_path / "stage" / "copy"), threading.Barrier(2), []

    def build():
        gate.wait(30)  # both have found no copy
        return spark.range(100).withColumn("v", F.rand())

    def run():
        out.append(CA.cache_or_compute(spark, path, build, ["v"]).agg(F.count("v"), F.sum("v")).first())

    both = [threading.Thread(target=run) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert len(out) == 2 and out[0] == out[1] and out[0][0] == 100
    assert sorted(os.listdir(tmp_path / "stage")) == ["copy"]


def test_copies_follow_their_source(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    first = CA.source_path(spark, "x", [source], "a")
    assert first == CA.source_path(spark, "x", [source], "a") != CA.source_path(spark, "x", [source], "b")
    spark.range(3).write.mode("append").parquet(source)
    assert CA.source_path(spark, "x", [source], "a") != first
    assert CA.fingerprint(spark, [str(tmp_path / "nothing")]) != CA.fingerprint(spark, [source])


def test_incomplete_and_empty_copies_are_built_again(spark, tmp_path):
    path, builds = str(tmp_path / "copy"), []

    def build():
        builds.append(1)
        return spark.range(5)

    def rows(**kw):
        return CA.cache_or_compute(spark, path, build, ["id"], **kw).count()

    assert rows() == rows() == 5 and len(builds) == 1
    os.remove(f"{path}/_SUCCESS")
    assert rows() == 5 and len(builds) == 2
    spark.range(0).write.mode("overwrite").parquet(path)
    assert rows() == 0 and rows(allow_empty=False) == 5 and len(builds) == 3
    assert rows(refresh=True) == 5 and len(builds) == 4


def test_account_frame_is_one_aggregation(spark):
    """Null keys keep their row without flags; a base row needs the first read and a valid score."""
    cfg = StudyConfig()
    one, two = cfg.reads[:2]
    rows = [("a", 1, one.key, dt.date(1998, 1, 31), 700, 1, 1), ("a", 1, two.key, dt.date(1998, 1, 31), 700, None, 1), ("a", 1, one.key, dt.date(1997, 1, 31), 650, 0, 0),
            ("a", 2, one.key, dt.date(1998, 1, 31), 100, 1, 1), ("a", 3, two.key, dt.date(1998, 1, 31), 700, 1, 1), ("a", 4, one.key, None, 900, 1, None),
            ("a", None, one.key, dt.date(1998, 1, 31), 700, 1, 1), (None, 5, one.key, dt.date(1998, 1, 31), 700, 1, 1), ("a", 6, None, None, 700, 1, 1),
            ("a", 7, one.key, dt.date(1998, 1, 31), None, 1, 1)]
    long = spark.createDataFrame(rows, "population string, creditaccountid long, read_key string, board_month date, bhvr_score int, metric_eligible int, target int").selectExpr(
        "*", "'P' as program_code", "cast(null as string) as channel", "cast(1000 as double) as creditline")
    out = PL.account_frame(long, (one, two), "board_month", cfg, keys=["population"])
    got = {tuple(r) for r in out.collect()}
    none = (0, 0)
    assert got == {("a", 1, "1997-01", 650, 1000.0, "P", "", 1, 1, 0, 1), ("a", 4, None, 900, 1000.0, "P", "", 1, 0, *none),
                   ("a", None, "1998-01", 700, 1000.0, "P", "", *none, *none), (None, 5, "1998-01", 700, 1000.0, "P", "", *none, *none)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
