"""One-pass populations: plan shape, hand-made edges and invariants."""

import datetime as dt
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from vintagekit.config import StudyConfig
from vintagekit.operators import population as P
from vintagekit.operators import rank as R
from vintagekit.plans import studio

CFG = StudyConfig(snapshot_month=dt.date(2025, 1, 1))
FACT = ("creditaccountid long, cardid long, card_part long, card_supp long, reportingdate date, opendate date, monthsonbooks int, "
        "newaccountindicator int, activeaccountindicator int, chargeoffindicator int, dimbucketid int, dimstatusreasonid int, "
        "bhvr_score int, esc string, scorecard string, reservationnumber string, dimproductofferedid long, creditline double, vantage3 int")


def row(acct, month, mob, **kw):
    base = dict(creditaccountid=acct, cardid=1, card_part=1, card_supp=1, reportingdate=dt.date(2025, month, 28 if month == 2 else 31 if month in (1, 3, 5, 7) else 30),
                opendate=dt.date(2025, 1, 5), monthsonbooks=mob, newaccountindicator=int(mob == 0), activeaccountindicator=1, chargeoffindicator=0,
                dimbucketid=0, dimstatusreasonid=1, bhvr_score=600, esc=None, scorecard="S", reservationnumber="AUTO000001", dimproductofferedid=1,
                creditline=9000.0, vantage3=750)
    return tuple((base | kw)[c.split()[0]] for c in FACT.split(", "))


def fact(spark, rows):
    return spark.createDataFrame(rows, FACT)


def cohort(spark, rows, **kw):
    out = P.cohort_bulk(fact(spark, rows), replace(CFG, **kw), dt.date(2025, 1, 1), dt.date(2025, 7, 1))
    return {(r.creditaccountid, r.read_key): r for r in out.collect()}


def test_best_rows_and_performance(spark):
    rows = [row(1, 1, 0, cardid=5, bhvr_score=None), row(1, 1, 0, cardid=9, bhvr_score=500), row(1, 2, 1, bhvr_score=700, esc="Z"),
            row(1, 3, 2, bhvr_score=650, esc=" "), row(1, 4, 3, bhvr_score=1000), row(1, 5, 4, dimbucketid=30, bhvr_score=None)]
    got = cohort(spark, rows)
    r = got[(1, "b30_w4")]
    assert r.board_cardid == 9                                   # largest card of the first board month
    assert (r.bhvr_score, r.score_mob) == (650, 2)               # valid, blank status, latest
    assert (r.target, r.metric_eligible, r.max_mob_observed) == (1, 1, 4)
    late = got[(1, "b60_w6")]
    assert (late.target, late.metric_eligible) == (0, 0)         # horizon 6 not seen


def test_charge_off_modes_and_exclusion(spark):
    rows = [row(1, 1, 0), row(1, 3, 2, chargeoffindicator=1, activeaccountindicator=0, dimstatusreasonid=None),
            row(2, 1, 0), row(2, 2, 1, dimstatusreasonid=52), row(3, 1, 0, reservationnumber=None), row(4, 1, 0, creditline=5000.0),
            row(5, 1, 0, cardid=None), row(6, 1, 0, activeaccountindicator=0)]
    got = cohort(spark, rows)
    assert {a for a, _ in got} == {1, 6}                         # 2 excluded, 3 no program, 4 other line, 5 no card
    assert got[(1, "b30_w4")].metric_eligible == 1 and got[(1, "b30_w4")].contractual_chargeoff == 0
    assert got[(6, "b30_w4")].target is None and got[(6, "b30_w4")].metric_eligible == 0
    out = P.cohort_bulk(fact(spark, rows), CFG, dt.date(2025, 1, 1), dt.date(2025, 7, 1), mode="point_in_time").collect()
    assert {(r.creditaccountid, r.read_key, r.target) for r in out if r.creditaccountid == 1} == {(1, "b30_w4", 1), (1, "b60_w6", 1)}
    kept = P.cohort_bulk(fact(spark, rows), CFG, dt.date(2025, 1, 1), dt.date(2025, 7, 1), exclude=False).select("creditaccountid").distinct().count()
    assert kept == 3


def test_closest_score_and_its_filter(spark):
    rows = [row(1, 1, 0, bhvr_score=None), row(1, 3, 2, bhvr_score=500, cardid=1), row(1, 3, 2, bhvr_score=510, cardid=2), row(1, 4, 3, bhvr_score=700),
            row(2, 1, 0, bhvr_score=None), row(2, 4, 3, bhvr_score=None), row(3, 1, 0)]
    out = {(r.creditaccountid, r.read_key): r for r in P.portfolio_closest_score(fact(spark, rows), CFG).collect()}
    assert set(out) == {(1, "b30_w4")}                           # 2 has no valid score, 3 and the long read are not eligible
    assert (out[(1, "b30_w4")].bhvr_score, out[(1, "b30_w4")].days_from_snapshot) == (510, 59)


def test_subject_and_benchmark_come_from_one_pass(spark):
    rows = [row(1, 1, 0), row(2, 1, 0, reservationnumber="ZZZZ1"), row(3, 1, 0, reservationnumber=None), row(4, 1, 0, reservationnumber="ZZZZ1", vantage3=700),
            row(5, 1, 0, reservationnumber="ZZZZ1", esc="Z")]
    got = P.snapshot_pass(fact(spark, rows), CFG, benchmark=True, exclude_from=dt.date(2023, 1, 1)).collect()
    assert {(r.creditaccountid, r.population) for r in got} == {(1, "subject"), (2, "benchmark"), (3, "benchmark")}


def shape(df):
    """(scans, exchanges on the account) of the physical plan, counting what is not reused."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan parquet"), len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(creditaccountid", text))


def test_cohort_is_one_scan_and_one_exchange(spark):
    s = studio.inputs(spark, SF_CHECK)
    plain = P.cohort_bulk(s.fact, s.cfg, s.window_start, s.window_end)
    assert shape(plain) == (1, 1)
    rows = P.snapshot_pass(s.fact, s.cfg, benchmark=True, exclude_from=s.exclude_from)
    assert shape(rows) == (1, 1)


def test_deciles_do_not_sort_accounts_in_one_partition(spark):
    s = studio.inputs(spark, SF_CHECK)
    text = R.tie_aware_deciles(s.cohort_pairs(), ["read_key"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text


def test_invariants(spark):
    s = studio.inputs(spark, SF_CHECK, studio.WIDE)
    cohort = s.cohort()
    pairs = R.eligible_pairs(cohort, s.cfg)
    assert cohort.groupBy("creditaccountid", "read_key").count().filter("count > 1").count() == 0   # boards are unique per account
    dec = R.tie_aware_deciles(pairs, ["read_key"])
    n = {r.read_key: r.n for r in dec.groupBy("read_key").agg(F.sum("n").alias("n")).collect()}
    assert n == {r.read_key: r["count"] for r in pairs.groupBy("read_key").count().collect()}        # decile n sums to eligible
    for r in dec.groupBy("read_key").agg(F.max("cum_bad_share").alias("s")).collect():
        assert r.s == pytest.approx(1.0)                                                             # cumulative share ends at 1
    d = sorted(dec.filter("read_key = 'b30_w4'").collect(), key=lambda r: r.decile)
    assert all(a.score_max < b.score_min for a, b in zip(d, d[1:]))                                  # no score in two deciles
    ids = P.tier_accounts(s.fact, studio.CFG)
    some = P.restrict_accounts(s.fact, ids).count() + P.exclude_accounts(s.fact, ids).count()
    assert some == s.fact.count()                                                                    # semi and anti partition


def test_detected_month_is_the_default_and_a_given_one_wins(spark):
    assert studio.CFG.snapshot_month is None
    assert studio.inputs(spark, SF_CHECK).cfg.snapshot_month == dt.date(2001, 6, 1)
    assert studio.inputs(spark, SF_CHECK, studio.GIVEN).cfg.snapshot_month == studio.GIVEN_MONTH


@pytest.mark.parametrize("low, high, n, want", [(0.4, 0.1, 300, "good"), (0.2, 0.2, 300, "bad"), (0.4, 0.1, 50, "warn"), (0.34, 0.17, 300, "warn")])
def test_all_verdicts(spark, low, high, n, want):
    """Bad rate falls in a straight line from the lowest to the highest score."""
    rows = [("r", 400 + i % 10, int((i // 10) * 10 % n < n * (low + (high - low) * (i % 10) / 9))) for i in range(n)]
    df = spark.createDataFrame(rows, "read_key string, bhvr_score int, bad int")
    assert R.verdict(df, []).first().verdict == want


def test_overlay_falls_back_to_the_first_read_with_subjects(spark):
    rows = [("subject", "b", 500, 1), ("other", "a", 500, 1), ("other", "b", 600, 0)]
    df = spark.createDataFrame(rows, "population string, read_key string, bhvr_score int, bad int")
    got = R.overlay_series(df, "c", ["a", "b"], "subject").collect()
    assert {(r.population, r.read_key) for r in got} == {("subject", "b"), ("other", "b")}
    assert {r.read_key for r in R.overlay_series(df, "b", ["a", "b"], "subject").collect()} == {"b"}


def test_first_row_equals_a_window(spark):
    from pyspark.sql import Window

    from vintagekit.functions.rows import first_row
    df = spark.createDataFrame([(k, a, b, f"r{i}") for i, (k, a, b) in enumerate([(1, 2, None), (1, 2, 5), (1, None, 9), (2, 3, 1), (2, 3, 0), (None, 1, 1)])],
                               "k int, a int, b int, v string")
    w = Window.partitionBy("k").orderBy("a", "b")
    want = df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    got = first_row(df, ["k"], [F.col("a"), F.col("b")])
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bitmap_counts_are_exact_and_merge(spark):
    from vintagekit.operators import distinct as DI
    df = spark.range(200_000).selectExpr("id % 3 as k", "(id * 7) % 90001 as account", "id % 5 = 0 as five").unionByName(
        spark.createDataFrame([(9, 1, False)], "k long, account long, five boolean"))
    maps = DI.id_bitmaps(df, ["k"], "account", {"all": F.lit(True), "five": F.col("five")})
    got = {r.k: (r["all"], r.five) for r in DI.distinct_counts(maps, ["k"], ["all", "five"]).collect()}
    want = {r.k: (r.a, r.f) for r in df.groupBy("k").agg(F.countDistinct("account").alias("a"), F.countDistinct(F.when(F.col("five"), F.col("account"))).alias("f")).collect()}
    assert got == want
    assert DI.union_counts(maps, ["all"]).first()[0] == df.select("account").distinct().count()
    assert DI.union_counts(maps.where("k = 77"), ["all"]).first()[0] == 0


def test_activation_is_one_scan_and_one_account_exchange(spark):
    s = studio.inputs(spark, SF_CHECK)
    plan = studio._activation(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning(creditaccountid") == 1 and "Window" not in plan
    for name in ("score_availability", "board_reconciliation"):
        assert "Expand" not in getattr(studio, name)(spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
