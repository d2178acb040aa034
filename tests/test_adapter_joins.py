"""Joins under the campaign and the study: what is exchanged for them, and their rows over odd tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from vintagekit import session as S
from vintagekit.operators import campaign as CP
from vintagekit.operators import features as FE
from vintagekit.plans import campaign as CA
from vintagekit.sources import buckets as B
from vintagekit.sources import testdata as TD
from vintagekit.sources.cache import stage_path


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def odd(spark, tmp_path):
    """Order 1 twice, order 3 without a customer, a line without a date, one without a key, a customer without orders."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = lambda m, d: dt.datetime(1998, m, d, 7, 30)
    put("customer", [(7, 1, 10.0, "BUILDING"), (8, 2, 20.0, "MACHINERY"), (9, 1, 0.0, "AUTO")],
        "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("orders", [(1, 7, t(1, 5)), (1, 7, t(1, 5)), (2, 7, t(1, 2)), (3, None, t(1, 2)), (4, 8, t(2, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    put("lineitem", [(1, 10, 1, 1, 2.0, 0.07, "R", "F", t(3, 9)), (2, 11, 2, 1, 50.0, 0.06, "N", "O", t(2, 20)), (2, 11, 2, 2, 42.0, 0.0, "A", "F", None),
                     (3, 11, 2, 1, 1.0, 0.0, "A", "F", t(1, 9)), (4, 12, 3, 1, None, None, None, None, None), (None, 12, 3, 1, 1.0, 0.0, "A", "F", t(1, 9))],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_application_tables_are_joined_where_they_lie(spark, no_broadcast):
    text = plan(CA.applications(spark, SF_CHECK))
    assert "Exchange hashpartitioning(APPLICATION_ID" not in text and text.count("Bucketed: true") == 3


def test_customers_meet_orders_before_line_items(spark, no_broadcast):
    text = plan(TD.application_rows(spark, SF_CHECK))
    assert 0 < text.index("SortMergeJoin [l_orderkey") < text.index("SortMergeJoin [o_custkey")


def test_open_dates_are_taken_per_order_first(spark, no_broadcast):
    text = plan(TD.account_month_fact(spark, SF_CHECK))
    assert "HashAggregate(keys=[l_orderkey" in text
    assert all("l_quantity" not in line for line in text.splitlines() if "SortMergeJoin" in line or "Exchange" in line)


def test_fact_over_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in TD.account_month_fact(spark, odd).select(
        "creditaccountid", "cardid", "opendate", "newaccountindicator", "activeaccountindicator", "chargeoffindicator", "dimbucketid",
        F.coalesce("esc", F.lit("-")), F.coalesce(F.col("reportingdate").cast("string"), F.lit("-"))).collect())
    opened = dt.date(1998, 2, 20)
    assert got == [(7, 11, opened, 0, 1, 1, 0, "Z", "1998-03-31"), (7, 11, opened, 0, 1, 1, 0, "Z", "1998-03-31"),
                   (7, 21, opened, 1, 0, 0, 60, " ", "1998-02-28"), (7, 22, opened, 0, 1, 0, 30, "-", "-"),
                   (8, 41, None, 0, 1, 0, 0, "-", "-")]


def test_laid_out_applications_keep_every_row(spark, odd):
    build = lambda: TD.application_rows(spark, odd)
    laid = B.bucketed(spark, stage_path(spark, "odd-applications", odd), build, ["APPLICATION_ID"], 8)
    codes = spark.createDataFrame([(dt.date(1998, 1, 1), "P001001"), (dt.date(1998, 2, 1), "P002002")], "campaign_month date, OFFER_CODE_FIRST_7 string")
    got, want = (CP.applications(TD.applications(r), TD.applicants(r), TD.application_status(r), codes) for r in (laid, build()))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    rows = sorted((r.APPLICATION_ID, r.RESERVATION_NUMBER, r.AppRcvDate, r.BoardDate) for r in got.collect())
    assert rows == [*[("1-1-10-1", "P001001000000001", dt.date(1998, 3, 9), dt.date(1998, 3, 9))] * 8,  # a repeated order: 2 x 2 x 2
                    ("2-1-11-2", "P001001000000002", dt.date(1998, 2, 20), None)]


def test_a_task_of_a_scan_reads_at_most_16_mb(spark):
    assert S.TASK_BYTES <= 16 << 20


def test_indicators_travel_as_one_number(spark, no_broadcast):
    lines = plan(TD.account_month_fact(spark, SF_CHECK)).splitlines()
    last_join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert all(f"AS {c}" not in line for line in lines[last_join:] for c in ("activeaccountindicator", "chargeoffindicator", "dimbucketid", "esc"))


def test_indicators_of_every_kind_of_line(spark, odd, tmp_path):
    kinds = [(f, s, q, t) for f in ("N", "R", "A", None) for s in ("O", "F", None) for q in (1.0, 3.0, 4.0, 41.0, 46.0, None) for t in (0.0, 0.06, 0.07, None)]
    rows = [(2, 11, 2, i, q, t, f, s, dt.datetime(1998, 2, 20)) for i, (f, s, q, t) in enumerate(kinds)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.cardid - 20: tuple(r)[1:] for r in TD.account_month_fact(spark, odd).select(
        "cardid", "activeaccountindicator", "chargeoffindicator", "dimbucketid", "esc").collect()}
    assert got == {i: (0 if (f, s) == ("N", "O") else 1, 1 if (f, s) == ("R", "F") and q is not None and q <= 3 else 0,
                       0 if q is None or q < 41 else 60 if q >= 46 else 30, None if t is None or t < 0.06 else "Z" if t >= 0.07 else " ")
                   for i, (f, s, q, t) in enumerate(kinds)}


def test_attributes_are_exchanged_before_they_are_made(spark, no_broadcast):
    mail = spark.createDataFrame([("7",), ("8",), (None,)], "ENCRYPTED_PIN string")
    text = plan(FE.append_attributes(mail, TD.bureau_attributes(spark, SF_CHECK), "TRM_BUREAU_A%"))
    assert "Exchange hashpartitioning(EPIN#" not in text and text.count("Exchange hashpartitioning(") == 4  # the sums lie by the join's key
    assert "l_returnflag" not in text.split("SortMergeJoin [l_orderkey")[0]


def test_attributes_over_odd_rows(spark, odd, tmp_path):
    lines = [(1, 2.0, 10.9, "R", "O"), (1, 3.0, 20.9, "R", "F"), (2, 4.0, 30.9, "N", "O"), (3, 5.0, 1.0, "R", "O"), (4, None, None, None, None), (9, 1.0, 1.0, "R", "O")]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.mode(
        "overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.EPIN: tuple(r)[1:] for r in TD.bureau_attributes(spark, odd).select("EPIN", "FileName", "ALL2350", "IQB9416", "IQT9410", "ALL7120", "BCC5421").collect()}
    # order 1 stands twice: lines n, quantity q, price px, returned nr, open no
    assert got == {"7": ("TRM_BUREAU_A", 4.0, 1.0, (5 + 3) % 11 * 1.0, 14.0, 90.0),  # n 5, q 14, px 90, nr 4, no 3
                   "8": ("TRM_BUREAU_A", 0.0, 1.0, 1.0, None, None),
                   None: ("TRM_BUREAU_A", 1.0, 1.0, 2.0, 5.0, 1.0)}


def test_applications_lie_by_order(spark, no_broadcast):
    """Joined there, and a reservation's applications meet before they are exchanged."""
    text = plan(CA.applications(spark, SF_CHECK))
    assert "Exchange hashpartitioning(l_orderkey" not in text and "Exchange hashpartitioning(APPLICATION_ID" not in text
    assert text.count("SortMergeJoin [APPLICATION_ID") == 2 and text.count("Bucketed: true") == 3
    CA.staged_response(spark, SF_CHECK)
    assert spark.conf.get(S.ALL_KEYS) == "true"  # for these joins only
    built = plan(TD.application_rows(spark, SF_CHECK, 8))
    assert built.count("Exchange hashpartitioning(l_orderkey") == 1 and "REPARTITION_BY_NUM" in built


def test_applications_by_order_keep_every_row(spark, odd):
    laid = B.bucketed(spark, stage_path(spark, "odd-by-order", odd), lambda: TD.application_rows(spark, odd, 8), ["l_orderkey"], 8, placed=True)
    rows = TD.application_rows(spark, odd)
    assert laid.columns == rows.columns and laid.exceptAll(rows).isEmpty() and rows.exceptAll(laid).isEmpty()
    files = [r.f for r in laid.select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) == len({f.rsplit("_", 1)[1] for f in files})  # a bucket is one file
    codes = spark.createDataFrame([(dt.date(1998, 1, 1), "P001001"), (dt.date(1998, 2, 1), "P002002")], "campaign_month date, OFFER_CODE_FIRST_7 string")
    parts = (TD.applications, TD.applicants, TD.application_status)
    got = CP.applications(*[t(laid, TD.APPLICATION_KEY) for t in parts], codes, TD.APPLICATION_KEY)
    want = CP.applications(*[t(rows) for t in parts], codes)
    assert got.columns == want.columns and want.count() > 8 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
