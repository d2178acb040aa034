import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from vintagekit.operators import population as P
from vintagekit.plans import layouts as L
from vintagekit.sources import buckets as B
from vintagekit.sources.cache import fingerprint, stage_path


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_account_joins_exchange_nothing(spark, no_broadcast):
    for query in (L.exclude_accounts, L.restrict_fact):
        text = plan(query(spark, SF_CHECK))
        assert "Exchange" not in text and "SortMergeJoin" in text
    text = plan(L.board_rows(spark, SF_CHECK))
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(vintage" in text  # partial counts only


def test_month_end_join_exchanges_nothing(spark, no_broadcast):
    l = L.layouts(spark, SF_CHECK)
    text = plan(P.dim_enrich(l.fact_by_card(), l.s.products.limit(0), l.month_end()))
    assert "Exchange hashpartitioning(cardid" not in text and text.count("Bucketed: true") == 2


def test_same_rows_as_the_plain_joins(spark):
    l = L.layouts(spark, SF_CHECK)
    for got, want in ((L.exclude_accounts(spark, SF_CHECK), P.exclude_accounts(l.s.fact, l.s.excluded)),
                      (L.restrict_fact(spark, SF_CHECK), P.restrict_accounts(l.s.fact, P.tier_accounts(l.s.fact, l.s.cfg)))):
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_hot_account_lies_in_several_buckets(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 1, id) as creditaccountid", "add_months(date'1999-01-31', cast(id % 24 as int)) as reportingdate")
    rows = rows.unionByName(spark.createDataFrame([(None, None), (1, None)], "creditaccountid long, reportingdate date"))
    path = stage_path(spark, "hot", SF_CHECK, "test")
    t = B.bucketed(spark, path, lambda: B.by_account_slice(rows), [P.ACCT, B.SLICE], 16)
    assert t.where("creditaccountid = 1").select(F.input_file_name()).distinct().count() > 2
    sets = B.in_every_slice(spark.createDataFrame([(1,), (7,)], "creditaccountid long"))
    key = [P.ACCT, B.SLICE]
    assert P.restrict_accounts(t, sets, key).count() == rows.where("creditaccountid in (1, 7)").count()
    assert P.exclude_accounts(t, sets, key).count() == rows.where("creditaccountid is null or creditaccountid not in (1, 7)").count()


def test_a_layout_is_found_again_by_a_later_session(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "found_a long, found_b string")
    path = stage_path(spark, "again", SF_CHECK, "test")
    first = B.bucketed(spark, path, lambda: rows, ["found_a"], 4)
    before = fingerprint(spark, [f"{path}-4"])
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("layout_") and spark.table(t.name).columns == rows.columns)
    spark.sql(f"DROP TABLE {name}")
    again = B.bucketed(spark, path, lambda: rows, ["found_a"], 4)
    assert fingerprint(spark, [f"{path}-4"]) == before and again.schema == first.schema
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_an_empty_set_excludes_none(spark):
    l = L.layouts(spark, SF_CHECK)
    none = B.bucketed(spark, stage_path(spark, "empty", SF_CHECK, "test"),
                      lambda: B.in_every_slice(spark.createDataFrame([], "creditaccountid long")), L.ACCOUNT_SLICE, l.buckets)
    assert none.isEmpty()
    assert P.exclude_accounts(l.fact_by_account(), none, L.ACCOUNT_SLICE).count() == l.s.fact.count()
    assert P.restrict_accounts(l.fact_by_account(), none, L.ACCOUNT_SLICE).isEmpty()


def test_bucket_count_follows_the_bytes(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 5000)
    assert B.bucket_count(spark, str(tmp_path), 100) == 64
    assert B.bucket_count(spark, str(tmp_path)) == 8 == B.bucket_count(spark, str(tmp_path / "none"))
