"""Adapters from the driver's TPC-H-style parquet tables to the domain shapes.

Adapters are the only code that knows the test tables. Each returns lazy
DataFrames; nothing is collected.

* Adapter A - account-month fact (one row per card per month end) + dimensions.
* Adapter C - campaign mail file, applications, applicants, statuses, fee lookup,
  bureau attributes.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.functions.dates import month_diff
from vintagekit.operators.features import ATTRIBUTES


def source_files(sf_dir: str) -> list[str]:
    """The tables that the adapters read."""
    return [f"{sf_dir}/{t}.parquet" for t in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ----------------------------------------------------------------------------
# Adapter A: account-month fact
# ----------------------------------------------------------------------------

def account_month_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-month fact: account = customer, card row = line item, month end of ship date.

    The open date is the account's first ship date: each order's first, then each account's, joined back, so no account's
    rows are held together and only one row an order is exchanged for it. Indicators are derived before the joins and
    travel as one small number: they are exchanged instead of what they are made of.
    """
    q = F.col("l_quantity")
    active = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), 0).otherwise(1)
    chargeoff = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (q <= 3), 1).otherwise(0)
    bucket = F.when(q >= 46, 2).when(q >= 41, 1).otherwise(0)
    esc = F.when(F.col("l_tax") >= 0.07, 2).when(F.col("l_tax") >= 0.06, 1).otherwise(0)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("shipdate"),
        (active + chargeoff * 2 + bucket * 4 + esc * 16).cast("int").alias("marks"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    rows = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    rows = rows.select(
        F.col("o_custkey").alias("creditaccountid"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cardid"),
        F.col("l_partkey").alias("card_part"),
        F.col("l_suppkey").alias("card_supp"),
        F.last_day("shipdate").alias("reportingdate"),
        "marks",
    )
    first = li.groupBy("l_orderkey").agg(F.min("shipdate").alias("first_ship"))
    opened = (first.join(orders, first.l_orderkey == orders.o_orderkey, "inner").groupBy("o_custkey")
              .agg(F.min("first_ship").alias("opendate")))
    cust = cust.join(opened, cust.c_custkey == opened.o_custkey, "inner").drop("o_custkey")
    rows = rows.join(cust, rows.creditaccountid == cust.c_custkey, "inner")

    def mark(shift: int, mask: int) -> Column:
        return F.shiftright("marks", shift).bitwiseAND(F.lit(mask))

    score = F.when(((F.col("card_part") + F.col("card_supp")) % 20) == 0, F.lit(None)).otherwise(
        350 + (F.col("card_part") * 7 + F.col("card_supp") * 13) % 600)
    return rows.select(
        "creditaccountid",
        "cardid",
        "card_part",
        "card_supp",
        "reportingdate",
        "opendate",
        month_diff("reportingdate", "opendate").cast("int").alias("monthsonbooks"),
        F.when(F.col("reportingdate") == F.last_day("opendate"), 1).otherwise(0).cast("int")
        .alias("newaccountindicator"),
        mark(0, 1).alias("activeaccountindicator"),
        mark(1, 1).alias("chargeoffindicator"),
        (mark(2, 3) * 30).cast("int").alias("dimbucketid"),
        ((F.col("card_part") * 3 + F.col("card_supp") * 11) % 2000).cast("int").alias("dimstatusreasonid"),
        score.cast("int").alias("bhvr_score"),
        F.when(mark(4, 3) == 2, F.lit("Z")).when(mark(4, 3) == 1, F.lit(" ")).alias("esc"),
        F.concat(F.lit("BS"), (F.col("card_supp") % 3 + 1).cast("string")).alias("scorecard"),
        F.concat(F.upper(F.substring("c_mktsegment", 1, 4)),
                 F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("reservationnumber"),
        F.col("c_nationkey").alias("dimproductofferedid"),
        (1000 + (F.col("c_custkey") % 5) * 2000).cast("double").alias("creditline"),
        (500 + F.floor((F.col("c_acctbal") + 1000) * 0.03)).cast("int").alias("vantage3"),
    )


def product_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dimproductoffered: nation key -> channel (region name). 25 rows by definition."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("dimproductofferedid"), F.col("r_name").alias("channel"))


def month_end_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second monthly fact keyed by (cardid, reportingdate): scorecard identifier."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cardid"),
                      F.last_day(F.to_date("l_shipdate")).alias("reportingdate"),
                      F.col("l_suppkey"))
            .groupBy("cardid", "reportingdate")
            .agg(F.concat(F.lit("SC"), (F.min("l_suppkey") % 4).cast("string"))
                 .alias("behaviorscorecardidentifier")))


# ----------------------------------------------------------------------------
# Adapter C: campaign tables
# ----------------------------------------------------------------------------

def _offer_code(nation: str, month: Column):
    return F.concat(F.lit("P"), F.lpad(F.col(nation).cast("string"), 3, "0"),
                    F.lpad(month.cast("string"), 3, "0"))


def _score_text(expr):
    """Exact decimal text for k/20000 (k in 0..999) - char-typed score like the mail file."""
    return F.concat(F.lit("0."), F.lpad((expr * 5).cast("string"), 5, "0"))


def mail_file_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail file with char-typed scores: one row per open/pending order."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "F")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    m = o.join(c, o.o_custkey == c.c_custkey, "inner")
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    vantage = (500 + F.floor((F.col("c_acctbal") + 1000) * 0.03)).cast("bigint").cast("string")
    offer7 = _offer_code("c_nationkey", F.month("o_orderdate"))
    return m.select(
        offer7.alias("CAMPAIGN_CODE"),
        F.to_date("o_orderdate").alias("CAMPAIGN_DATE"),
        F.substring(F.lit("VABCN"), prio, 1).alias("CAMPFLAG1"),
        F.lit(None).cast("string").alias("CAMPFLAG2"),
        F.col("o_custkey").cast("string").alias("ENCRYPTED_PIN"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("RESERVATION_SEQUENCE"),
        offer7.alias("OFFER_CODE_FIRST_7"),
        F.lit("000").alias("OFFER_CODE_LAST_3"),
        F.when(F.col("o_orderstatus") == "O", "Prospecting").otherwise("Retargeting").alias("prospect_type"),
        F.when(F.col("o_custkey") % 20 == 0, F.lit(None).cast("string")).otherwise(vantage)
        .alias("SCORE_VANTAGE_VALUE_V3"),
        _score_text(F.col("o_orderkey") * 31 % 1000).alias("TRM10_Score"),
        (1 + F.col("o_orderkey") % 10).cast("int").alias("TRM10_TIER"),
        (F.col("o_custkey") % 13).cast("int").alias("TIMES_MAILED_12MO_CNT"),
        F.when(F.year("o_orderdate") == 1995, F.lit(None).cast("string"))
        .otherwise(_score_text(F.col("o_orderkey") * 17 % 1000)).alias("EXP_RESPONSE_SCORE"),
        F.when(F.col("o_orderkey") % 101 == 0, F.lit("S")).otherwise(F.lit(None).cast("string"))
        .alias("endmark"),
        (F.col("o_orderkey") % 7).cast("string").alias("TM12_3BR"),
    )


def application_rows(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Base of the three application tables below. Customers meet the orders, not the many line items. With ``buckets`` the rows
    lie in so many partitions by order, for a layout that does not exchange them again."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_returnflag",
        (F.col("l_linestatus") == "F").alias("boarded"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("order_month"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = o.join(c, o.o_custkey == c.c_custkey)
    if buckets:
        li, o = li.repartition(buckets, "l_orderkey"), o.repartition(buckets, "o_orderkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    app_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(app_id.alias("APPLICATION_ID"), "l_orderkey", "l_shipdate", "boarded", "l_returnflag", "o_custkey",
                       "order_month", "c_nationkey")


#: An application's id begins with its order, so the application tables may be joined on both: they meet where an order lies.
APPLICATION_KEY = ["APPLICATION_ID", "l_orderkey"]


def applications(rows: DataFrame, key: Sequence[str] = ("APPLICATION_ID",)) -> DataFrame:
    return rows.select(
        *key,
        F.col("l_shipdate").alias("APPLICATION_RECEIVE_DATE"),
        F.col("l_shipdate").alias("READY_TO_BOARD_DATE"),
        F.when(F.col("boarded"), F.col("l_shipdate")).alias("BOARDDATE"),
    )


def applicants(rows: DataFrame, key: Sequence[str] = ("APPLICATION_ID",)) -> DataFrame:
    return rows.select(*key,
                       F.date_add(F.lit("1950-01-01").cast("date"),
                                  (F.col("o_custkey") % 15000).cast("int")).alias("DOB"))


def application_status(rows: DataFrame, key: Sequence[str] = ("APPLICATION_ID",)) -> DataFrame:
    res = F.concat(_offer_code("c_nationkey", F.col("order_month")),
                   F.lpad(F.col("l_orderkey").cast("string"), 9, "0"))
    status = (F.when(F.col("l_returnflag") == "N", F.lit("Declined: Expired Offer"))
              .when(F.col("l_returnflag") == "R", F.lit("Failed IP Fraud Score Check"))
              .otherwise(F.lit("Approved")))
    return rows.select(*key, res.alias("RESERVATION_NUMBER"),
                       status.alias("STATUS_DESC"), F.col("l_returnflag").alias("STATUS_NAME"))


def program_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-char program code -> annual fee; one row per nation (25 by definition)."""
    n = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 6 != 5)
    return n.select(
        F.concat(F.lit("P"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("ProgramCode"),
        ((F.col("n_nationkey") % 4) * 25).cast("double").alias("finalcombinedaf"))


#: Attributes that the features derive from; the others are filled by one rule.
SHAPED_ATTRIBUTES = ("ALL7120", "ALL8370", "ALL2350", "ALL6980", "BCC5120", "BCC5830", "BCC5020", "ALL7110", "ALL7516",
                     "IQB9416", "IQT9416", "IQT9413", "IQT9415", "IQT9417", "IQT9410", "BCC5421", "IQT9510", "REV3511")
OTHER_ATTRIBUTES = tuple(a for a in ATTRIBUTES if a not in SHAPED_ATTRIBUTES)


def bureau_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bureau attribute table keyed by EPIN (customer), derived from line items.

    Attribute values are per-customer aggregates of line items folded into the
    ranges the feature rules expect; exception codes (> 990, > 9990,
    > 999999990) and zero denominators appear for some customers. Two file
    names let the file-name filter select a subset. The sums are grouped by the EPIN itself, so they are exchanged by the
    key of the join that follows, and the many attributes made of them are not; a line item's two marks travel as one.
    """
    marks = F.when(F.col("l_returnflag") == "R", 1).otherwise(0) + F.when(F.col("l_linestatus") == "O", 2).otherwise(0)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.floor("l_extendedprice").alias("price"), marks.alias("marks"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a = (li.join(o, li.l_orderkey == o.o_orderkey)
         .groupBy(F.col("o_custkey").cast("string").alias("EPIN"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum("price").cast("long").alias("px"),
              F.sum(F.col("marks").bitwiseAND(F.lit(1))).alias("nr"), F.sum(F.shiftright("marks", 1)).alias("no")))
    k = F.col("EPIN").cast("long")
    q, px, n, nr, no = (F.col(c) for c in ("q", "px", "n", "nr", "no"))

    def exc(mod, code, value):
        return F.when(k % mod == 0, F.lit(code)).otherwise(value).cast("double")

    named = [
        F.col("EPIN"),
        F.when(k % 3 == 0, F.lit("TRM_BUREAU_B")).otherwise(F.lit("TRM_BUREAU_A")).alias("FileName"),
        exc(23, 995, q % 260).alias("ALL7120"),
        exc(29, 9995, q * 7 % 240).alias("ALL8370"),
        (nr % 25).cast("double").alias("ALL2350"),
        exc(19, 996, no * 37 % 1100).alias("ALL6980"),
        exc(31, 999999999, F.when(k % 11 == 0, n).otherwise(px % 30000)).alias("BCC5120"),
        exc(37, 999999999, F.when(k % 13 == 0, n).otherwise(px % 2500)).alias("BCC5830"),
        exc(41, 999999999, F.when(k % 17 == 0, n * 9).otherwise(px * 3 % 26000)).alias("BCC5020"),
        exc(43, 999, q % 230).alias("ALL7110"),
        exc(47, 998, q * 3 % 150).alias("ALL7516"),
        (n % 4).cast("double").alias("IQB9416"),
        (n % 7).cast("double").alias("IQT9416"),
        (nr % 3).cast("double").alias("IQT9413"),
        (no % 5).cast("double").alias("IQT9415"),
        (n % 9).cast("double").alias("IQT9417"),
        ((n + no) % 11).cast("double").alias("IQT9410"),
        exc(53, 999999999, F.when(k % 5 == 0, F.lit(0)).otherwise(px % 7000)).alias("BCC5421"),
        exc(59, 9999, n % 15).alias("IQT9510"),
        exc(61, 98, nr % 4).alias("REV3511"),
    ]
    rest = [((px + q * (i + 1) + n * (i * i % 17)) % (40 + 13 * (i % 9))).cast("double").alias(c)
            for i, c in enumerate(OTHER_ATTRIBUTES)]
    return a.select(*named, *rest)
