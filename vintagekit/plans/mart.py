"""Response mart over the campaign rollup: metrics, dashboard views, validation
and the month-partitioned Parquet mart (write, read, replace, logs)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit import config as C
from vintagekit.operators import campaign as CP
from vintagekit.operators import metrics as M
from vintagekit.plans.campaign import staged_response
from vintagekit.session import checkpoint_dir, prepare
from vintagekit.sources import mart_store as S
from vintagekit.sources import publish as P
from vintagekit.sources import testdata as TD
from vintagekit.sources.cache import cache_or_compute as staged
from vintagekit.sources.cache import source_path

ROW_DIM = C.DEFAULT_ROW_DIM
METRIC = C.DEFAULT_METRIC
#: Splits the cells of the small test tables; the library's default is config.SMALL_CELL_THRESHOLD.
CELL_THRESHOLD = 12
FILTERS = {"vs_band": ["640-700", "701-730", "731-830"], "scorecard": [2, 4], "not_a_column": ["x"]}


def build_mart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter M: the campaign rollup conformed as mart rows (campaign_month yyyy-MM)."""
    roll = CP.campaign_rollup(staged_response(spark, sf_dir))
    roll = roll.withColumn("campaign_month", F.date_format("campaign_month", "yyyy-MM"))
    return M.prepare_rollup(roll)


def mart_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart as the dashboard reads it: built once per session and staged as
    Parquet (SRC5), sorted by month so month filters skip row groups."""
    prepare(spark, TD.source_files(sf_dir))
    return staged(spark, source_path(spark, "mart", TD.source_files(sf_dir)), lambda: build_mart_rows(spark, sf_dir),
                            required=["campaign_month", "volume", "expected_responses_xpm"],
                            sort_within=["campaign_month"])


def aggregate_by(spark, sf_dir):
    return M.aggregate_by(mart_frame(spark, sf_dir), ["vs_band", "scorecard"])


def kpi_totals(spark, sf_dir):
    return M.kpi_totals(mart_frame(spark, sf_dir))


def monthly_trend(spark, sf_dir):
    return M.monthly_trend(mart_frame(spark, sf_dir))


def view(spark, sf_dir, **months) -> DataFrame:
    """The months a dashboard view shows: a list, a range, or the latest ones by default."""
    return M.month_window(mart_frame(spark, sf_dir), **months)


def calendar(spark, sf_dir) -> list[str]:
    """Every month of the years from the mart's first month to its last, bounded by the calendar: the columns of a wide
    pivot."""
    lo, hi = mart_frame(spark, sf_dir).agg(F.min("campaign_month"), F.max("campaign_month")).first()
    return [f"{y}-{m:02d}" for y in range(int(lo[:4]), int(hi[:4]) + 1) for m in range(1, 13)] if lo else []


def pivot_metric(spark, sf_dir):
    return M.pivot_metric(mart_frame(spark, sf_dir), ROW_DIM, METRIC, calendar(spark, sf_dir))


def suppress_small_cells(spark, sf_dir):
    agg = M.aggregate_by(mart_frame(spark, sf_dir), ["campaign_month", "vs_band"])
    return M.suppress_small_cells(agg, CELL_THRESHOLD)


def pivot_overall(spark, sf_dir):
    return M.pivot_overall_long(view(spark, sf_dir), ROW_DIM, METRIC, CELL_THRESHOLD)


def pivot_overall_wide(spark, sf_dir):
    """The wide table with Overall row and column."""
    return M.pivot_overall(mart_frame(spark, sf_dir), ROW_DIM, METRIC, calendar(spark, sf_dir), CELL_THRESHOLD)


def formatted_pivot(spark, sf_dir):
    """The wide table as text."""
    return M.formatted_pivot(pivot_overall_wide(spark, sf_dir), METRIC)


def exec_kpis(spark, sf_dir):
    return M.exec_kpis(mart_frame(spark, sf_dir))


TREND_RATES = ["actual_board_rate", "actual_response_rate", "expected_rr_trm", "expected_rr_xpm"]


def trend_long(spark, sf_dir):
    win = view(spark, sf_dir)
    return M.unpivot_metrics(M.monthly_trend(win), ["campaign_month"], TREND_RATES)


def model_by_band_trm(spark, sf_dir):
    agg = M.aggregate_by(view(spark, sf_dir), ["vs_band"])
    return M.unpivot_metrics(agg, ["vs_band"], ["actual_response_rate", "expected_rr_trm"])


def model_by_band_xpm(spark, sf_dir):
    m = view(spark, sf_dir).where(F.col("expected_responses_xpm").isNotNull())
    agg = M.aggregate_by(m, ["vs_band"])
    return M.unpivot_metrics(agg, ["vs_band"], ["actual_response_rate", "expected_rr_xpm"])


def model_monthly(spark, sf_dir):
    t = M.monthly_trend(view(spark, sf_dir))
    return M.unpivot_metrics(t, ["campaign_month"], ["actual_response_rate", "expected_rr_trm",
                                                            "expected_rr_xpm"], dropna=True)


def model_by_tier(spark, sf_dir):
    return M.aggregate_by(view(spark, sf_dir), ["trm10_tier"])


def model_by_scorecard(spark, sf_dir):
    return M.aggregate_by(view(spark, sf_dir), ["scorecard"])


def volume_mix(spark, sf_dir):
    return M.volume_mix(view(spark, sf_dir), ROW_DIM)


def mom_delta(spark, sf_dir):
    return M.mom_delta(view(spark, sf_dir), ROW_DIM, METRIC, CELL_THRESHOLD)


def volume_share(spark, sf_dir):
    return M.volume_share(view(spark, sf_dir), ROW_DIM)


def dict_filter(spark, sf_dir):
    return M.dict_filter(mart_frame(spark, sf_dir), FILTERS)


def month_window(spark, sf_dir):
    return M.month_window(mart_frame(spark, sf_dir))


def filter_options(spark, sf_dir):
    return M.filter_options(mart_frame(spark, sf_dir))


def validate_rollup(spark, sf_dir):
    return M.validate_rollup(mart_frame(spark, sf_dir).withColumn("load_month", F.col("campaign_month")))


def _month_number():
    return F.substring("campaign_month", 1, 4).cast("int") * 12 + F.substring("campaign_month", 6, 2).cast("int")


def faulty(mart: DataFrame) -> DataFrame:
    """The mart with one kind of fault in each of nine kinds of months."""
    k, v = _month_number() % 9, F.col("volume")
    first = F.col("trm10_tier") == 1
    out = mart.withColumn("load_month", F.col("campaign_month")).where(k != 0)  # 0: no rows at all
    return (out.withColumn("volume", F.when((k == 1) & first, -v).when(k == 2, F.lit(0)).otherwise(v).cast("long"))
            .withColumn("responders", F.when(k == 3, v * 2).when((k == 8) & first, v + 1).when(k.isin(2, 8), F.lit(0)).otherwise(F.col("responders")).cast("long"))
            .withColumn("Boards", F.when(k == 4, v * 2).when(k == 2, F.lit(0)).otherwise(F.col("Boards")).cast("long"))
            .withColumn("campaign_month", F.when((k == 5) & first, F.lit("1900-01")).otherwise(F.col("campaign_month")))
            .withColumn("expected_responses", F.when(k == 6, v * 3.0).otherwise(F.col("expected_responses")))
            .withColumn("expected_responses_xpm", F.when(k == 7, v * -1.0).otherwise(F.col("expected_responses_xpm"))))


def validate_rollup_faulty(spark, sf_dir):
    """DQ1 with every rule at work, and one month that only single rows, not totals, would block."""
    mart = mart_frame(spark, sf_dir)
    return M.validate_rollup(faulty(mart), mart.select(F.col("campaign_month").alias("load_month")))


def validation_summary(spark, sf_dir):
    return M.validation_summary(mart_frame(spark, sf_dir))


def parse_rollup_month(spark, sf_dir):
    """ING2 on the file names the SAS export gives each mart month, plus malformed names."""
    months = mart_frame(spark, sf_dir).select("campaign_month").distinct()
    d = F.to_date("campaign_month", "yyyy-MM")
    names = months.select(F.concat(F.lit("exp_"), F.upper(F.date_format(d, "MMMyy")), F.lit("_rollup.csv"))
                          .alias("file_name"))
    odd = months.select(F.concat(F.lit("EXP_"), F.lower(F.date_format(d, "MMMyy")), F.lit("_rollup.CSV"))
                        .alias("file_name"))
    bad = months.select(F.concat(F.lit("exp_"), F.date_format(d, "yyyyMM"), F.lit("_rollup.csv"))
                        .alias("file_name"))
    return M.parse_rollup_month(names.unionByName(odd).unionByName(bad))


def missing_months(spark, sf_dir):
    """ING9: the calendar of the mart against files that lack every fifth month."""
    mart = mart_frame(spark, sf_dir).select("campaign_month")
    return M.missing_months(M.expected_months(mart), mart.where(_month_number() % 5 != 0))


# ----------------------------------------------------------------------------
# file-backed mart
# ----------------------------------------------------------------------------

AS_OF = dt.date(2001, 9, 15)


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/mart-{name}-{uuid.uuid4().hex[:8]}"


def _loadable(spark, sf_dir) -> DataFrame:
    return mart_frame(spark, sf_dir).withColumn("load_month", F.col("campaign_month"))


_STORES: dict[tuple, str] = {}


def _store(spark, sf_dir) -> str:
    """The mart written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = _scratch(spark, "store")
        S.replace_months(_loadable(spark, sf_dir), path)
        _STORES[key] = path
    return _STORES[key]


def mart_replace_month(spark, sf_dir):
    """SNK1: faulty months over a good mart - the months that pass are replaced, the others stay. Per month the
    outcome and what is stored afterwards."""
    path = _scratch(spark, "store")
    S.replace_months(_loadable(spark, sf_dir), path)
    v = S.replace_months(faulty(mart_frame(spark, sf_dir)), path)
    stored = S.read_mart(spark, path).groupBy("campaign_month").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.sum("volume").alias("stored_volume"), F.sum("responders").alias("stored_responders"))
    return stored.join(v.select("campaign_month", "ok", "errors"), "campaign_month", "left")


def read_mart(spark, sf_dir):
    return S.read_mart(spark, _store(spark, sf_dir))


def mart_months(spark, sf_dir):
    return S.mart_months(spark, _store(spark, sf_dir))


def _export(spark, rows: DataFrame, folder: str) -> None:
    S.write_rollup_csv(rows, folder)


def _rollup(spark, sf_dir) -> DataFrame:
    return CP.campaign_rollup(staged_response(spark, sf_dir)).withColumn("campaign_month", F.date_format("campaign_month", "yyyy-MM"))


def csv_rollup_roundtrip(spark, sf_dir):
    """SNK2 -> SRC3: rollup written as one named CSV per month, read back by header name."""
    folder = _scratch(spark, "csv")
    _export(spark, _rollup(spark, sf_dir), folder)
    return S.read_rollup_csv(spark, folder).drop("load_month", "mark")


def _ingested(spark, sf_dir) -> tuple[DataFrame, str, str]:
    """A full ingest over real files: half of the months are in the mart, a third of these has a newer file, and one
    kind of month has a file whose totals fail. Outcome, mart path, log path."""
    folder, path, log = (_scratch(spark, n) for n in ("files", "store", "log"))
    roll, k = _rollup(spark, sf_dir), _month_number()
    broken = roll.withColumn("responders", F.when(k % 7 == 3, F.col("volume") * 2).otherwise(F.col("responders")))
    _export(spark, broken, folder)
    S.replace_months(_loadable(spark, sf_dir).where(k % 2 == 0), path)
    _export(spark, broken.where(k % 6 == 0), folder)
    return S.run_ingest(spark, folder, path, AS_OF, log_path=log), path, log


def ingest_plan(spark, sf_dir):
    """ING1 from real files and partitions and an injected as-of date."""
    return _ingested(spark, sf_dir)[0].select("campaign_month", "file_name", "age_months", "action", "reason")


def ingest_summary(spark, sf_dir):
    """ING8: files per outcome."""
    return S.ingest_summary(_ingested(spark, sf_dir)[0])


def load_log(spark, sf_dir):
    """SNK3: the log of one ingest, without its two time columns."""
    log = spark.read.parquet(_ingested(spark, sf_dir)[2])
    return (log.where(F.col("source_modified_time").isNotNull() & F.col("loaded_time").isNotNull())
            .withColumn("source_file", S.file_name("source_file")).drop("source_modified_time", "loaded_time"))


#: What kind of file a month gets in ``ingest_isolation``, by its number of months modulo 8.
FILE_KINDS = ("good", "text for a volume", "repeated column", "missing column", "empty", "two files", "bad name", "whole numbers as decimals")


def _odd_files(spark, sf_dir) -> str:
    """One rollup file a month of the mart, of the kinds above; returns the folder."""
    folder, older = _scratch(spark, "odd"), _scratch(spark, "older")
    roll, k = _rollup(spark, sf_dir), _month_number() % len(FILE_KINDS)
    text = F.col("volume").cast("string")
    _export(spark, roll.where(k.isin(0, 4, 5, 6)), folder)
    _export(spark, roll.where(k == 1).withColumn("volume", F.when(F.col("trm10_tier") == 1, F.lit("1 000")).otherwise(text)), folder)
    _export(spark, roll.where(k == 2).withColumn("VOLUME ", text), folder)
    _export(spark, roll.where(k == 3).drop("Boards"), folder)
    _export(spark, roll.where(k == 7).withColumn("volume", F.concat(text, F.lit(".0"))), folder)
    _export(spark, roll.where(k == 5).withColumn("volume", F.col("volume") * 2), older)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    for r in S.rollup_files(spark, folder).collect():  # one per month
        kind = (int(r["campaign_month"][:4]) * 12 + int(r["campaign_month"][5:])) % len(FILE_KINDS)
        if kind == 4:
            fs.create(path(r["path"]), True).close()
        elif kind == 5:
            other = path(f"{folder}/{r['file_name'].lower()}")
            fs.rename(path(f"{older}/{r['file_name']}"), other)
            fs.setTimes(other, 1_000_000_000_000, -1)
        elif kind == 6:
            fs.rename(path(r["path"]), path(f"{folder}/exp_{r['campaign_month'].replace('-', '')}_rollup.csv"))
    return folder


def ingest_isolation(spark, sf_dir):
    """ING8 over files of eight kinds in one run: outcome per file, and what the mart holds of its month afterwards."""
    path = _scratch(spark, "store")
    done = S.run_ingest(spark, _odd_files(spark, sf_dir), path, AS_OF)
    stored = S.read_mart(spark, path).groupBy("campaign_month").agg(F.sum("volume").alias("stored_volume"))
    return done.select("campaign_month", "file_name", "action", "status", "message", "row_count", "total_volume").join(stored, "campaign_month", "left")


class _Died(Exception):
    """Stands for a writer that is lost between two steps."""


def mart_swap(spark, sf_dir):
    """SNK1 with a writer that dies after a step: the last four months of the mart are replaced by ones of twice the
    volume. What a reader finds then, and after the table was recovered, beside a temporary month that no one lists."""
    rows = _loadable(spark, sf_dir)
    last = [r[0] for r in rows.select("load_month").distinct().orderBy(F.desc("load_month")).limit(4).collect()]
    rows = rows.where(F.col("load_month").isin(last))
    out = None
    for step, value in (("staged", ""), ("moved", sorted(last)[1]), ("published", sorted(last)[1])):
        path = _scratch(spark, "store")
        S.replace_months(rows, path)
        spark.range(1).write.parquet(f"{path}/campaign_month=1900-01{P.TMP}")

        def on_step(at, month, here=(step, value)):
            if (at, month) == here:
                raise _Died

        try:
            S.replace_months(rows.withColumn("volume", F.col("volume") * 2), path, on_step=on_step)
        except _Died:
            pass
        states = []
        for state in ("open", "recovered"):
            if state == "recovered":
                P.recover(spark, path, S.KEY)
            mart = S.mart_months(spark, path).join(S.read_mart(spark, path), "campaign_month", "left")
            seen = mart.groupBy("campaign_month").agg(F.sum("volume").alias(state))
            states.append(spark.createDataFrame(seen.collect(), seen.schema))  # as it is now: a row a month
        both = states[0].join(states[1], "campaign_month", "full").withColumn("died_after", F.lit(step))
        out = both if out is None else out.unionByName(both)
    return out


def mart_status(spark, sf_dir):
    return S.mart_status(spark, _store(spark, sf_dir)).withColumn("refreshed", F.col("last_refresh").isNotNull()).drop("last_refresh")


def filtered_export(spark, sf_dir):
    out = _scratch(spark, "export")
    S.filtered_export(read_mart(spark, sf_dir), FILTERS, out, month_from="1997-01", month_to="1999-12")
    return M.conform_rollup(spark.read.option("header", True).csv(out))


def cache_or_compute(spark, sf_dir):
    """SRC5: the second call reads the staged copy."""
    mart_frame(spark, sf_dir)
    return mart_frame(spark, sf_dir)


def cache_rules(spark, sf_dir):
    """SRC5: what makes a copy be built again. Per step how often the build ran and the copy's rows and sum."""
    import threading

    source, place = _scratch(spark, "source"), _scratch(spark, "copies")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    out, builds = [], []

    def copy(nonempty=True):
        path = f"{place}/{source_path(spark, 'orders', [source]).rpartition('/')[2]}"

        def build():
            builds.append(1)
            return spark.read.parquet(source).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last"))

        return staged(spark, path, build, required=["o_custkey"], allow_empty=not nonempty), path

    def note(step, df):
        r = df.agg(F.count(F.lit(1)), F.sum("orders"), F.sum("last")).first()
        out.append((step, len(builds), r[0], r[1], r[2]))
        builds.clear()

    even = F.col("o_orderkey") % 2 == 0
    orders.where(even).write.parquet(source)
    note("1 built", copy()[0])
    note("2 read", copy()[0])
    orders.where(~even).write.mode("append").parquet(source)
    df, path = copy()
    note("3 source changed", df)
    df.limit(0).write.mode("overwrite").parquet(path)
    note("4 copy emptied", copy()[0])
    orders.limit(0).write.mode("append").parquet(source)  # new files again, so both builders find no copy
    both = [threading.Thread(target=copy) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    builds.clear()  # one or two, as it happens
    note("5 two at once", copy()[0])
    return spark.createDataFrame(out, "step string, builds int, customers long, orders long, last_keys long")
