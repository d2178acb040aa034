"""Month-partitioned Parquet mart and the rollup files that feed it: file export and scan, ingest plan, validated
replace, load log, reads, status and export.

Files are bound by header name, never by position, and each file stands for itself: one that cannot be read, repeats or
lacks a column, or holds text where a number belongs fails its own month and no other. Of two files of a month the newer
is loaded. Rows are read once, into a staging folder beside the mart, dealt there by what is wrong with them; the rules
are checked on what was staged, and only months that pass are published (``publish``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vintagekit import config as C
from vintagekit.operators import metrics as M
from vintagekit.session import checkpoint_dir
from vintagekit.sources import publish as P

KEY = "campaign_month"
PLAN_SCHEMA = "campaign_month string, file_name string, path string, file_time timestamp, partition_time timestamp"


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


# --- rollup files -----------------------------------------------------------------------------

def write_rollup_csv(rollup: DataFrame, folder: str) -> None:
    """SNK2: one header CSV per month, named exp_<MON><YY>_rollup.csv; ``campaign_month`` (yyyy-MM) is in the name
    only. A month is an aggregate of about 10^4 rows, so it is one file from one task."""
    spark = rollup.sparkSession
    label = F.upper(F.date_format(F.to_date("campaign_month", "yyyy-MM"), "MMMyy"))
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    (rollup.withColumn("_label", label).drop("campaign_month").repartition("_label").write.option("header", True)
     .partitionBy("_label").csv(scratch))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(folder))
    for part in path(scratch).getFileSystem(conf).globStatus(path(f"{scratch}/_label=*/part-*.csv")):
        month = part.getPath().getParent().getName().partition("=")[2]
        target = path(f"{folder}/exp_{month}_rollup.csv")
        fs.delete(target, False)
        if not fs.rename(part.getPath(), target):
            raise OSError(f"cannot write {target}")


def rollup_files(spark: SparkSession, folder: str, named_only: bool = True) -> DataFrame:
    """(campaign_month, file_name, path, file_time) of the files named exp_..._rollup.csv, from the file system's own names
    and times (one listing of one file per month); no content is read. Names that give no month (ING2) have none, or are
    left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    rows = [(f.getPath().getName(), f.getPath().toString(), f.getModificationTime())
            for f in path.getFileSystem(conf).listStatus(path) if f.isFile()]
    files = spark.createDataFrame(rows, "file_name string, path string, ms long").where(F.col("file_name").rlike("(?i)^exp_.*_rollup\\.csv$"))
    files = files.withColumn("campaign_month", F.date_format(M.rollup_month("file_name"), "yyyy-MM"))
    return (files.where(F.col("campaign_month").isNotNull() if named_only else F.lit(True))
            .select("campaign_month", "file_name", "path", F.timestamp_millis("ms").alias("file_time")))


def header_of(spark: SparkSession, path: str) -> list[str] | None:
    """Column names of a file, from its first line alone; none for an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(p.getFileSystem(conf).open(p), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return None if line is None else [c.strip().strip('"').strip() for c in line.removeprefix("\ufeff").split(",")]


def header_fault(names: list[str] | None) -> str | None:
    """Why a file with this header cannot be loaded."""
    if names is None:
        return "the file is empty"
    low = [n.lower() for n in names]
    if again := sorted({n for n in low if low.count(n) > 1}):
        return f"repeated columns: {', '.join(again)}"
    if missing := [c for c in C.REQUIRED_ROLLUP_COLUMNS if c.lower() not in low]:
        return f"missing required columns: {', '.join(missing)}"
    return None


def read_rollup_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """SRC3: conformed rows of the files with ``load_month``, ``source_file`` and ``mark`` (what is wrong with the row, see
    ``conform_rollup``); and, by file name, why a file is not read. Files of equal headers are read together."""
    faults: dict[str, str] = {}
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        try:
            names = header_of(spark, p)
            fault = header_fault(names)
        except Py4JJavaError as e:
            fault = f"cannot be read: {e.java_exception.getClass().getSimpleName()}"
        if fault:
            faults[p.rpartition("/")[2]] = fault
        else:
            groups.setdefault(tuple(names), []).append(p)
    out = None
    for names, same in groups.items():
        schema = ", ".join(f"`{n or f'_{i}'}` string" for i, n in enumerate(names))
        raw = (spark.read.schema(f"{schema}, _line string").option("header", True).option("columnNameOfCorruptRecord", "_line").option("columnPruning", False)
               .csv(same).withColumn("source_file", file_name(F.col("_metadata.file_path"))))
        month = F.date_format(M.rollup_month("source_file"), "yyyy-MM")
        part = M.conform_rollup(M.prepare_rollup(raw, month), broken=F.col("_line").isNotNull()).withColumn("load_month", month)
        out = part if out is None else out.unionByName(part)
    return out, faults


def read_rollup_csv(spark: SparkSession, folder: str) -> DataFrame:
    """SRC3 for a whole folder; a file that cannot be read raises."""
    paths = [r["path"] for r in rollup_files(spark, folder).select("path").collect()]  # one per month
    out, faults = read_rollup_files(spark, paths)
    if faults or out is None:
        raise ValueError(f"unreadable files: {faults}" if faults else f"no rollup files in {folder}")
    return out


# --- mart -------------------------------------------------------------------------------------

def replace_months(df: DataFrame, path: str, expected: DataFrame | None = None,
                   on_step: Callable[[str, str], None] = lambda step, value: None) -> DataFrame:
    """SNK1 and DQ1: stage the rows (read once), check every month on what was staged, publish the months that pass. An
    empty month is refused, a failing one stays as it was. ``expected`` lists the months attempted. Returns the
    validation rows. ``on_step`` hears of each step: staged, moved, published."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    P.recover(spark, path, KEY)
    staging = f"{path.rstrip('/')}/_staging/{run}"
    if "mark" not in df.columns:
        foreign = ~F.col("campaign_month").eqNullSafe(F.col("load_month")) if "campaign_month" in df.columns else F.lit(False)
        df = df.withColumn("mark", F.when(foreign, "campaign_month").otherwise(M.CLEAN))
    rows = df.drop("campaign_month", "source_file")
    seen = Observation()
    (rows.hint("rebalance", "load_month", "mark").observe(seen, F.count(F.lit(1)).alias("rows")).write
     .partitionBy("load_month", "mark").parquet(staging))
    on_step("staged", "")
    staged = spark.read.schema(rows.schema).parquet(staging)
    v = M.validate_rollup(staged, expected)
    v = spark.createDataFrame(v.collect(), v.schema)  # bounded by the calendar; the staged files are about to move
    if (stored := staged.count()) != seen.get["rows"]:
        raise OSError(f"{stored} of {seen.get['rows']} rows are in {staging}")
    good = [r["campaign_month"] for r in v.filter("ok").select("campaign_month").orderBy("campaign_month").collect()]
    P.publish(spark, path, KEY, run, {m: f"{staging}/load_month={m}/mark={M.CLEAN}" for m in good}, good, on_step)
    return v


def _parts(spark: SparkSession, path: str) -> list[DataFrame]:
    """The mart's partitions by place: those in place and, while a publication is open, those moved aside."""
    places: dict[str, list[str]] = {}
    for folder in P.partition_folders(spark, path, KEY).values():
        places.setdefault(folder.rpartition("/")[0], []).append(folder)
    return [spark.read.option("basePath", base).parquet(*folders) for base, folders in places.items()]


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: partition discovery over the listed months; campaign_month stays text (yyyy-MM)."""
    out = None
    for df in _parts(spark, path):
        df = df.withColumn("campaign_month", F.col("campaign_month").cast("string"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError(f"no months in {path}")
    return out


def mart_months(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: materialised months, sorted, from the folders' names; no file is read."""
    return spark.createDataFrame([(m,) for m in P.partition_folders(spark, path, KEY)], "campaign_month string")


def partition_times(spark: SparkSession, path: str) -> DataFrame:
    """(campaign_month, partition_time): newest file of each month; empty without a mart."""
    out = spark.createDataFrame([], "campaign_month string, partition_time timestamp")
    for df in _parts(spark, path):
        out = out.unionByName(df.groupBy(F.col("campaign_month").cast("string").alias("campaign_month")).agg(
            F.max("_metadata.file_modification_time").alias("partition_time")))
    return out


def mart_status(spark: SparkSession, path: str) -> DataFrame:
    """Latest month, number of months, last refresh time (newest file)."""
    return partition_times(spark, path).agg(
        F.max("campaign_month").alias("latest_month"), F.count(F.lit(1)).alias("months"), F.max("partition_time").alias("last_refresh"))


# --- ingest -----------------------------------------------------------------------------------

def ingest_plan(files: DataFrame, partitions: DataFrame, as_of: dt.date, force: bool = False,
                recent: int = C.RECENT_REFRESH_WINDOW_MONTHS, freeze: int = C.HISTORY_FREEZE_MONTHS) -> DataFrame:
    """ING1: per file add / replace / skip, with an explicit ``frozen`` for months at or past the freeze limit (left
    alone even under force). files: (campaign_month, file_time, ...); partitions: (campaign_month, partition_time)."""
    j = files.join(partitions, "campaign_month", "left")
    m = F.to_date("campaign_month", "yyyy-MM")
    age = (F.year(F.lit(as_of)) * 12 + F.month(F.lit(as_of))) - (F.year(m) * 12 + F.month(m))
    there = F.col("partition_time").isNotNull()
    rules = [(age >= freeze, "frozen", "in the freeze window"), (there & F.lit(force), "replace", "forced"),
             (~there, "add", "new month"), (F.col("file_time") > F.col("partition_time"), "replace", "file newer than partition"),
             ((age >= 0) & (age < recent), "replace", "in the refresh window"), (F.lit(True), "skip", "up to date")]
    action = reason = None
    for cond, what, why in rules:
        action = F.when(cond, what) if action is None else action.when(cond, what)
        reason = F.when(cond, why) if reason is None else reason.when(cond, why)
    return j.select(*files.columns, "partition_time", age.alias("age_months"), action.alias("action"), reason.alias("reason"))


def newest_of_month(files: DataFrame) -> DataFrame:
    """``newest``: whether a file is the one to load of its month; equal times go by name. One row per file."""
    order = Window.partitionBy("campaign_month").orderBy(F.desc("file_time"), F.desc("file_name"))
    return files.withColumn("newest", F.col("campaign_month").isNotNull() & (F.row_number().over(order) == 1))


def _load(spark: SparkSession, files: list[tuple[str, str]], path: str) -> tuple[list, dict[str, str]]:
    """Validation rows of (month, path) files and, by file name, why a file failed before any rule. All files go through
    one job; if that job breaks, each goes through its own, so that one file breaks its own month only."""
    rows, faults = read_rollup_files(spark, [p for _, p in files])
    readable = [(m, p) for m, p in files if p.rpartition("/")[2] not in faults]
    if rows is None:
        return [], faults
    try:
        expected = spark.createDataFrame([(m,) for m, _ in readable], "load_month string")
        return replace_months(rows, path, expected).collect(), faults
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1:
            said = e.getCondition() if isinstance(e, PySparkException) else None
            return [], {files[0][1].rpartition("/")[2]: f"cannot be loaded: {said or type(e).__name__}"}
    checked: list = []
    for one in readable:
        more, why = _load(spark, [one], path)
        checked, faults = checked + more, faults | why
    return checked, faults


def run_ingest(spark: SparkSession, folder: str, path: str, as_of: dt.date, force: bool = False,
               log_path: str | None = None) -> DataFrame:
    """ING8: plan from the files' own names and times, load what is to be added or replaced, validate, publish the
    months that pass, append the log. One row per file: the plan, the month's totals, ``status`` (added, replaced,
    skipped, frozen, failed, ignored) and ``message``. A file that fails keeps its month as it was and no other month's
    load depends on it; of several files of a month the newest is loaded and the others are skipped; a name
    that gives no month is ignored."""
    files = newest_of_month(rollup_files(spark, folder, named_only=False))
    plan = ingest_plan(files, partition_times(spark, path), as_of, force)
    other = F.col("campaign_month").isNotNull() & ~F.col("newest")
    plan = plan.withColumns({
        "action": F.when(F.col("campaign_month").isNull(), "ignore").when(other, "skip").otherwise(F.col("action")),
        "reason": F.when(F.col("campaign_month").isNull(), "the name gives no month").when(other, "a newer file of the month is there")
        .otherwise(F.col("reason"))}).drop("newest")
    plan = spark.createDataFrame(plan.collect(), plan.schema)  # one row per file; the files may change under the job
    load = F.col("action").isin("add", "replace")
    todo = [(r["campaign_month"], r["path"]) for r in plan.where(load).select("campaign_month", "path").collect()]
    checked, faults = _load(spark, todo, path) if todo else ([], {})
    checked = spark.createDataFrame(checked, M.VALIDATION_SCHEMA).withColumn("loaded", F.lit(True))
    bad = spark.createDataFrame(sorted(faults.items()), "file_name string, fault string")
    j = (plan.withColumn("loaded", F.when(load, True)).join(checked, ["campaign_month", "loaded"], "left")
         .join(bad, "file_name", "left"))
    failed = load & (F.col("fault").isNotNull() | ~F.coalesce("ok", F.lit(False)))
    status = (F.when(failed, "failed").when(F.col("action") == "add", "added").when(F.col("action") == "replace", "replaced")
              .when(F.col("action") == "skip", "skipped").when(F.col("action") == "ignore", "ignored").otherwise("frozen"))
    message = F.coalesce("fault", F.when(failed, F.col("errors")).when(load, F.col("warnings"))
                         .when(F.col("reason").isin("the name gives no month", "a newer file of the month is there"), F.col("reason")), F.lit(""))
    out = j.select(*plan.columns, *M.TOTALS, status.alias("status"), message.alias("message"))
    out = spark.createDataFrame(out.collect(), out.schema)  # the outcome as it was, one row per file
    if log_path is not None:
        append_log(load_log_rows(out, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)), log_path)
    return out


def load_log_rows(outcome: DataFrame, loaded_time: dt.datetime) -> DataFrame:
    """SNK3: one log row per load attempt (skipped and frozen files are not attempts)."""
    return outcome.filter(F.col("status").isin("added", "replaced", "failed")).select(
        "campaign_month", F.col("path").alias("source_file"), F.col("file_time").alias("source_modified_time"),
        F.lit(loaded_time).alias("loaded_time"), *M.TOTALS, "status", "message")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def ingest_summary(outcome: DataFrame) -> DataFrame:
    """ING8: files per status, every status listed."""
    spark = outcome.sparkSession
    names = spark.createDataFrame([(s,) for s in ("added", "replaced", "skipped", "frozen", "failed")], "status string")  # of files that have a month
    n = outcome.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    return names.join(n, "status", "left").select("status", F.coalesce("files", F.lit(0)).alias("files"))


def filtered_export(mart: DataFrame, filters: dict, path: str, months=None, month_from=None, month_to=None) -> None:
    """SNK5: dictionary filter + month selection without look-back truncation, CSV."""
    out = M.month_window(M.dict_filter(mart, filters), months, month_from, month_to, lookback=None)
    out.write.mode("overwrite").option("header", True).csv(path)
