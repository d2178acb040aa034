"""Account payload (one row per dataset and account with per-read flags) and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.config import Read, StudyConfig
from vintagekit.operators.prefix import RunningSums

ACCT = "creditaccountid"


def account_frame(long: DataFrame, reads: Sequence[Read], board_col: str, cfg: StudyConfig,
                  keys: Sequence[str] = ()) -> DataFrame:
    """J14 + D5: align the reads of one population on the first read's accounts, in one aggregation.

    ``long`` has one row per (account, read) with metric_eligible and target.
    The base is the first read's accounts with a valid score; every read
    contributes e_<read> (eligible) and b_<read> (bad), missing -> 0; a row without a key has none.
    """
    keys = list(keys) + [ACCT]
    is_base = (F.col("read_key") == reads[0].key) & F.col("bhvr_score").between(cfg.valid_min, cfg.valid_max)

    def base(c: Column) -> Column:
        return F.min(F.when(is_base, c))

    def flag(r: Read, c: str) -> Column:
        return F.max(F.when(F.col("read_key") == r.key, F.coalesce(F.col(c), F.lit(0)))).cast("int")

    out = long.groupBy(*keys).agg(
        F.max(F.when(is_base, 1)).alias("_base"),
        base(F.date_format(F.col(board_col), "yyyy-MM")).alias("board_month"), base(F.col("program_code")).alias("program"),
        base(F.col("channel")).alias("channel"), base(F.col("creditline")).alias("cl"),
        base(F.bround(F.col("bhvr_score").cast("double"), 0).cast("int")).alias("score"),
        *[flag(r, c).alias(f"{p}_{r.key}") for r in reads for p, c in (("e", "metric_eligible"), ("b", "target"))])
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    return out.filter(F.col("_base") == 1).select(
        *keys, "board_month", "score", "cl", F.coalesce("program", F.lit("")).alias("program"),
        F.coalesce("channel", F.lit("")).alias("channel"),
        *[F.coalesce(F.when(keyed, F.col(f"{p}_{r.key}")), F.lit(0)).alias(f"{p}_{r.key}") for r in reads for p in ("e", "b")])


def with_dataset(df: DataFrame, dataset_id, prism: str, population) -> DataFrame:
    def lit(v):
        return v if not isinstance(v, str) else F.lit(v)
    return df.select(lit(dataset_id).alias("dataset_id"), F.lit(prism).alias("prism"),
                     lit(population).alias("population"), *df.columns)


def payload_long(payload: DataFrame, reads: Sequence[Read]) -> DataFrame:
    """Unpivot a payload to (dataset, account, read, score, eligible, bad)."""
    structs = [F.struct(F.lit(r.key).alias("read_key"), F.col(f"e_{r.key}").alias("eligible"),
                        F.col(f"b_{r.key}").alias("bad")) for r in reads]
    keep = ["dataset_id", "prism", "population", ACCT, "board_month", "score", "cl"]
    return payload.select(*keep, F.explode(F.array(*structs)).alias("_r")).select(*keep, "_r.*")


def write_payload(payload: DataFrame, path: str) -> None:
    """SNK6: partitioned Parquet, one folder per dataset."""
    payload.write.mode("overwrite").partitionBy("dataset_id").parquet(path)


#: Accounts of a chunk of the columnar payload.
CHUNK = 4096
CODED = ("board_month", "program", "channel")


def payload_metadata(payload: DataFrame, reads: Sequence[Read], chunk: int = CHUNK) -> DataFrame:
    """SNK6: one row per dataset - accounts, chunks, reads and the sorted values behind the codes (a calendar and two
    code lists); ``months`` are the board months."""
    return payload.groupBy("dataset_id", "prism", "population").agg(
        F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"),
        F.array(*[F.lit(r.key) for r in reads]).alias("reads"),
        *[F.sort_array(F.collect_set(c)).alias("months" if c == "board_month" else f"{c}s") for c in CODED])


def columnar_payload(payload: DataFrame, reads: Sequence[Read], chunk: int = CHUNK, ranges: int = 200) -> tuple[DataFrame, DataFrame]:
    """SNK6: (chunks, metadata). A chunk is one row of aligned arrays of at most ``chunk`` accounts of one dataset, in
    account order: score, cl, coded month, program and channel, and e_/b_ flags of each read. Accounts are numbered over
    ranges, so no dataset meets in one task."""
    meta = payload_metadata(payload, reads, chunk)
    flags = [f"{p}_{r.key}" for r in reads for p in ("e", "b")]
    numbered = RunningSums(payload.withColumn("one", F.lit(1).cast("long")), ["dataset_id"], ACCT, ["one"], ranges).rows
    row = F.struct(F.col("cum_one").alias("at"), ACCT, *CODED, "score", "cl", *flags)
    packed = numbered.groupBy("dataset_id", F.floor((F.col("cum_one") - 1) / chunk).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(row)).alias("_rows"))
    coded = packed.join(meta.select("dataset_id", F.col("months").alias("board_months"), "programs", "channels"), "dataset_id")

    def code(c: str) -> Column:
        return F.transform("_rows", lambda r: (F.array_position(F.col(f"{c}s"), r[c]) - 1).cast("int")).alias(c)

    return coded.select("dataset_id", "chunk", F.col(f"_rows.{ACCT}").alias(ACCT), *[code(c) for c in CODED],
                        *[F.col(f"_rows.{c}").alias(c) for c in ("score", "cl", *flags)]), meta


def unpack_payload(chunks: DataFrame, meta: DataFrame, reads: Sequence[Read]) -> DataFrame:
    """The account rows of a columnar payload."""
    flags = [f"{p}_{r.key}" for r in reads for p in ("e", "b")]
    cols = [ACCT, *CODED, "score", "cl", *flags]
    rows = chunks.select("dataset_id", F.inline(F.arrays_zip(*cols)))
    m = meta.select("dataset_id", "prism", "population", F.col("months").alias("board_months"), "programs", "channels")
    out = rows.join(m, "dataset_id")
    return out.select("dataset_id", "prism", "population", ACCT,
                      *[F.col(f"{c}s")[F.col(c)].alias(c) if c in CODED else F.col(c)
                        for c in ("board_month", "score", "cl", "program", "channel", *flags)])


def write_deciles(deciles: DataFrame, path: str) -> None:
    """SNK7: partitioned Parquet, one folder per dataset."""
    deciles.write.mode("overwrite").partitionBy("dataset_id").parquet(path)


def write_activation(by_month: DataFrame, path: str) -> None:
    """SNK7: the activation-by-month sheet as CSV (a row a month)."""
    by_month.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def dataset_diagnostics(payload: DataFrame, expected: DataFrame) -> DataFrame:
    """SNK8: one row per expected dataset (dataset_id, source): rows, included/empty status and what to say of it."""
    counts = payload.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("board_month").alias("_months"))
    out = expected.join(counts, "dataset_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    some = F.col("rows") > 0
    said = F.concat(F.format_number("rows", 0), F.lit(" valid-scored accounts across "), F.col("_months").cast("string"), F.lit(" board month(s)"))
    return out.select("dataset_id", "source", "rows", F.when(some, "included").otherwise("empty").alias("status"),
                      F.when(some, said).otherwise("No accounts available for this slice.").alias("message"))


def activation_diagnostics(base: DataFrame, scores: DataFrame) -> DataFrame:
    """SNK8 for the activation tracker: boarded accounts and how many of them have a cohort score."""
    g = base.join(scores.select(ACCT, "bhvr_score"), ACCT, "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count("bhvr_score").alias("_scored"))
    some = F.col("rows") > 0
    said = F.concat(F.format_number("rows", 0), F.lit(" boarded accounts ("), F.format_number("_scored", 0), F.lit(" with a cohort score)"))
    return g.select(F.lit("activation").alias("dataset_id"), F.lit("Active card tracker").alias("source"), "rows",
                    F.when(some, "included").otherwise("empty").alias("status"), F.when(some, said).otherwise("No boarded accounts.").alias("message"))
