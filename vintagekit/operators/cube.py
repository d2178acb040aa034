"""A stored state for month selections (F20, R13, R16): counts by dataset, read, board month and score.

Accounts are read once, when their month is written. Any list of months answers deciles, gains, lift, KPIs and month
statistics from these counts alone, since all of them add up over months. The counts are bounded by
months x reads x scores, however many accounts there are. A month is one partition folder; adding a month writes that
folder and touches no other, and a selection reads the folders of its months only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.operators import rank as R
from vintagekit.sources import publish as P

MONTH = "board_month"


def month_cube(pairs: DataFrame, keys: Sequence[str], month: Column) -> DataFrame:
    """(keys, board_month yyyy-MM, score counts) of eligible, valid-score rows."""
    return R.score_counts(pairs.withColumn(MONTH, F.date_format(month, "yyyy-MM")), [*keys, MONTH])


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """Cubes of separate accounts as one."""
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c)
    sums = ("n", "bads", "line", "lines")
    return out.groupBy(*[c for c in out.columns if c not in sums]).agg(*[F.sum(c).cast(out.schema[c].dataType).alias(c) for c in sums])


def write_months(cube: DataFrame, path: str) -> None:
    """Each month of ``cube`` takes the place of the stored one (staged, then moved in); other months are not touched."""
    spark, run = cube.sparkSession, uuid.uuid4().hex
    P.recover(spark, path, MONTH)
    staging = f"{path.rstrip('/')}/_staging/{run}"
    cube.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(staging)
    staged = P.partition_folders(spark, staging, MONTH)
    P.publish(spark, path, MONTH, run, staged, staged)


def stored_months(spark: SparkSession, path: str) -> list[str]:
    """Months of the state, from the folders' names."""
    return list(P.partition_folders(spark, path, MONTH))


def select_months(spark: SparkSession, path: str, months: Sequence[str] = ()) -> DataFrame:
    """the counts of the listed months; an empty list takes all. Months that are not stored add nothing."""
    folders = P.partition_folders(spark, path, MONTH)
    if not folders:
        raise FileNotFoundError(f"no months in {path}")
    wanted = [m for m in folders if not months or m in set(months)]
    rows = spark.read.option("basePath", path).parquet(*[folders[m] for m in wanted or list(folders)[:1]])
    rows = rows.withColumn(MONTH, F.col(MONTH).cast("string"))
    return rows if wanted else rows.where(F.lit(False))


def deciles(cube: DataFrame, groups: Sequence[str], k: int = 10) -> DataFrame:
    return R.tie_aware_deciles(cube, groups, bad="bads", k=k, count="n")


def kpis(cube: DataFrame, groups: Sequence[str], k: int = 10) -> DataFrame:
    """R8 for a selection."""
    return R.kpis_of(cube, groups, k)


def month_stats(cube: DataFrame, groups: Sequence[str], k: int = 10) -> DataFrame:
    """Per board month n, bads, rate, average score and D1/D10 lift."""
    keys = [*groups, MONTH]
    s = R.kpis_of(cube, keys, k)
    return s.select(*keys, F.col("eligible").alias("n"), "bads", F.col("edr").alias("bad_rate"), "avg_score", "d1_d10_lift")
