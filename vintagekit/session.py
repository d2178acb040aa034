"""SparkSession construction and session-level settings the library relies on."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import SparkSession

from vintagekit.sources.publish import Folder

#: Bytes of source files for each partition of a shuffle, and what a task reads at most: a task's sorts then fit its memory at
#: any size of the input.
SOURCE_BYTES, TASK_BYTES = 4 << 20, 16 << 20
MOST_PARTITIONS = 1 << 16
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Whether tables that lie by some of their join keys are exchanged by all of them first.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vintagekit") -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession, sources: Iterable[str] = ()) -> SparkSession:
    """Settings every job needs: UTC dates, AQE, a checkpoint directory and, for a job over these source paths, the sizes of
    its tasks."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    join_on_part_of_the_key(spark, False)
    checkpoint_dir(spark)
    if sources := list(sources):
        fit(spark, sum(Folder(spark, p).size() for p in sources))
    return spark


def fit(spark: SparkSession, source_bytes: int) -> None:
    """Shuffles start with a partition for every SOURCE_BYTES, at least with the session's number; AQE joins small ones up to
    TASK_BYTES. Values that the deployment has set itself stay."""
    given = spark.sparkContext.getConf()
    if not given.contains(INITIAL):
        own, wanted = int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-source_bytes // SOURCE_BYTES), MOST_PARTITIONS)
        if wanted > own:
            spark.conf.set(INITIAL, wanted)
        else:
            spark.conf.unset(INITIAL)
    for key in TASK_SIZES:
        if not given.contains(key):
            spark.conf.set(key, TASK_BYTES)


def join_on_part_of_the_key(spark: SparkSession, allowed: bool) -> None:
    """For a query over tables that lie by one of their join keys: they are joined there. Every ``prepare`` ends it, since
    elsewhere a part of the key may be one hot value. A value that the deployment has set itself stays."""
    if not spark.sparkContext.getConf().contains(ALL_KEYS):
        if allowed:
            spark.conf.set(ALL_KEYS, "false")
        else:
            spark.conf.unset(ALL_KEYS)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, which on a cluster names shared storage.

    Without it a local master uses the scratch folder that its session removes at the end; any
    other master raises, since executors would not see each other's files."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(staging_root(sc.master, spark.conf.get("spark.checkpoint.dir", None), sc._temp_dir))
    return sc.getCheckpointDir()


def staging_root(master: str, configured: str | None, local: str) -> str:
    if configured:
        return configured
    if master.startswith("local[") or master == "local":
        return f"{local}/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
