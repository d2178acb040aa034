"""Tasks stay small as the input grows: partitions of shuffles, bytes of a scan's task and buckets follow the source's bytes."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from vintagekit import session as S
from vintagekit.plans import campaign as CA
from vintagekit.sources import buckets as B

MB = 1 << 20


@pytest.fixture
def big(tmp_path):
    with open(tmp_path / "big.parquet", "wb") as f:
        os.truncate(f.fileno(), 400 * MB)  # sparse
    return str(tmp_path / "big.parquet")


@pytest.fixture
def spark_again(spark):
    yield spark
    S.fit(spark, 0)


def test_shuffles_follow_the_bytes_of_the_source(spark_again, big):
    spark = spark_again
    S.prepare(spark, [big])
    assert int(spark.conf.get(S.INITIAL)) == 100
    text = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in text and ", 100)" in text
    S.prepare(spark, [big, f"{big}.none"])
    assert int(spark.conf.get(S.INITIAL)) == 100
    S.prepare(spark, [f"{big}.none"])  # small again: the session's own number
    assert spark.conf.get(S.INITIAL, None) is None


def test_a_scan_task_reads_few_bytes(spark_again, big):
    S.prepare(spark_again, [big])
    assert spark_again.read.text(big).rdd.getNumPartitions() >= 13


def test_a_layout_has_a_bucket_for_few_bytes(spark, big):
    assert B.bucket_count(spark, big) == 16


def test_mailed_codes_are_known_to_be_few(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200000")  # below the orders of the test table
    try:
        text = CA.applications(spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin [CampaignCode" in text


def test_first_applications_carry_what_the_join_takes(spark):
    text = CA.response(spark, SF_CHECK)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(struct(" in text and "DOB" not in "".join(line for line in text.splitlines() if "min_by(struct(" in line)
