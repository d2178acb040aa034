"""Exact distinct counts of integer ids from mergeable bitmaps.

Ids (dense surrogate keys: 0, 1, 2, ...) fall into buckets of 32,768; a bitmap holds the ids of a bucket, one for each
condition, in one aggregation without expanding the rows. Bitmaps merge by OR, so counts of unions come from stored
bitmaps alone. A task or an exchange holds at most 4 KB for each key, bucket and condition, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bitmaps(df: DataFrame, keys: Sequence[str | Column], id_col: str, conditions: Mapping[str, Column], *more: Column) -> DataFrame:
    """(keys, bucket, a bitmap for each condition, ``more`` aggregates): which ids meet the condition in any row."""
    at = F.bitmap_bit_position(id_col)
    return df.groupBy(*keys, F.bitmap_bucket_number(id_col).alias("bucket")).agg(
        *[F.bitmap_construct_agg(F.when(c, at)).alias(name) for name, c in conditions.items()], *more)


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str], names: Sequence[str], *more: Column) -> DataFrame:
    """Distinct ids per key and condition."""
    return bitmaps.groupBy(*keys).agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in names], *more)


def union_counts(bitmaps: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: distinct ids over all keys together."""
    merged = bitmaps.groupBy("bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in names])
    return merged.agg(*[F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).alias(n) for n in names])
