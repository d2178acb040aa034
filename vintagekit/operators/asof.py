"""As-of join of two tables (J5): each left row with the nearest right row of its key, backward, forward or either way.

Both tables are united and each (key, slice of time) is ordered once; the last or next right row is carried along as the
last non-null value. A key is cut into slices of time, so a key that holds a large part of all rows is many keys; what a
slice takes over from the slices beside it is one row for each slice, carried over the slices of a key. Right rows of
one key and time are reduced to the first in tie order before they travel; left rows of one key and time are looked up once
and get the result by an equality join, so a slice holds distinct times only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _position(df: DataFrame, col: str) -> Column:
    """A time as a number: days of a date, microseconds of a timestamp, a number as it is."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    return F.col(col)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str],
              direction: str = "backward", tolerance: float | None = None, ties: Sequence[str] = (), width: float = 366,
              prefer: str = "backward") -> DataFrame:
    """All rows and columns of ``left``, the ``columns`` of the matched ``right`` row and ``gap``, its time less the
    left row's (in days for dates, microseconds for timestamps); null without a match.

    ``direction``: backward (right time <= left time), forward (>=) or nearest (of equally near rows the one of
    ``prefer``). ``tolerance`` bounds the distance, in the unit of the gap. Of right rows at one time that with the largest
    ``ties`` columns, in order, is taken. ``width``: the length of a slice, in the same unit. A null key or time matches
    nothing; clashing names raise."""
    keys, own = list(keys), left.columns
    if clash := sorted({*columns, "gap"} & set(own)):
        raise ValueError(f"names on both sides: {clash}")
    if direction not in ("backward", "forward", "nearest") or prefer not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r} or preference {prefer!r}")
    slot = F.floor(F.col("_t") / F.lit(width)).cast("long").alias("_slice")
    usable = F.lit(True)
    for c in keys:
        usable = usable & F.col(c).isNotNull()
    r = right.where(usable & F.col(right_time).isNotNull()).select(
        *keys, _position(right, right_time).alias("_t"), F.struct(*[F.col(c) for c in columns]).alias("_r"),
        F.struct(*[F.col(c) for c in ties] or [F.lit(0)]).alias("_o"))
    r = r.groupBy(*keys, "_t").agg(F.max_by("_r", "_o").alias("_r"))
    r = r.select(*keys, "_t", slot, F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")).alias("_r"))
    here = usable & F.col(left_time).isNotNull()
    timed = left.where(here)
    lefts = timed.select(*keys, _position(left, left_time).alias("_t"), F.struct(*[F.col(c) for c in own]).alias("_l"))
    asked = lefts.select(*keys, "_t").distinct().select(*keys, "_t", slot)
    both = r.select(*keys, "_t", "_slice", F.lit(False).alias("_asked"), "_r").unionByName(
        asked.select("*", F.lit(True).alias("_asked"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r")))
    ends = both.groupBy(*keys, "_slice").agg(F.min("_r.t").alias("_lo"), F.min_by("_r", "_r.t").alias("_first"), F.max_by("_r", "_r.t").alias("_last"))
    slices = Window.partitionBy(*keys).orderBy("_slice")
    ends = ends.select(
        *keys, "_slice", F.last("_last", True).over(slices.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(slices.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = both.join(ends, [*keys, "_slice"])
    inside = Window.partitionBy(*keys, "_slice")
    right_first = F.col("_asked")
    back = F.last("_r", True).over(inside.orderBy(F.asc("_t"), right_first).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_r", True).over(inside.orderBy(F.desc("_t"), right_first).rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = F.coalesce(back, "_before"), F.coalesce(ahead, "_after")
    if direction == "nearest":
        found = both.withColumns({"_b": back, "_a": ahead}).where("_asked")
        b, a = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
        first = b <= a if prefer == "backward" else b < a
        found = found.withColumn("_m", F.when(b.isNull() | (a.isNotNull() & ~first), F.col("_a")).otherwise(F.col("_b")))
    else:
        found = both.withColumn("_m", back if direction == "backward" else ahead).where("_asked")
    found = lefts.join(found.select(*keys, "_t", "_m"), [*keys, "_t"])
    gap = F.col("_m.t") - F.col("_t")
    near = F.col("_m").isNotNull() & (F.lit(True) if tolerance is None else F.abs(gap) <= F.lit(tolerance))
    out = found.select("_l.*", *[F.when(near, F.col("_m.r")[c]).alias(c) for c in columns], F.when(near, gap).alias("gap"))
    rest = left.where(~F.coalesce(here, F.lit(False)))
    return out.unionByName(rest, allowMissingColumns=True)
