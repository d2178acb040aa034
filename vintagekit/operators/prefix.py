"""Running sums over one global order per group, without a task that holds a group (W1, R1, R2 on real-valued scores).

Rows are dealt to ranges by (group, value), so a large group spans many ranges and no range is larger than its share of
all rows. Each (group, range) is summed up once; these few totals, at most one for each range and group, are added up in
order to what stands before each range. A row's running sum is then the sum within its range plus that offset. The rows are
staged with their range, so that both passes see the same ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.session import checkpoint_dir


class RunningSums:
    """``rows``: the given rows (one per group and value) with ``part``, ``cum_<sum>`` up to and with the row, and per
    group ``total_<sum>`` and ``total_rows``."""

    def __init__(self, df: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], ranges: int):
        spark, self.groups, self.value = df.sparkSession, list(groups), value
        path = f"{checkpoint_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
        dealt = df.repartitionByRange(ranges, *self.groups, value).withColumn("part", F.spark_partition_id())
        dealt.write.parquet(path)
        staged = spark.read.schema(dealt.schema).parquet(path)
        of_group = Window.partitionBy(*self.groups) if self.groups else Window.partitionBy(F.lit(0))
        before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        per_range = staged.groupBy(*self.groups, "part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(s).alias(f"_{s}") for s in sums])
        self.ranges = per_range.select(
            *self.groups, "part", F.sum("_rows").over(of_group).alias("total_rows"),
            *[F.sum(f"_{s}").over(of_group).alias(f"total_{s}") for s in sums],
            *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])
        inside = Window.partitionBy(*self.groups, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self._join(staged, self.ranges)
        self.rows = rows.withColumns({f"cum_{s}": F.col(f"_before_{s}") + F.sum(s).over(inside) for s in sums}).drop(
            *[f"_before_{s}" for s in sums])

    def _join(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """On group and range, null groups included: no key has more rows than a range."""
        keys = [*self.groups, "part"]
        other = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        return left.join(other, same).drop(*[f"_key_{k}" for k in keys])

    def with_group(self, rows: DataFrame, per_group: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``per_group`` (one row a group), by way of the ranges, so that a large group is
        not one key."""
        where = self.ranges.select(*self.groups, "part")
        if not self.groups:
            spread = where.withColumn("_one", F.lit(1)).join(per_group.withColumn("_one", F.lit(1)), "_one").drop("_one")
        else:
            other = per_group.withColumnsRenamed({k: f"_group_{k}" for k in self.groups})
            same = F.lit(True)
            for k in self.groups:
                same = same & F.col(k).eqNullSafe(F.col(f"_group_{k}"))
            spread = where.join(other, same).drop(*[f"_group_{k}" for k in self.groups])
        return self._join(rows, spread)

    def at(self, rows: DataFrame, count: str, positions: Column, keys: Sequence[str] = ()) -> DataFrame:
        """Linearly interpolated values at fractional positions (from 0) of the group's order, each value standing
        ``count`` times: one row per group, ``keys`` and number of the position in the array ``positions`` that each row of
        ``rows`` carries. A row gives out only the positions that it covers."""
        hi, lo = F.col(f"cum_{count}"), F.col(f"cum_{count}") - F.col(count)
        wanted = F.transform(positions, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        covered = F.filter(wanted, lambda x: ((F.floor(x["p"]) >= lo) & (F.floor(x["p"]) < hi)) | ((F.ceil(x["p"]) >= lo) & (F.ceil(x["p"]) < hi)))
        names = [*self.groups, *keys]
        met = rows.select(*names, self.value, lo.alias("_lo"), hi.alias("_hi"), F.explode(covered).alias("_x"))
        p = F.col("_x.p")
        holds = lambda x: (x >= F.col("_lo")) & (x < F.col("_hi"))
        ends = met.groupBy(*names, F.col("_x.i").alias("i")).agg(
            F.max(F.when(holds(F.floor(p)), F.col(self.value))).alias("_a"), F.max(F.when(holds(F.ceil(p)), F.col(self.value))).alias("_b"),
            F.first(p - F.floor(p)).alias("_f"))
        return ends.select(*names, "i", (F.col("_a").cast("double") + F.col("_f") * (F.col("_b") - F.col("_a")).cast("double")).alias("q"))
