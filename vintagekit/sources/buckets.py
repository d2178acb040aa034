"""Tables laid out once by their join key (J1-J4, J6, J7): bucketed, sorted Parquet tables of the session's catalog.

Two tables with the same buckets on the join key are joined where they lie: no exchange of either side, however often they
are joined. The fact has one layout per join key: (cardid, reportingdate) for the month-end table, and account for account
sets. An account may hold any share of the rows, so the account layout has a second key, the slice of the row's month; a
set of accounts is written once per slice (``SLICES`` rows per account, a fixed factor), and a hot account
is spread over as many buckets.

A layout is a copy by the rules of ``cache``: named by the fingerprint of its source, written beside its place and moved in by
one rename; a session that finds it registers it without writing. Both sides of a join must have the same number of buckets,
which follows the bytes of the fact (:func:`bucket_count`).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.sources.cache import cache_or_compute
from vintagekit.sources.publish import Folder

SLICES, SLICE = 8, "month_slice"
#: A bucket is read, decoded and sorted by one task, so it holds few bytes of the fact's files.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 16


def bucket_count(spark: SparkSession, path: str | Sequence[str], bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two: at least the session's shuffle partitions, and enough for the files below the path or paths."""
    size = sum(Folder(spark, p).size() for p in ([path] if isinstance(path, str) else path))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    return min(1 << max(0, least - 1).bit_length(), MOST_BUCKETS)


def bucketed(spark: SparkSession, path: str, build: Callable[[], DataFrame], keys: Sequence[str], buckets: int,
             placed: bool = False) -> DataFrame:
    """The table at ``path`` in ``buckets`` files by ``keys``, sorted by them; built unless a complete copy is there.
    ``placed``: what ``build`` returns lies in these buckets already and is not exchanged."""
    keys, path = list(keys), f"{path}-{buckets}"

    def write(df: DataFrame, place: str) -> None:
        own = f"layout_{uuid.uuid4().hex}"
        ((df if placed else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
         .option("path", place).saveAsTable(own))
        spark.sql(f"DROP TABLE {own}")  # the files stay: the table is external

    rows = build()
    cache_or_compute(spark, path, lambda: rows, write=write, schema=rows.schema)  # no rows: no files
    name = f"layout_{hashlib.sha1(path.encode()).hexdigest()[:20]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def month_slice(date: str, slices: int = SLICES) -> Column:
    """Slice of a row by its month; rows without a date are slice 0."""
    return F.coalesce(F.pmod(F.year(date) * 12 + F.month(date), F.lit(slices)), F.lit(0)).cast("int")


def by_account_slice(fact: DataFrame, date: str = "reportingdate", slices: int = SLICES) -> DataFrame:
    return fact.withColumn(SLICE, month_slice(date, slices))


def in_every_slice(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """Each row once per slice, so that it meets its account's rows in whichever bucket they are."""
    return rows.withColumn(SLICE, F.explode(F.array([F.lit(i) for i in range(slices)])))
