"""SRC5 cache-or-compute: reuse a staged Parquet copy unless it is missing,
incomplete (no ``_SUCCESS``), lacks required columns, is empty where that is not allowed, or its source changed.

Staged tables live under the session's checkpoint directory (on a cluster the
shared folder named by ``spark.checkpoint.dir``), so a lost executor never
loses them and later jobs read them instead of recomputing the lineage.
A copy's name holds the fingerprint of its source: the path, length and time of every file, and the build's parameters.
A copy is written beside its place and moved in by one rename, so builders that work at once never mix their files: the
first to finish is kept and read by all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vintagekit.session import checkpoint_dir
from vintagekit.sources.publish import Folder


def stage_path(spark: SparkSession, name: str, *parts: str) -> str:
    digest = hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark).rstrip('/')}/stage/{name}-{digest}"


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """Digest of the files at or below the paths: names, lengths and times, from listings alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in sorted(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            seen.append(f"{p} missing")
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName()[:1] not in "_.":
                seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def source_path(spark: SparkSession, name: str, sources: Iterable[str], *params: str) -> str:
    """Where the copy of a build over these source paths is: another place once a file or a parameter changes."""
    return stage_path(spark, name, fingerprint(spark, sources), *params)


def _read(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def _complete(spark: SparkSession, path: str, required: Iterable[str], allow_empty: bool = True, schema: StructType | None = None) -> DataFrame | None:
    try:
        spark.read.text(f"{path}/_SUCCESS")
        df = _read(spark, path, schema)
    except AnalysisException as e:  # only a missing path means "not staged"; anything else is raised
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if not set(required).issubset(df.columns) or not (allow_empty or not df.isEmpty()):
        return None
    return df


def cache_or_compute(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                     required: Iterable[str] = (), refresh: bool = False,
                     sort_within: Iterable[str] = (), allow_empty: bool = True,
                     write: Callable[[DataFrame, str], None] = lambda df, place: df.write.parquet(place),
                     schema: StructType | None = None) -> DataFrame:
    """Read ``path`` when it is complete; else compute beside it, move the copy in and read it. ``write`` puts the files
    of the copy in a folder; ``schema`` is needed where it may put none there."""
    required = list(required)
    if not refresh:
        df = _complete(spark, path, required, allow_empty, schema)
        if df is not None:
            return df
    out = build()
    sort_within = list(sort_within)
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    parent, _, name = path.rpartition("/")
    own = f"{name}.{uuid.uuid4().hex}"
    write(out, f"{parent}/{own}")
    folder = Folder(spark, parent)
    if folder.exists(name):
        if not refresh and _complete(spark, path, required, allow_empty, schema) is not None:  # another builder was faster
            folder.remove(own)
            return _read(spark, path, schema)
        folder.remove(name)
    try:
        folder.move(f"{parent}/{own}", path)
        if folder.exists(name, own):  # some file systems move into a folder that came up meanwhile
            folder.remove(name, own)
    except OSError:
        if _complete(spark, path, required, allow_empty, schema) is None:
            raise
        folder.remove(own)
    spark.catalog.refreshByPath(path)
    return _read(spark, path, schema)
