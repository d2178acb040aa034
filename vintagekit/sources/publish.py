"""Two-phase publication of partition folders with the Hadoop file system (SNK1, SRC6).

A table is a folder of ``<key>=<value>`` folders. New partitions are written beside them, under ``_staging/<run>``, which
no reader lists. Publishing one value is two renames: the folder in place moves to ``_old/<run>``, the staged one takes
its place; then the old one is deleted. Until the second rename the old folder counts as the value's folder, so a reader
always finds exactly one of the two, whichever step a writer died at. ``recover`` brings a table back to plain folders: it
ends a publication whose new folder is in place, undoes one whose new folder is not, and removes what else a dead writer left
(staged folders, ``<key>=<value>__tmp``). One writer at a time; a rename must be atomic, as on HDFS and local disks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

TMP = "__tmp"


class Folder:
    """Names, existence, renames and deletions below one table folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.root = path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.at(*parts)))

    def folders(self, *parts: str) -> list[str]:
        """Names of the folders directly below, sorted; none if there is no such place."""
        if not self.exists(*parts):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.at(*parts))) if f.isDirectory())

    def has_files(self, *parts: str) -> bool:
        return any(f.isFile() and f.getLen() and f.getPath().getName()[:1] not in "_." for f in self._fs.listStatus(self._path(self.at(*parts))))

    def size(self, *parts: str) -> int:
        """Bytes of all files below; 0 if there is no such place."""
        return self._fs.getContentSummary(self._path(self.at(*parts))).getLength() if self.exists(*parts) else 0

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, *parts: str) -> None:
        self._fs.delete(self._path(self.at(*parts)), True)


def partition_folders(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """Folder by value, from names alone: the one in place, or while a value is being published the one moved aside."""
    f, start = Folder(spark, path), f"{key}="
    out = {}
    for where in [[], *(["_old", run] for run in f.folders("_old"))]:
        for name in f.folders(*where):
            value = name.removeprefix(start)
            if name.startswith(start) and not name.endswith(TMP) and value not in out and f.has_files(*where, name):
                out[value] = f.at(*where, name)
    return dict(sorted(out.items()))


def recover(spark: SparkSession, path: str, key: str) -> None:
    """Plain folders again, whatever step the last writer died at."""
    f, start = Folder(spark, path), f"{key}="
    for run in f.folders("_old"):
        for name in f.folders("_old", run):
            if not f.exists(name):
                f.move(f.at("_old", run, name), f.at(name))
    for left in ("_old", "_staging", *(n for n in f.folders() if n.startswith(start) and n.endswith(TMP))):
        if f.exists(left):
            f.remove(left)


def publish(spark: SparkSession, path: str, key: str, run: str, staged: dict[str, str], values: Iterable[str],
            on_step: Callable[[str, str], None] = lambda step, value: None) -> None:
    """Put the staged folder of each value in place. ``on_step`` hears of each step: moved, published."""
    f = Folder(spark, path)
    for value in values:
        name = f"{key}={value}"
        if f.exists(name):
            f.move(f.at(name), f.at("_old", run, name))
            on_step("moved", value)
        f.move(staged[value], f.at(name))
        on_step("published", value)
        f.remove("_old", run, name)
    f.remove("_old")
    f.remove("_staging", run)
    spark.catalog.refreshByPath(path)
