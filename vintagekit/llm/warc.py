"""WARC archives with a two-level capture index.

Writing. Pages with equal payloads of at least ``LEAST`` bytes share one response record (the largest
page id), the others are revisit records that name it. Each task appends records, one gzip member
each, to archive files of about ``ARCHIVE`` bytes in the shared folder; file names are unique per attempt,
and only the rows that a successful attempt returns name files, so a lost or repeated task leaves
no record twice.

Index. The captures (reversed-host key, page id, file, offset, length) are range-sorted; each task writes its
range as gzip blocks of ``LINES`` lines in one shard file, and a sparse directory beside it with the first
(key, page id) and place of each block. A search bisects the shards' firsts, then one shard's directory, reads one block
by its byte range, bisects its lines and reads the record by its byte range.

Reading back searches the index for the (key, page id) of every page. The wanted pairs are range-sorted, so a hot
address is spread by page ids and each task meets shards and blocks in order (one directory and one block are held). Every task
gets the shards' firsts, one short row per shard of the index. The places found are dealt by file and stretch, in as many tasks as
the bytes ask for (``READ`` each), and each task reads its byte ranges in order.

Cases: a null html is an empty payload; a null url is an empty target; a null page id is kept as null
(and is never referred to); rows that repeat a page id are records of their own (all rows
with the largest id of a group are responses); an empty table gives an empty table; a payload is held
whole, one at a time; only page_id, url and html are read. A record whose bytes do not match
its digest raises.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from vintagekit.llm.common import stage
from vintagekit.session import checkpoint_dir

LEAST, ARCHIVE, LINES, READ = 1000, 64 << 20, 1000, 128 << 20
DATE = "1970-01-01T00:00:00Z"
_ENTRY = "key string, page_id long, path string, offset long, length long"
_SHARD = "shard string, first string, first_id long, blocks long, lines long"


def surt(url: str | None) -> str:
    """Reversed-host sort key: ``http://www.a.org:80/x?y#z`` is ``org,a,www)/x?y``."""
    text = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url or "")
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # not an address: kept as it is
        return text
    if not host:
        return text
    default = {"http": 80, "https": 443}.get(parts.scheme)
    tail = f":{port}" if port and port != default else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


@lru_cache(maxsize=8)
def _system(root: str):
    return pafs.FileSystem.from_uri(root)


def _open(path: str):
    system, local = _system(path)
    return system.open_input_file(local)


def _create(path: str):
    system, local = pafs.FileSystem.from_uri(path)
    system.create_dir(local.rpartition("/")[0], recursive=True)
    return system.open_output_stream(local, compression=None)


# --- records ----------------------------------------------------------------------------------

def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, kind: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(member: bytes) -> dict:
    """The record of one gzip member: its headers (lower-case names), HTTP length and payload."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload-length"] = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    return fields


def _page_id(urn: str) -> int | None:
    value = urn[len("<urn:page:"):-1]
    return None if value == "none" else int(value)


# --- writing ----------------------------------------------------------------------------------

def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, size, sha1, kind, refers_to. Only digests that several pages share are joined back."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).alias("size"), F.sha1(payload).alias("sha1"))
    shared = stage(narrow.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("of"), F.count("*").alias("n"))
                   .where("n > 1 and of is not null").select("sha1", "of"), "shared-payloads")
    out = rows.join(shared, "sha1", "left")
    other = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    return out.select("page_id", "url", F.when(other, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "sha1",
                      F.when(other, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
                      F.when(other, F.col("of")).alias("refers_to"))


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    names = ("key", "page_id", "path", "offset", "length")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _writer(folder: str, archive: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at, rows = None, "", 0, []
        for batch in batches:
            for page_id, url, payload, size, sha1, kind, refers_to in zip(*(c for c in batch.columns)):
                if out is None:
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = _create(path)
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), size.as_py(), sha1.as_py(), refers_to.as_py(), kind.as_py())
                out.write(member)
                rows.append((surt(url.as_py()), page_id.as_py(), path, at, len(member)))
                at += len(member)
                if at >= archive:
                    out.close()
                    yield _entries(rows)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield _entries(rows)

    return write


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Write the archives; captures (key, page_id, path, offset, length)."""
    return stage(decided(pages).mapInArrow(_writer(folder, archive), _ENTRY), "captures")


# --- index ------------------------------------------------------------------------------------

def _line(key, page_id, path, offset, length) -> str:
    return f"{key}\t{'' if page_id is None else page_id}\t{path}\t{offset}\t{length}"


def _indexer(folder: str, lines: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, at, directory, block, total = f"{folder}/{uuid.uuid4().hex}.idx.gz", None, 0, [], [], 0

        def flush() -> None:
            nonlocal at
            member = gzip.compress("\n".join(block).encode(), compresslevel=6, mtime=0)
            out.write(member)
            directory.append("\t".join(block[0].split("\t")[:2]) + f"\t{at}\t{len(member)}")
            at += len(member)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or _create(shard)
                block.append(_line(*row))
                total += 1
                if len(block) == lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with _create(shard + ".dir") as d:
            d.write("\n".join(directory).encode())
        key, page_id = directory[0].split("\t")[:2]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([key]), pa.array([int(page_id) if page_id else None], pa.int64()), pa.array([len(directory)]),
             pa.array([total])], ["shard", "first", "first_id", "blocks", "lines"])

    return index


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Range-sort the captures and write the shards; one row per shard (shard, first, first_id, blocks, lines)."""
    order = ["key", "page_id", "path", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.mapInArrow(_indexer(folder, lines), _SHARD), "shards")


#: What sorts before every page id, as Spark sorts a null.
_NONE = -(1 << 63) - 1


def _at(page_id) -> int:
    return _NONE if page_id is None or page_id == "" else int(page_id)


def firsts(shards: DataFrame) -> list[tuple[str, int, str]]:
    """(first key, first page id, shard) of all shards, sorted: one short row per shard."""
    return sorted((r["first"], _at(r["first_id"]), r["shard"]) for r in shards.collect())


@lru_cache(maxsize=4)
def _directory(shard: str) -> tuple[tuple[tuple[str, int], ...], tuple[tuple[int, int], ...]]:
    with _open(shard + ".dir") as f:
        rows = [r.split("\t") for r in f.read().decode().split("\n")]
    return tuple((r[0], _at(r[1])) for r in rows), tuple((int(r[2]), int(r[3])) for r in rows)


@lru_cache(maxsize=2)
def _block(shard: str, place: tuple[int, int]) -> tuple[tuple[str, int, str, int, int], ...]:
    """Lines of one block: key, page id (``_NONE`` for null), path, offset, length."""
    with _open(shard) as f:
        f.seek(place[0])
        rows = [r.split("\t") for r in zlib.decompress(f.read(place[1]), wbits=31).decode().split("\n")]
    return tuple((r[0], _at(r[1]), r[2], int(r[3]), int(r[4])) for r in rows)


def _lines(shards: list[tuple[str, int, str]], low: tuple[str, int], high: tuple[str, int]) -> Iterator[tuple]:
    """Lines between two (key, page id) pairs, both included."""
    s = max(0, bisect.bisect_left(shards, low) - 1)
    while s < len(shards) and shards[s][:2] <= high:
        heads, places = _directory(shards[s][2])
        b = max(0, bisect.bisect_left(heads, low) - 1)
        while b < len(heads) and heads[b] <= high:
            rows = _block(shards[s][2], places[b])
            at = bisect.bisect_left(rows, low)
            while at < len(rows) and rows[at][:2] <= high:
                yield rows[at]
                at += 1
            b += 1
        s += 1


def find(shards: list[tuple[str, int, str]], url: str) -> list[tuple[str, int, int]]:
    """Places (path, offset, length) of all captures of an address. ``shards``: as :func:`firsts` gives them."""
    key = surt(url)
    return [line[2:] for line in _lines(shards, (key, _NONE), (key, 1 << 63))]


def wanted(pages: DataFrame) -> DataFrame:
    """Distinct (key, page_id) of the pages."""
    @arrow_udf(T.StringType())
    def keys(urls: pa.Array) -> pa.Array:
        return pa.array([surt(u.as_py()) for u in urls], pa.string())

    return pages.select(keys(F.col("url").cast("string")).alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()


def search(shards: DataFrame, pairs: DataFrame) -> DataFrame:
    """Captures (key, page_id, path, offset, length) of the wanted (key, page_id) pairs, found through the index."""
    shared = shards.sparkSession.sparkContext.broadcast(firsts(shards))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                pair = (key, _at(page_id))
                found += [(key, page_id, *line[2:]) for line in _lines(shared.value, pair, pair)]
            yield _entries(found)

    ranged = pairs.select("key", "page_id").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInArrow(look_up, _ENTRY)


# --- reading ----------------------------------------------------------------------------------

def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    path, f = None, None
    for batch in batches:
        rows = []
        for where, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if where != path:
                if f is not None:
                    f.close()
                path, f = where, _open(where)
            f.seek(offset)
            r = parse(f.read(length))
            digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
            size = r["payload-length"]
            if r["warc-type"] == "response" and (len(r["payload"]) != size or hashlib.sha1(r["payload"]).hexdigest() != digest):
                raise ValueError(f"{where} at {offset}: the payload does not match its digest")
            rows.append((_page_id(r["warc-record-id"]), r["warc-target-uri"], size, digest, r["warc-type"],
                         _page_id(r["warc-refers-to"]) if "warc-refers-to" in r else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    if f is not None:
        f.close()


def read_archives(captures: DataFrame, read: int = READ) -> DataFrame:
    """The records at the places of ``captures`` (path, offset, length): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to."""
    places = stage(captures.select("path", "offset", "length"), "places")
    size = places.agg(F.sum("length")).first()[0] or 0
    # stretches of at most ``read`` bytes, more and smaller ones while there are fewer than tasks to run
    tasks = max(1, math.ceil(size / read), min(2 * places.sparkSession.sparkContext.defaultParallelism, math.ceil(size / (1 << 20))))
    dealt = places.repartition(tasks, "path", F.floor(F.col("offset") / F.lit(1 << 20))).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write archives and index of ``pages``; (captures, shards)."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc/{uuid.uuid4().hex}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    captures = write_archives(pages, folder + "/archives")
    return captures, write_index(captures, folder + "/index")


def warc_report(pages: DataFrame) -> DataFrame:
    """Per page, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    _, shards = archive(pages)
    return read_archives(search(shards, wanted(pages))).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS top FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM r
"""
