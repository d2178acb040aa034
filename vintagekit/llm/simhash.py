"""SimHash near-duplicates by anchor-point covering.

Fingerprints. A text's bytes are lower-cased (A-Z), split at white space into words and cut
into word shingles (repeats count); a bit of the 64-bit fingerprint is set if it is set in over
half of the shingles' XXH64 values. Fewer words than a shingle: the whole sequence; none: zero.

Links (3 or fewer differing bits). The 64 bits are two halves of 32. Two linked fingerprints
differ in at most one bit in one of the halves, so in each half points at distance 1 have to meet.
Per half the anchors are a covering code: the product of the perfect binary Golay code on 23 bits
(covering radius 3), the perfect Hamming code on 7 bits (radius 1) and the last 2 bits as they are
(radius 0), 2^18 anchors. A fingerprint goes to every anchor within the covering radius plus the
threshold, which for a product code means at most one bit beyond the radius in one factor:
10 anchors a half on average. If x and y differ in one bit at most, the anchor that covers x is
among the anchors of y, so they meet. Equal fingerprints are one point before they are replicated.

Per anchor the points are compared exactly over all 64 bits by a breadth-first search that takes
each reached point out of the remaining ones: a dense group of near copies costs about one pass
per hop, and only a spanning forest (fewer links than points) leaves the task, never all
pairs. Anchors with more than ``block`` points are cut into blocks; every pair of blocks is a group
of its own, so no task holds more than two blocks and no pair is missed.

Components of the forest links come from alternating large-star and small-star steps with a
written table after each.

Cases: a null or empty text has fingerprint zero and links like any other; repeated rows and equal
ids share a fingerprint point; a null id takes its component's smallest non-null id (null if
there is none); an empty table gives an empty table; only id and text are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from vintagekit.llm.common import stage

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BLOCK = 50_000


# --- fingerprints -----------------------------------------------------------------------------

def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    votes, n, join, digest = np.zeros(64, np.int64), len(words) - size + 1, b" ".join, xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        part = words[at:at + 65536 + size - 1]
        h = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(size)))], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


@arrow_udf(T.LongType())
def simhash64(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.array(out.view(np.int64))


# --- anchors ----------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _code(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The perfect cyclic code on 23 (Golay) or 7 (Hamming) bits, by syndrome: byte tables of the
    syndrome, the error to the covering codeword, and the steps from that codeword to the
    others at radius + 1 (-1: no more). Only points at the full radius have such others: the
    codewords of least weight that hold the whole error."""
    generator, data, radius = {23: (0b101011100011, 12, 3), 7: (0b1011, 4, 1)}[bits]
    words = np.zeros(1 << data, np.int64)
    for i in range(data):
        words[1 << i:2 << i] = words[:1 << i] ^ (generator << i)
    light = words[np.bitwise_count(words) == 2 * radius + 1]
    bit_syndrome, r, top = [], 1, 1 << (bits - data)
    for _ in range(24):
        bit_syndrome.append(r)
        r <<= 1
        if r & top:
            r ^= generator
    tables = np.zeros((3, 256), np.int64)
    for t in range(3):
        for b in range(8):
            tables[t] ^= np.where(np.arange(256) >> b & 1, bit_syndrome[8 * t + b], 0)
    error = np.full(top, -1, np.int64)
    more = np.full((top, (bits - radius) // (radius + 1)), -1, np.int64)
    level = [0]
    for weight in range(radius + 1):
        for e in level:
            s = int(tables[0][e & 255] ^ tables[1][e >> 8 & 255] ^ tables[2][e >> 16])
            error[s] = e
            if weight == radius:
                more[s] = light[light & e == e]
        level = sorted({e | 1 << b for e in level for b in range(bits) if not e >> b & 1})
    assert (error >= 0).all()  # perfect: the balls cover every point once
    return tables, error, more


def _covering(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The covering codeword of each point; (row, codeword) of those at radius + 1."""
    tables, error, more = _code(bits)
    s = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16]
    home = x ^ error[s]
    step = more[s]
    row, at = np.nonzero(step >= 0)
    return home, row, home[row] ^ step[row, at]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, anchor) for uint64 fingerprints; an anchor is half << 32 | the code word's bits."""
    rows, out = [], []
    own = np.arange(len(fp))
    for half in (0, 1):
        x = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        a, row_a, more_a = _covering(x & 0x7FFFFF, 23)
        b, row_b, more_b = _covering(x >> 23 & 0x7F, 7)
        c = x >> 30
        for r, a_, b_, c_ in ((own, a, b, c), (row_a, more_a, b[row_a], c[row_a]), (row_b, a[row_b], more_b, c[row_b]),
                              (own, a, b, c ^ 1), (own, a, b, c ^ 2)):
            rows.append(r)
            out.append((half << 32) | (c_ << 30) | (b_ << 23) | a_)
    return np.concatenate(rows), np.concatenate(out)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 50_000):
            part = fp[at:at + 50_000]
            rows, anchor = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[rows].view(np.int64))], ["anchor", "fp"])


def forest(points: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the graph that links points (uint64, distinct) at ``bits`` or fewer
    differing bits: (child, root) per point that is not the smallest of its component."""
    rest, child, root = np.sort(points), [], []
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            hit = np.bitwise_count(rest ^ todo.pop()) <= bits
            if hit.any():
                got, rest = rest[hit], rest[~hit]
                child.append(got)
                root.append(np.full(len(got), first))
                todo.extend(got)
    if not child:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(child), np.concatenate(root)


def _pairs_of_small(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of at most 16 rows: every row against the next 1 to 15 of its group."""
    left, right = [], []
    group = np.repeat(np.arange(len(starts)), sizes)
    for step in range(1, int(sizes.max(initial=1))):
        hit = (group[step:] == group[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= bits)
        at = np.flatnonzero(hit)
        left.append(fp[at + step])
        right.append(fp[at])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _linker(bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group columns, fp) sorted by group; a group may span batches."""
        kept: tuple[np.ndarray, np.ndarray] | None = None

        def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            small = np.repeat(sizes <= 16, sizes)
            pick = sizes <= 16
            a, b = _pairs_of_small(fp[small], starts[pick], sizes[pick], bits)
            found = [(a, b)]
            for s, n in zip(starts[~pick], sizes[~pick]):
                found.append(forest(np.unique(fp[s:s + n]), bits))
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1).astype(np.int64)
            fp = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            if kept is not None:
                key, fp = np.concatenate([kept[0], key]), np.concatenate([kept[1], fp])
            if not len(fp):
                continue
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            kept = key[cut:], fp[cut:]
            if cut:
                yield solve(key[:cut], fp[:cut])
        if kept is not None and len(kept[1]):
            yield solve(*kept)

    return link


def links(points: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Forest links (a, b) between distinct fingerprints ``fp`` at ``bits`` <= 3 differing bits."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the anchors cover distances up to 3")
    spread = points.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    spread = stage(spread, "replicas")
    big = (spread.groupBy("anchor").count().where(F.col("count") > block)
           .select("anchor", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")))
    big = stage(big, "big-anchors")
    plain = spread
    parts = None
    if big.limit(1).count():  # cut the anchors with too many points into blocks, pair the blocks
        plain = spread.join(big, "anchor", "left_anti")
        j = F.col("j")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        parts = (spread.join(big, "anchor").withColumn("own", own)
                 .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("anchor", F.least("own", j).alias("lo"), F.greatest("own", j).alias("hi"), "fp"))
    plain = plain.select("anchor", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    rows = plain if parts is None else plain.unionByName(parts)
    return (rows.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi")
            .mapInArrow(_linker(bits), "a long, b long").where("a <> b"))


# --- components -------------------------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reached.
    Alternating large-star and small-star; each round is a written table of at most as many links."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
                 .select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct())
        after = stage(small, "links")
        # done when every node has one parent and no parent has one itself
        open_ = after.groupBy("u").count().where("count > 1").limit(1).count() or after.join(
            after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        e = after
        if not open_:
            return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
    raise RuntimeError("components did not settle")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k_text, fp) per row, written once: the pass over the texts is the costly part."""
    return stage(docs.select("doc_id", F.xxhash64("text").alias("k_text"),
                             simhash64(F.col("text").cast("binary")).alias("fp")), "fingerprints")


def point_components(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp, first_id, root): each distinct fingerprint, its smallest id and its component's smallest point."""
    points = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    comp = components(links(points, bits, block))
    return points.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (long), component_id (smallest id reachable)."""
    return _classes(fingerprints(docs), bits, block).select("doc_id", "fp", "component_id")


def _classes(fps: DataFrame, bits: int, block: int) -> DataFrame:
    points = stage(point_components(fps, bits, block), "point-components")
    least = points.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(points.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """The documents, one row for each component: the one with the smallest (id, hash of text),
    ids before null. Repeated rows count as one. All columns stay."""
    rows = _classes(fingerprints(docs), bits, block)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("k_id"), F.col("k_text"))
    keep = (rows.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("size"))
            .select("k.k_id", "k.k_text"))
    keep = stage(keep, "kept")
    k_id, k_text = docs["doc_id"], F.xxhash64(docs["text"])
    kept = docs.join(keep, k_id.eqNullSafe(keep["k_id"]) & (k_text == keep["k_text"]), "left_semi")
    copies = rows.groupBy("doc_id", "k_text").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if copies else kept


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
