"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.

A reads a space and the text, B the text (it adds the space itself). A task keeps everything in Arrow columns. Texts are
cut into parts at single spaces, where no token of either vocabulary can go on (``vocab`` checks that; otherwise, and for
texts with U+2581, a part is a whole text), and each part that is new to the task is aligned once: the lists of
ids are flattened with their parent indices, token lengths summed up within each part, and both sides' ends joined by
Acero on (part, end). A row of that join, in order, is one stretch of bytes covered by one A and one B token, hence one
link; a row with both sides ends a group. Parts are then taken by their numbers for each document.

A document keeps its distinct linked pairs of ids with their number of links. Their corpus counts (how many documents
hold the pair) start as Table.group_by counts of a task and are merged by Spark. Pairs with a ``HEAD``-th of all counts
or more (so at most HEAD) go to every task; links of other pairs are joined by shuffle, where no key is hot.

A worker holds one slice of texts (``SLICE`` bytes, at least a text) and its aligned parts (``PARTS``, ``PARTS_MB``); Arrow gives what
a slice took back to the system before the next one.

The results of a task are written to the shared folder once, so tokenizers run once and a lost executor costs its tasks.

Cases: null and empty texts, and texts whose joined token bytes differ from a space and the text for A or B, have zeros
and an empty groups_sha256; special strings are plain text; repeated rows (also of one id) count as documents of their
own; an id pair's highest count may be shared, then all sharing pairs are best; an empty table gives an empty table; very
long texts are aligned whole; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagekit.llm import vocab
from vintagekit.llm.common import stage

BITS = 20  # of an id: a document of a slice and two ids make one integer
ID = (1 << BITS) - 1
HEAD, SLICE, HELD, PARTS, PARTS_MB = 200_000, 1 << 20, 500_000, 400_000, 64
RUN = 1 << 20


# --- parts ------------------------------------------------------------------------------------

def _lists(ids: list[list[int]]) -> tuple[pa.Array, pa.Array]:
    """Flat ids of lists, and the list each is of."""
    nested = pa.array(ids, pa.list_(pa.int32()))
    return pc.list_flatten(nested), pc.list_parent_indices(nested)


def _starts(parent: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n lists from the sorted list numbers of their items."""
    return np.searchsorted(parent, np.arange(n + 1))


def _joined(offsets: np.ndarray, values: pa.Array, by: str | bytes) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.scalar(by, values.type))


def _spans(ids: list[list[int]], token_bytes: pa.Array, want: pa.Array, n: int) -> tuple[pa.Table, np.ndarray]:
    """(key, id) of all tokens, the key made of part and end; and which parts' joined bytes are as wanted."""
    flat, parent = _lists(ids)
    parent = parent.to_numpy()
    offsets = _starts(parent, n)
    spelled = token_bytes.take(flat)
    right = pc.equal(_joined(offsets, spelled, b""), want).to_numpy(zero_copy_only=False)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(spelled), pa.int64())).to_numpy()
    before = np.concatenate([[0], total])[offsets[:-1]]
    ends = total - before[parent]  # summed up within each part
    return pa.table({"key": (parent.astype(np.int64) << 32) | ends, "id": flat}), right


def align(texts: list[str], a: list[list[int]], b: list[list[int]], bytes_a: pa.Array, bytes_b: pa.Array) -> pa.Table:
    """One row a text: n_a, n_b, n_groups, right (the joined bytes are a space and the text), groups, links (a << BITS | b)."""
    n = len(texts)
    want = pa.array([b" " + t.encode() for t in texts], pa.binary())
    left, right_a = _spans(a, bytes_a, want, n)
    right, right_b = _spans(b, bytes_b, want, n)
    good = right_a & right_b
    left, right = (t.filter(pa.array(good[t["key"].to_numpy() >> 32])) for t in (left, right))
    both = left.rename_columns(["key", "a"]).join(right.rename_columns(["key", "b"]), "key", join_type="full outer", use_threads=False)
    both = both.sort_by("key").combine_chunks()
    key = both["key"].to_numpy()
    ends_a, ends_b = (pc.is_valid(both[c]).to_numpy() for c in ("a", "b"))
    part, shared = key >> 32, ends_a & ends_b
    cover = [pc.fill_null_backward(both[c]).to_numpy().astype(np.int64) for c in ("a", "b")]
    links = pa.array(cover[0] << BITS | cover[1])
    group = np.cumsum(shared) - shared  # the group that each stretch is of
    n_groups, group_part = int(shared.sum()), part[shared]
    sides = [_joined(_starts(group[ends], n_groups), pc.cast(pc.drop_null(both[c].combine_chunks()), pa.string()), ",")
             for c, ends in (("a", ends_a), ("b", ends_b))]
    groups = _joined(_starts(group_part, n), pc.binary_join_element_wise(*sides, "|"), ";")
    count = lambda where: pa.array(np.bincount(part[where], minlength=n).astype(np.int64))
    return pa.table({"n_a": count(ends_a), "n_b": count(ends_b), "n_groups": count(shared), "right": pa.array(good), "groups": groups,
                     "links": pa.ListArray.from_arrays(pa.array(_starts(part, n), pa.int32()), links)})


class Aligner:
    """Aligned parts of texts by number; parts met once only are let go when many are held."""

    def __init__(self, path_a: str, path_b: str, keep: int = PARTS):
        self.a, self.b, self.keep = vocab.ByteBpe(path_a, special_as_text=True), vocab.PieceBpe(path_b), keep
        self.bytes = [pa.array(v.token_bytes(), pa.binary()) for v in (self.a, self.b)]
        self.cuts = self.a.separable and self.b.separable
        self.number: dict[str, int] = {}
        self.table = align([], [], [], *self.bytes)
        self.met = np.zeros(0, np.int64)

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        return vocab.pieces(text) if self.cuts and "▁" not in text else [text]

    def numbers(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The parts' numbers in one row, after aligning the new ones, and the list that each is of."""
        wanted = set().union(*parts)
        if len(self.number) + len(wanted) > self.keep or self.table.nbytes > PARTS_MB << 20:
            self._shrink()
        new = list(wanted.difference(self.number))
        if new:
            rows = align(new, self.a.encode_words([" " + t for t in new]), self.b.encode(new), *self.bytes)
            self.table = pa.concat_tables([self.table, rows]).combine_chunks()
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        sizes = list(map(len, parts))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        return flat, np.repeat(np.arange(len(parts)), sizes)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > self.keep // 2 or self.table.nbytes > PARTS_MB << 20:
            keep = keep[:0]
        names = list(self.number)
        self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.table, self.met = self.table.take(pa.array(keep)).combine_chunks(), np.zeros(len(keep), np.int64)

    def _checked(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Numbers, their lists, and the lists with a part whose joined bytes are not its own."""
        flat, doc = self.numbers(parts)
        return flat, doc, np.unique(doc[~self.table["right"].to_numpy()[flat]]).tolist()

    def documents(self, texts: list[str | None]) -> pa.RecordBatch:
        """One row a text: its figures, and its linked pairs as lists a, b and m (their links)."""
        n = len(texts)
        parts = [self.parts(t) for t in texts]
        flat, doc, wrong = self._checked(parts)
        if wrong:
            for i in wrong:  # look at these texts whole
                parts[i] = [texts[i]]
            for i in self._checked(parts)[2]:
                parts[i] = []
            flat, doc = self.numbers(parts)
        self.met += np.bincount(flat, minlength=len(self.met))
        offsets = _starts(doc, n)
        total = lambda c: np.diff(np.concatenate([[0], np.cumsum(self.table[c].to_numpy()[flat])])[offsets])
        groups = _joined(offsets, self.table["groups"].combine_chunks().take(pa.array(flat)), ";")
        hashes = [hashlib.sha256(g.as_buffer()).hexdigest() if x else "" for g, x in zip(groups, parts)]
        code, times = np.unique(doc.astype(np.int64) << 32 | flat, return_counts=True)  # a part repeated in a text
        links = self.table["links"].combine_chunks().take(pa.array(code & 0xFFFFFFFF))
        at = pc.list_parent_indices(links).to_numpy()
        key = (code >> 32)[at] << 2 * BITS | pc.list_flatten(links).to_numpy()
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        m = np.add.reduceat(times[at][order], first) if len(first) else times[:0]
        key = key[order][first]
        bounds = pa.array(_starts(key >> 2 * BITS, n), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key >> BITS & ID, key & ID, m)]
        n_links = np.diff(np.concatenate([[0], np.cumsum(m)])[bounds.to_numpy()])
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (total("n_a"), total("n_b"), total("n_groups"), n_links)] + [pa.array(hashes, pa.string()), *lists],
            ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "m"])


_ALIGNERS: dict[tuple, Aligner] = {}
_DOCUMENT = ("doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "a array<int>, b array<int>, m array<int>")


def _align_texts(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        if (path_a, path_b) not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _ALIGNERS[path_a, path_b]
        for batch in batches:
            for at, n in vocab.slices(batch.column(1), SLICE):
                part = batch.slice(at, n)
                out = aligner.documents(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *out.columns], ["doc_id", *out.schema.names])
                del out
                pa.default_memory_pool().release_unused()

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The documents' own figures and linked pairs, written once, with a number of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_align_texts(path_a, path_b), _DOCUMENT.format(id=kind))
    return stage(rows.withColumn("rid", F.monotonically_increasing_id()), "aligned")


# --- corpus counts ----------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair of a task, passed on whenever many pairs are held."""
    pa.set_cpu_count(1)
    _ALIGNERS.clear()  # all texts are aligned by now
    pa.default_memory_pool().release_unused()
    held = pa.table({"link": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    def split() -> list[pa.RecordBatch]:
        link = held["link"].to_numpy()
        cols = pa.array((link >> BITS).astype(np.int32)), pa.array((link & ID).astype(np.int32)), held["n"]
        return pa.table(cols, ["a", "b", "n"]).to_batches()

    for batch in batches:
        link = pa.array(pc.list_flatten(batch.column(0)).to_numpy().astype(np.int64) << BITS | pc.list_flatten(batch.column(1)).to_numpy())
        more = pa.table({"link": link}).group_by("link", use_threads=False).aggregate([("link", "count")]).rename_columns(["link", "n"])
        held = pa.concat_tables([held, more]).group_by("link", use_threads=False).aggregate([("n", "sum")]).rename_columns(["link", "n"])
        if len(held) > HELD:
            yield from split()
            held = held.slice(0, 0)
    yield from split()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents the ids are linked, and whether no other pair of a is in more."""
    counts = rows.select("a", "b").mapInArrow(_count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = stage(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
    return stage(counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")


_LINKS = "rid long, a int, b int, m long, count_sum long, n_best long"


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``RUN`` pairs."""
    ends, at = pc.cumulative_sum(pc.list_value_length(batch.column("a")).cast(pa.int64())).to_numpy(), 0
    while at < len(ends):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")) - at)
        yield batch.slice(at, n)
        at += n


def _priced(shared):
    """Sums over the pairs that every task holds, as a row for each document whose ids are negative and match nothing;
    and a row for each other pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = shared.value
        links, n, best = pa.array(links), np.append(n, 0), np.append(best, 0)  # the last stands for pairs not held
        for batch in chain.from_iterable(map(_runs, batches)):
            rid = batch.column("rid").to_numpy()
            a, b, m = (pc.list_flatten(batch.column(c)).to_numpy().astype(np.int64) for c in "abm")
            doc = pc.list_parent_indices(batch.column("a")).to_numpy()
            at = pc.fill_null(pc.index_in(pa.array(a << BITS | b), links), len(links)).to_numpy()
            bounds = _starts(doc, len(rid))
            count_sum, n_best = (np.diff(np.concatenate([[0], np.cumsum(m * x[at])])[bounds]) for x in (n, best))
            rest = at == len(links)
            none = np.zeros(int(rest.sum()), np.int64)
            cols = {"rid": (rid, rid[doc[rest]]), "a": (-1 - rid % (1 << 30), a[rest]), "b": (np.full(len(rid), -1), b[rest]),
                    "m": (np.zeros(len(rid)), m[rest]), "count_sum": (count_sum, none), "n_best": (n_best, none)}
            kinds = [pa.int32() if c in "ab" else pa.int64() for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k.to_pandas_dtype())) for x, k in zip(cols.values(), kinds)], list(cols))

    return run


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = aligned(docs, path_a or vocab.vocabulary(vocab.BYTE_BPE), path_b or vocab.vocabulary(vocab.PIECE_BPE))
    counts = pair_counts(rows)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * head >= total  # at most ``head`` pairs
    table = counts.where(often).select((F.shiftleft(F.col("a").cast("long"), BITS) + F.col("b")).alias("link"), "n", "best").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (table["link"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy(zero_copy_only=False).astype(np.int64)))
    links = rows.select("rid", "a", "b", "m").mapInArrow(_priced(shared), _LINKS)
    rare = counts.where(~often).select("a", "b", "n", F.col("best").cast("int").alias("best"))
    sums = links.join(rare, ["a", "b"], "left").groupBy("rid").agg(
        F.sum(F.col("count_sum") + F.col("m") * F.coalesce("n", F.lit(0))).alias("count_sum"),
        F.sum(F.col("n_best") + F.col("m") * F.coalesce("best", F.lit(0))).alias("n_best"))
    return rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "rid").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
