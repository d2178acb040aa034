"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every vector becomes integers floor(256 * x). Candidates are packed into blocks of at most ``BLOCK`` rows (term
by term, ids ascending), queries into chunks of ``QUERIES`` rows, dealt into groups of about ``CHUNKS`` chunks. Each chunk
meets each candidate block once through an equality join on (block, group), so a task's share of the queries is bounded
however many there are; a block is copied once per group and a chunk once per block, which is as many rows of either
side. A meeting walks the terms: a query's non-zero
weight for a term is a posting that adds weight * term row to the query's dense score array; then the k
best of the block are selected by partition (ties: smaller id) and the blocks' winners are
merged by a ranked window per query. No task holds more than two blocks; work is the stated query set
times all rows, in blocks.

Cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no
part; shorter vectors count as zero where they end; rows that repeat an id are candidates and queries of their own (a
query leaves out its own row only); fewer than k candidates give fewer rows; an empty table gives an empty table;
components beyond a long are held at its limits, and sums are exact (float64 below 2^53, int64 below 2^62,
else Python integers held at a long's limits); only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.llm.common import stage

K, SCALE, BLOCK, QUERIES, CHUNKS = 5, 256.0, 16_384, 256, 64
_LOW = -(1 << 63)


def quantised(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q): integer vectors of the rows that take part."""
    x = F.col("x")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("q")))


def _packer(limit: int):
    def flush(ids: np.ndarray, row_ids: np.ndarray, rows: list, number: int) -> pa.RecordBatch:
        dim = max((len(r) for r in rows), default=0)
        m = np.zeros((dim, len(rows)), np.int64)
        order = np.argsort(ids, kind="stable")
        for j, i in enumerate(order):
            m[:len(rows[i]), j] = rows[i]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()),
             pa.array([row_ids[order].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["block", "dim", "ids", "row_ids", "m"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, row_id, q) of a partition as packed blocks, numbered by the partition."""
        number = TaskContext.get().partitionId()
        ids, row_ids, rows = [], [], []
        for batch in batches:
            q = batch.column(2)
            flat, off = q.values.to_numpy(zero_copy_only=False), q.offsets.to_numpy()
            ids += batch.column(0).to_pylist()
            row_ids += batch.column(1).to_pylist()
            rows += [flat[a:b] for a, b in zip(off[:-1], off[1:])]
            while len(rows) >= limit:
                yield flush(np.array(ids[:limit], np.int64), np.array(row_ids[:limit], np.int64), rows[:limit], number)
                ids, row_ids, rows = ids[limit:], row_ids[limit:], rows[limit:]
        if rows:
            yield flush(np.array(ids, np.int64), np.array(row_ids, np.int64), rows, number)

    return pack


def accumulate(queries: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Scores [query, candidate] of query rows [query, term] against term rows [term, candidate]."""
    dim = min(queries.shape[1], terms.shape[0])
    big = lambda a: max((abs(int(a.min(initial=0))), abs(int(a.max(initial=0)))))
    bound = dim * big(queries) * big(terms)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    q, c = queries.astype(kind), terms.astype(kind)
    scores = np.zeros((len(q), c.shape[1]), kind)
    for t in range(dim):
        hold = np.flatnonzero(queries[:, t])
        if len(hold) == len(q):
            scores += q[:, t, None] * c[t]
        elif len(hold):
            scores[hold] += q[hold, t, None] * c[t]
    if kind is object:
        scores = np.clip(scores, _LOW + 1, (1 << 63) - 1)
    return scores.astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of one row, ties to the smaller column; ``_LOW`` marks no candidate."""
    if len(scores) <= k:
        got = np.arange(len(scores))
    else:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        got = np.concatenate([above, np.flatnonzero(scores == kth)[:k - len(above)]])
    return got[scores[got] != _LOW]


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, row_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["row_ids"], np.int64)
                terms = np.frombuffer(r["m"], np.int64).reshape(r["dim"], len(ids))
                qids, qrows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_row_ids"], np.int64)
                rows = np.frombuffer(r["q_m"], np.int64).reshape(r["q_dim"], len(qids)).T
                out = ([], [], [], [])
                for at in range(0, len(qids), 64):
                    scores = accumulate(rows[at:at + 64], terms)
                    for row, qid, qrow in zip(scores, qids[at:at + 64], qrows[at:at + 64]):
                        lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right")
                        row[lo:hi][row_ids[lo:hi] == qrow] = _LOW
                        got = best(row, k)
                        out[0].append(np.full(len(got), qid))
                        out[1].append(np.full(len(got), qrow))
                        out[2].append(ids[got])
                        out[3].append(row[got])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "query_row", "vec_id", "score"])

    return search


def top_k(rows: DataFrame, query_ids, k: int = K, block: int = BLOCK, chunks: int = CHUNKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query row against all rows.
    ``query_ids``: condition on the column ``vec_id`` that picks the queries."""
    spark = rows.sparkSession
    # row numbers are written with the rows, so every later read sees the same ones
    vectors = stage(quantised(rows).select("vec_id", F.monotonically_increasing_id().alias("row_id"), "q"), "vectors")
    n, n_asked = vectors.agg(F.count("*"), F.count_if(query_ids)).first()
    # blocks of at most ``block`` rows, more and smaller ones while there are fewer than tasks to run
    parts = max(1, math.ceil(n / block), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    groups = max(1, math.ceil(n_asked / (QUERIES * chunks)))
    kind = "block long, dim int, ids binary, row_ids binary, m binary"
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    blocks = (vectors.repartition(parts).mapInArrow(_packer(block), kind)
              .select("block", every(groups).alias("part"), "dim", "ids", "row_ids", "m"))
    asked = vectors.where(query_ids).mapInArrow(_packer(QUERIES), kind)
    asked = asked.select(every(parts).alias("block"), F.pmod(F.xxhash64("row_ids"), F.lit(groups)).alias("part"), F.col("dim").alias("q_dim"),
                         F.col("ids").alias("q_ids"), F.col("row_ids").alias("q_row_ids"), F.col("m").alias("q_m"))
    found = blocks.join(asked, ["block", "part"]).select("dim", "ids", "row_ids", "m", "q_dim", "q_ids", "q_row_ids", "q_m")
    found = found.mapInArrow(_searcher(k), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k_report(embeddings: DataFrame) -> DataFrame:
    """Queries: ids divisible by 50."""
    return top_k(embeddings, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.row_id AS query_row, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_row ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
