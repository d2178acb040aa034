"""Source divergence audit: how far the word frequencies of a language's sources lie apart, from a K-squared quadtree
over the group-term count matrix.

A group is a (lang, source); a term is a run of A-Z, a-z and characters beyond ASCII, A-Z lowered. A language keeps the
terms that stand in at least ``MIN_DOCS`` of its documents. Each group, and each language as a whole, gives every kept
term p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)). All arithmetic is on integers.

Counting: a task counts its own rows and passes partial counts on whenever it holds many, so no word, source or language
travels once per occurrence. The matrix of a language is then dealt by hash into tiles of about ``TILE`` terms and
``ROWS`` groups by ``ROWS`` groups, so a task holds one tile at any size of the corpus. In a tile the K-squared tree is
one bitmap a level; every pair of groups goes down it together: a quadrant empty for both is left at once, since all its
columns cost the same |p0 - p0'| (p0: the value at count 0), and only columns where one of them counts something are
read. Spark adds up the tiles' sums, and all columns that no traversal reached are priced with one product.

Cases: null text, lang or source is ''; a text without terms counts as a document and makes its group known; a language
that keeps no term has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows count each;
ties rank by the UTF-8 order of the item; an empty table gives an empty table; very long texts are counted whole; only
text, lang and source are read, whatever other columns are called.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.llm.common import stage

MIN_DOCS, SCALE, ADD, TOP = 30, 1_000_000_000, 5, 50
TILE, ROWS = 1024, 128
FLUSH = 200_000
FRONT = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


# --- counts -----------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: (lang, source, term, occurrences, documents); the empty term stands for the group's documents."""
    held: defaultdict = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> pa.RecordBatch:
        rows = [(lang, source, w, n.get(w, 0), k) for (lang, source), (n, docs) in held.items() for w, k in docs.items()]
        held.clear()
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held[lang, source]
            size -= len(docs)
            words = terms(text)
            n.update(words)
            docs.update({b"", *words})
            size += len(docs)
            if size >= FLUSH:
                yield flush()
                size = 0
    yield flush()


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all rows; one row a group has the empty term and no occurrences."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       F.col("text").cast("binary").alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return partial.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str | Column, total: str, kept: str) -> Column:
    """p of a count: exact at any size, since products are decimals."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * ((F.col(n) if isinstance(n, str) else n) + ADD).cast("decimal(20,0)")
    whole = (F.col(total) + ADD * F.col(kept)).cast("decimal(20,0)")
    return F.call_function("div", wide, F.nullif(whole, F.lit(0).cast("decimal(20,0)"))) + 1


# --- tiles ------------------------------------------------------------------------------------

def tree(full: np.ndarray) -> list[np.ndarray]:
    """K-squared tree of a 0/1 matrix: one bitmap a level, leaves first; a bit says that its quadrant is not empty."""
    levels = [full]
    while max(levels[-1].shape) > 1:
        x = levels[-1]
        x = np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)))
        levels.append(x[0::2, 0::2] | x[1::2, 0::2] | x[0::2, 1::2] | x[1::2, 1::2])
    return levels


def compare(p: np.ndarray, levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows: the sum of |p - p'| over the columns where one of them is not 0, and how many those are.
    All pairs go down the tree together; a quadrant that is empty for both rows of a pair is left."""
    total, columns = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    step = max(1, FRONT // p.shape[1])
    for at in range(0, len(left), step):
        g, h = left[at:at + step], right[at:at + step]
        pair, col = np.arange(len(g)), np.zeros(len(g), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            bits = levels[k]
            some = bits[g[pair] >> k, col] | bits[h[pair] >> k, col]
            pair, col = pair[some], col[some]
            if k:
                pair, col = np.repeat(pair, 2), (col[:, None] * 2 + [0, 1]).ravel()
                there = col < levels[k - 1].shape[1]
                pair, col = pair[there], col[there]
        gap = np.abs(p[g[pair], col] - p[h[pair], col])
        np.add.at(total, at + pair, gap)
        columns[at:at + step] = np.bincount(pair, minlength=len(g))
    return total, columns


_SUMS = "lang string, source string, item string, gap long, columns long"


def _tile(key: tuple, cell: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
    """Sums of one tile: rows are the groups of two blocks, columns the terms that any of them uses."""
    if not len(cell):
        return pd.DataFrame({c: pd.Series(dtype=object) for c in ("lang", "source", "item", "gap", "columns")})
    group = group.drop_duplicates("source").sort_values("source", ignore_index=True)
    row = cell["source"].map(dict(zip(group["source"], range(len(group))))).to_numpy()
    col, names = pd.factorize(cell["term"])
    p = np.repeat(group["p0"].to_numpy(np.int64)[:, None], len(names), axis=1)
    full = np.zeros(p.shape, bool)
    p[row, col], full[row, col] = cell["p"].to_numpy(np.int64), True
    left, right = np.triu_indices(len(group), 1)
    block = group["block"].to_numpy()
    if key[2] != key[3]:  # pairs within a block have a tile of their own
        apart = block[left] != block[right]
        left, right = left[apart], right[apart]
    gap, columns = compare(p, tree(full), left, right)
    seen = columns > 0
    names = group["source"].to_numpy()
    return pd.DataFrame({"lang": key[0], "source": names[left[seen]], "item": names[right[seen]], "gap": gap[seen], "columns": columns[seen]})


def _dealt(rows: DataFrame, tile: Column) -> DataFrame:
    """Rows with the keys of all tiles they belong to: their tile of terms, and their block of groups beside each other one."""
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (rows.withColumns({"tile": tile, "block": block}).withColumn("_other", other)
            .withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE, block: int = ROWS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = stage(cells(docs), "divergence-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
    kept = kept.where(F.col("docs") >= min_docs).drop("docs")
    matrix = stage(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-matrix")
    langs = matrix.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = (counts.where("term = ''").select("lang", "source")
              .join(matrix.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(langs, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"),
        F.ceil(F.col("groups") / block).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / tile)).alias("tiles"))
    groups = groups.withColumn("total", F.coalesce("total", F.lit(0))).join(sizes, "lang").withColumn("p0", share(F.lit(0), "total", "v"))
    groups = stage(groups, "divergence-groups")  # its real size tells Spark whether to broadcast it
    valued = matrix.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    return _pairs(valued, groups).unionByName(_terms(valued, top))


def _terms(valued: DataFrame, top: int) -> DataFrame:
    over = valued.withColumn("value", F.col("p") - share("n_lang", "total_lang", "v")).where((F.col("n") > 0) & (F.col("value") > 0))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term")))
    return over.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(valued: DataFrame, groups: DataFrame) -> DataFrame:
    keys = ["lang", "tile", "lo", "hi"]
    cell = _dealt(valued.select("lang", "source", "term", "p", "blocks", "tiles"), F.pmod(F.xxhash64("term"), F.col("tiles")))
    rows = _dealt(groups.where("v > 0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sums = (cell.select(*keys, "source", "term", "p").groupBy(*keys)
            .cogroup(rows.select(*keys, "source", "block", "p0").groupBy(*keys)).applyInPandas(_tile, _SUMS))
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("gap").alias("gap"), F.sum("columns").alias("columns"))
    own = groups.select("lang", "source", "v", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0_item"))
    both = own.join(other, "lang").where(F.col("source") < F.col("item")).join(sums, ["lang", "source", "item"], "left")
    empty = (F.col("v") - F.coalesce("columns", F.lit(0))) * F.abs(F.col("p0") - F.col("p0_item"))  # columns no traversal read
    value = F.coalesce("gap", F.lit(0)) + F.coalesce(empty, F.lit(0))
    ways = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = both.select("lang", value.alias("value"), ways)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n_lang FROM o GROUP BY lang, term HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
cnt AS (SELECT o.lang, source, term, sum(n) AS n, any_value(n_lang) AS n_lang FROM o JOIN kept USING (lang, term) GROUP BY o.lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
        FROM g LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT tot.lang, tot.source, kept.term, coalesce(cnt.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (kept.n_lang + 5)) // (total_lang + 5 * v)::HUGEINT AS q
      FROM tot JOIN kept ON kept.lang = tot.lang JOIN langs ON langs.lang = tot.lang
      LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.term = kept.term),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""
