"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed (XXH64), consecutive ``K`` word hashes are one k-gram, and in every window of
``WINDOW - K + 1`` consecutive k-grams the smallest one is kept (ties: the rightmost). Two texts that
share 13 consecutive words share all k-grams of that span, so they keep the same one: joining the kept
fingerprints of documents and benchmark meets every such span. Each meeting is extended: the up
to nine 13-word windows that hold the fingerprint are compared with the benchmark's windows, and
the words inside matching windows are hit.

Items of fewer than 13 words are one window each. Winnowing has no guarantee for those, so the
documents' spans of just these lengths are compared with them directly: by a literal set of at
most ``SHORT_SET`` hashes, beyond that by a join.

Everything that meets is keyed by (doc_id, hash of text); rows with equal keys are copies and get
equal results. The benchmark side is broadcast only if its counted rows are at most
``BROADCAST_ROWS``; beyond that Spark joins by shuffle (AQE splits skewed keys). A k-gram that many
documents share costs one row per document and place; rows that meet are reduced to distinct
windows before items are looked up, and items of equal words are one class.

Cases: null has no words (0, 0, 0, hash of the empty string, false); an empty text likewise; an empty
benchmark hits nothing; repeated rows repeat; a null item_id hits words but is not listed or
counted among items; very long texts are processed whole, memory follows the longest text;
columns other than id and text are not read by :func:`contamination`, and
:func:`drop_contaminated` returns all columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.llm.common import NON_WORD, ascii_lower, let, stage

WINDOW, K = 13, 5
BROADCAST_ROWS = 1_000_000
SHORT_SET = 10_000
#: A document is contaminated when hit words are at least one in so many.
RATIO = 20
_POS = 0x7FFFFFFF


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NON_WORD), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _gram(h: Column, at: Column, k: int) -> Column:
    """Hash of the k word hashes from the 0-based position ``at``."""
    return F.xxhash64(*[F.get(h, at + i) for i in range(k)])


def _starts(h: Column, k: int) -> Column:
    """0-based starts of the spans of k words; empty if there are fewer words."""
    n = F.size(h)
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def _least_with_next(step: int) -> Callable[[Column], Column]:
    def body(a: Column) -> Column:
        shifted = F.slice(a, F.lit(1 + step), F.greatest(F.size(a) - step, F.lit(0)))
        return F.zip_with(a, shifted, lambda x, y: F.least(x, y))
    return body


def _spans_of(h: Column, m: int) -> Column:
    return F.transform(_starts(h, m), lambda i: F.struct(
        i.alias("at"), F.lit(m).alias("len"), F.xxhash64(F.lit(m), F.slice(h, i + 1, m)).alias("win")))


def _among(spans: Column, known: list[int]) -> Column:
    return F.filter(spans, lambda s: s["win"].isin(known))


def kept_starts(h: Column, k: int = K, window: int = WINDOW) -> Column:
    """Winnowing: the distinct 0-based starts of the k-grams kept over all windows of the text.
    A k-gram's order is 32 bits of its hash, then its position from the right, in one long."""
    order = F.transform(_starts(h, k), lambda i: F.shiftleft(_gram(h, i, k).bitwiseAND(F.lit(0xFFFFFFFF)), 31)
                        .bitwiseOR(F.lit(_POS) - i))
    low, have, need = order, 1, window - k + 1
    while have < need:  # running minima of 2, 4, 8, ... neighbours; least() skips the padding nulls
        step = min(have, need - have)
        low = let(low, _least_with_next(step))
        have += step
    full = F.slice(low, F.lit(1), F.greatest(F.size(h) - window + 1, F.lit(0)))
    return F.transform(F.array_distinct(full), lambda m: (F.lit(_POS) - m.bitwiseAND(F.lit(_POS))).cast("int"))


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = _hits(docs, benchmark).drop("n_words")
    out = docs.select("doc_id", F.xxhash64("text").alias("k_text"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = (out.join(hits, out["doc_id"].eqNullSafe(hits["k_id"]) & (out["k_text"] == hits["k_hash"]), "left")
           .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                   F.coalesce("n_items", F.lit(0)).alias("n_items"),
                   F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256")))
    return out.withColumn("contaminated", _rule(F.col("n_hit"), F.col("n_words")))


def _rule(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (F.lit(RATIO) * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns as they are."""
    hits = _hits(docs, benchmark)
    bad = stage(hits.where(_rule(F.col("n_hit"), F.col("n_words"))).select("k_id", "k_hash"), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k_id"]) & (F.xxhash64(docs["text"]) == bad["k_hash"]), "left_anti")


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k_id, k_hash, n_words, n_hit, n_items, items_sha256) of the documents with a hit."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_hashes(F.col("text")).alias("h"))
    # items of equal words are one class with a list of its ids
    classes = stage(items.where(F.size("h") > 0).groupBy("h").agg(F.array_sort(F.collect_set("item")).alias("ids"))
                    .withColumn("cls", F.xxhash64("h")), "benchmark")
    long_, short = classes.where(F.size("h") >= WINDOW), classes.where(F.size("h") < WINDOW)
    h = F.col("h")
    windows = stage(long_.select("cls", F.explode(F.transform(_starts(h, WINDOW), lambda i: _gram(h, i, WINDOW))).alias("win"))
                    .unionByName(short.select("cls", F.xxhash64(F.size(h), h).alias("win"))).distinct(), "windows")
    prints = stage(long_.select(F.explode(F.transform(kept_starts(h), lambda i: _gram(h, i, K))).alias("gram")).distinct(), "prints")
    n_prints, n_windows = prints.count(), windows.count()

    doc = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_hash"), word_hashes(F.col("text")).alias("h"))
    doc = doc.withColumn("n_words", F.size("h").cast("long"))
    reach = WINDOW - K
    near = F.transform(kept_starts(h), lambda p: F.struct(
        _gram(h, p, K).alias("gram"), F.greatest(p - reach, F.lit(0)).alias("at"),
        F.slice(h, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)) + WINDOW).alias("span")))
    near = doc.select("k_id", "k_hash", "n_words", F.explode(near).alias("s")).select("k_id", "k_hash", "n_words", "s.*")
    met = near.join(_hinted(prints, n_prints), "gram")
    span = F.col("span")
    met = met.select("k_id", "k_hash", "n_words", F.explode(F.transform(_starts(span, WINDOW), lambda i: F.struct(
        (F.col("at") + i).alias("at"), F.lit(WINDOW).alias("len"), _gram(span, i, WINDOW).alias("win")))).alias("s")).select("k_id", "k_hash", "n_words", "s.*")
    lengths = [r[0] for r in short.select(F.size("h")).distinct().collect()]  # 1 to 12
    for m in sorted(lengths):
        exact = short.where(F.size("h") == m).select(F.xxhash64(F.size(h), h).alias("win"))
        known = [r[0] for r in exact.limit(SHORT_SET + 1).collect()]
        spans = _spans_of(h, m)
        if len(known) <= SHORT_SET:
            spans = _among(spans, known)
        met = met.unionByName(doc.select("k_id", "k_hash", "n_words", F.explode(spans).alias("s")).select("k_id", "k_hash", "n_words", "s.*"))
    found = met.distinct().join(_hinted(windows.select("win").distinct(), n_windows), "win", "left_semi")
    found = stage(found, "hits")
    hit = (found.select("k_id", "k_hash", "n_words", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("w"))
           .distinct().groupBy("k_id", "k_hash", "n_words").agg(F.count("*").alias("n_hit")))
    by_class = (found.select("k_id", "k_hash", "win").distinct().join(_hinted(windows, n_windows), "win")
                .select("k_id", "k_hash", "cls").distinct())
    ids = classes.select("cls", "ids")
    listed = (by_class.join(_hinted(ids, n_windows), "cls").groupBy("k_id", "k_hash")
              .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
              .select(F.col("k_id").alias("i_id"), F.col("k_hash").alias("i_hash"), F.size("ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")))
    return (hit.join(listed, F.col("k_id").eqNullSafe(F.col("i_id")) & (F.col("k_hash") == F.col("i_hash")))
            .select("k_id", "k_hash", "n_words", "n_hit", "n_items", "items_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= m)),
hits AS (SELECT dw.rid, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
