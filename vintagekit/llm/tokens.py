"""Token counts through a digest cache.

The cache is a table of (digest, n_tokens) under a folder named by the tokenizer's version: the digest of its file, its
library's version and the options. A text's digest is SHA-256 of its normalised content; the tokenizer reads every byte,
so normalising only makes null an empty text. A run joins the corpus's distinct digests with the stored counts, encodes
one text of each digest that is missing, appends the new counts and joins all rows with the counts.

Texts travel only for misses: few of them (``FEW``, so at most 32 bytes times that) are sent to the rows; otherwise equal
texts are dropped in each task before the one exchange by digest. A digest that stands for a thousandth of all rows or
more (at most ``HOT`` of them) is joined by broadcast, so copies of one text never meet in one task. Encoding itself
cuts texts where tokens cannot go on and keeps the counts of recent parts, ``KEEP`` at most.

Appending is the writer's commit: a failed run adds nothing, a lost executor's task is written once, and two runs that
add the same digest agree, since a digest is read once however often it is stored. A worker whose tokenizer file differs
from the driver's raises.

Cases: null text and empty text have 0 tokens and 0 bytes; special strings inside a text are what the library makes of
them; repeated rows and null ids keep their rows; an empty table gives an empty table and adds nothing; very long texts
are counted whole; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.llm import vocab
from vintagekit.llm.common import stage
from vintagekit.session import checkpoint_dir

LIMIT, FEW, HOT, KEEP = 1024, 100_000, 1000, 600_000
OPTIONS = "no special tokens added, special strings by default, whole texts"
SCHEMA = "digest binary, n_tokens long"


class Counter:
    """Tokens of texts; holds the counts of the parts seen lately in two halves, the older one let go when the newer is full."""

    def __init__(self, path: str, keep: int = KEEP):
        self.vocabulary = vocab.PieceBpe(path) if path.endswith(".model") else vocab.ByteBpe(path)
        self.cuts = isinstance(self.vocabulary, vocab.ByteBpe) and self.vocabulary.separable
        self.keep, self.new, self.old = keep // 2, {}, {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.vocabulary.encode(texts)]
        parts = [vocab.words(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.new) + len(wanted) > self.keep:
            self.old, self.new = self.new, {}
        wanted.difference_update(self.new)
        self.new.update((p, self.old[p]) for p in wanted.intersection(self.old))
        missing = list(wanted.difference(self.old))
        self.new.update(zip(missing, map(len, self.vocabulary.encode_words([vocab.spelled(p) for p in missing]))))
        n = self.new.__getitem__
        return [sum(map(n, x)) for x in parts]


_COUNTERS: dict[str, Counter] = {}


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _COUNTERS:
            if vocab.version(path, OPTIONS) != version:
                raise ValueError(f"{path} differs from the driver's")
            _COUNTERS.clear()
            _COUNTERS[version] = Counter(path)
        counter = _COUNTERS[version]
        for batch in batches:
            for at, n in vocab.slices(batch.column(1), 1 << 20):
                part = batch.slice(at, n)
                counts = counter.counts([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def _stored(spark: SparkSession, slot: str, there: bool = False) -> DataFrame:
    """(digest, n_tokens) of the cache, each digest once; empty if there is no cache yet, unless it must be there."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(slot)
    except AnalysisException as e:
        if there or e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; misses are added to ``cache``."""
    spark = docs.sparkSession
    version = vocab.version(tokenizer, OPTIONS)
    slot = f"{cache.rstrip('/')}/tokenizer={version}"
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = stage(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")), "token-digests")
    tally = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    tally = stage(tally.join(_stored(spark, slot), "digest", "left"), "token-tally")
    n, missing = tally.agg(F.sum("rows"), F.count_if(F.col("n_tokens").isNull())).first()
    if missing:
        texts, misses = docs.select(digest, text.alias("text")), tally.where("n_tokens is null").select("digest")
        if missing <= few:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
        texts.mapInArrow(_encoder(tokenizer, version), SCHEMA).write.mode("append").parquet(slot)
    known = _stored(spark, slot, there=bool(n)).join(tally.select("digest", "rows"), "digest")
    hot = known.where(F.col("rows") * HOT >= (n or 0)).select("digest", "n_tokens")  # at most HOT rows
    often = rows.join(F.broadcast(hot), "digest")
    seldom = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known.select("digest", "n_tokens"), "digest")
    return often.unionByName(seldom).select("doc_id", "n_bytes", "n_tokens")


def token_report(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Counts of every row and whether they exceed ``limit``. Without a cache folder the run starts an empty one."""
    cache = cache or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/llm/token-cache-{uuid.uuid4().hex}"
    out = token_counts(docs, tokenizer or vocab.vocabulary(vocab.BYTE_BPE), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
