"""Quality classifier from weak labels.

One pass over the texts gives each document the votes of overlapping heuristic labellers (good, bad or
abstain) and a hashed feature vector of its word shapes. Expectation-maximisation over the counts of the
vote patterns (at most 3 ** 11 patterns, however many documents) estimates each labeller's hit rate on good
and on bad documents and the share of good ones, without labels. The posterior of a document's
votes is its label; a linear scorer (logistic regression over ``DIM`` hashed features) is
trained on posterior labels and decides: documents that score under ``KEEP`` are rejected.

The scorer is fitted on at most ``TRAIN_ROWS`` rows, those with the smallest hash of id and text (a documented
bound); votes, patterns and scores cover all documents.

Cases: null, empty and blank texts have no votes, no features and score 0 (rejected); very long texts are
read whole; repeated rows score alike; ties at the threshold are kept; an empty table gives an empty table
(there is nothing to fit); if no document is voted bad the scorer has only good labels and keeps; only
doc_id and text are read, and :func:`keep_good` returns all columns as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from vintagekit.llm.common import stage

DIM, TRAIN_ROWS, KEEP = 1024, 16_384, 0.5
#: Pseudo-counts of the fit, a fixed few votes that any real table outweighs: right votes of all votes on
#: good and on bad documents, and good documents of all.
ON_GOOD, ON_BAD, SHARE = (9, 10), (4, 10), (4, 5)
LABELLERS = ("symbols", "word_shapes", "capitals", "adjacent_repeats", "variety", "bare_marks", "sentences", "lines", "word_length", "shouts",
             "runs")
GOOD, BAD, ABSTAIN = 1, 0, 2

#: Letters to a or A, digits to 0, bytes of other scripts to a, white space and marks as they are.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_CLEAN = frozenset(a + b for a in (b"a", b"Aa", b"A", b"0", b"a-a", b"a'a", b"Aa-a", b"0.0", b"0,0", b"(a", b"\"a", b"\"Aa")
                   for b in (b"", b".", b",", b";", b":", b"?", b"!", b")", b"\""))
_MARKS = frozenset(b"*#$%&|^~=<>{}[]\\_@+")


def _vote(bad: bool, sure: bool = True) -> int:
    return ABSTAIN if not sure else BAD if bad else GOOD


def describe(text: bytes | None) -> tuple[list[int], dict[int, float]]:
    """Votes in the order of LABELLERS and the sparse feature vector of one text."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [ABSTAIN] * len(LABELLERS), {}
    raw = np.frombuffer(text.translate(_SHAPE), np.uint8)
    counts = np.bincount(raw, minlength=256)
    chars, letters = max(1, len(raw)), max(1, int(counts[65] + counts[97]))
    shapes = raw[np.concatenate([[True], raw[1:] != raw[:-1]])].tobytes().split()
    shape_counts = Counter(shapes)
    same_next = np.fromiter(map(eq, words, words[1:]), bool, n - 1)
    repeats = int(same_next.sum())
    runs = int((same_next[1:] & same_next[:-1]).sum()) / n  # words whose two neighbours are the same word
    marks = sum(int(counts[m]) for m in _MARKS) / chars
    clean = sum(c for s, c in shape_counts.items() if s in _CLEAN) / n
    bare = sum(c for s, c in shape_counts.items() if not (b"a" in s or b"A" in s or b"0" in s)) / n
    capitals = int(counts[65]) / letters
    top = max(Counter(words).values()) / n
    ends = int(counts[46] + counts[63] + counts[33]) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = 1 - len(set(lines)) / len(lines)
    mean = sum(map(len, words)) / n
    shouts = int(counts[33]) / n
    votes = [
        _vote(marks > 0.05),
        _vote(clean < 0.7, n >= 10),
        _vote(capitals > 0.4, letters >= 20),
        _vote(repeats / n > 0.15, n >= 5),
        _vote(top > 0.3 or len(set(words)) < 0.15 * min(n, 2000), n >= 20),
        _vote(bare > 0.1, n >= 5),
        _vote(ends < 0.005 or ends > 0.8, n >= 40),
        _vote(same > 0.6, len(lines) >= 4),
        _vote(not 2 <= mean <= 14, n >= 5),
        _vote(shouts > 0.3, n >= 5),
        _vote(runs > 0.1, n >= 5),
    ]
    features: dict[int, float] = {}

    def add(name: bytes, value: float) -> None:
        h = zlib.crc32(name)
        at = h % DIM
        features[at] = features.get(at, 0.0) + (value if h >> 16 & 1 else -value)

    for shape, c in shape_counts.items():
        add(b"shape " + shape[:12], c / n)
    for name, value in ((b"repeats", repeats / n), (b"capitals", capitals), (b"marks", marks), (b"top", top if n >= 20 else 0.0),
                        (b"bare", bare), (b"unclean", 1 - clean), (b"same lines", same if len(lines) >= 4 else 0.0), (b"shouts", shouts),
                        (b"runs", runs)):
        add(name, value)
        if value >= 0.05:  # and the step it is on, so that the linear scorer can bend
            add(name + b" %d" % min(10, int(value * 20)), 1.0)
    return votes, features


def pattern(votes: list[int]) -> int:
    out = 0
    for v in reversed(votes):
        out = out * 3 + v
    return out


@arrow_udf(T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("words", T.BooleanType()),
                         T.StructField("at", T.ArrayType(T.ShortType())), T.StructField("value", T.ArrayType(T.FloatType()))]))
def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("pattern", pa.int32()), ("words", pa.bool_()), ("at", pa.list_(pa.int16())), ("value", pa.list_(pa.float32()))])
    for texts in batches:
        rows = []
        for t in texts:
            votes, f = describe(t.as_py())
            rows.append({"pattern": pattern(votes), "words": bool(f), "at": list(f), "value": list(f.values())})
        yield pa.array(rows, kind)


# --- weak labels ------------------------------------------------------------------------------

class LabelModel:
    """Two hit rates per labeller and the share of good documents, by EM over vote patterns."""

    def __init__(self, patterns: dict[int, int], rounds: int = 100):
        m = len(LABELLERS)
        keys = np.array(sorted(patterns), np.int64)
        n = np.array([patterns[k] for k in keys], float)
        votes = keys[:, None] // 3 ** np.arange(m) % 3
        good, bad = votes == GOOD, votes == BAD
        # a document is first taken as bad as soon as a fifth of its votes say so
        q = np.where(bad.sum(1) * 5 >= np.maximum(1, (good | bad).sum(1)), 0.1, 0.95)
        for _ in range(rounds):
            wg, wb = n * q, n * (1 - q)
            self.share = (wg.sum() + SHARE[0]) / (n.sum() + SHARE[1])
            self.on_good = ((wg[:, None] * good).sum(0) + ON_GOOD[0]) / ((wg[:, None] * (good | bad)).sum(0) + ON_GOOD[1])
            self.on_bad = ((wb[:, None] * bad).sum(0) + ON_BAD[0]) / ((wb[:, None] * (good | bad)).sum(0) + ON_BAD[1])
            q = self.posterior(votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        good, bad = votes == GOOD, votes == BAD
        g = np.log(self.share) + (good * np.log(self.on_good) + bad * np.log1p(-self.on_good)).sum(1)
        b = np.log1p(-self.share) + (bad * np.log(self.on_bad) + good * np.log1p(-self.on_bad)).sum(1)
        return 1 / (1 + np.exp(np.clip(b - g, -500, 500)))

    def of_patterns(self, patterns: np.ndarray) -> np.ndarray:
        return self.posterior(patterns.astype(np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3)


def train(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the bias last) of a logistic scorer on soft labels, by Adam over the whole sample."""
    x = np.zeros((len(rows), DIM + 1), np.float32)
    x[:, DIM] = 1
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    y = labels.astype(np.float32)
    w, m, v = (np.zeros(DIM + 1, np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / max(1, len(y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(facts: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, np.ndarray]:
    """The label model over all of ``facts`` (k, pattern, words, at, value) and the scorer's weights."""
    seen = facts.where("words")
    patterns = {r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()}
    model = LabelModel(patterns)
    rows = seen.orderBy("k").limit(train_rows).select("pattern", "at", "value").toArrow().to_pydict()
    labels = model.of_patterns(np.array(rows["pattern"], np.int64))
    return model, train(list(zip(rows["at"], rows["value"])), labels)


def _facts(docs: DataFrame) -> DataFrame:
    f = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), described(F.col("text").cast("binary")).alias("f"))
    return stage(f.select("doc_id", "k", "f.*"), "quality-facts")


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = shared.value
        for batch in batches:
            patterns, words = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            at, value = batch.column(3), batch.column(4)
            sums = _dots(at, value, w)
            p = np.where(words, 1 / (1 + np.exp(-np.clip(sums, -30, 30))), 0.0)
            weak = np.where(words, model.of_patterns(patterns), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(p.astype(float)), pa.array(p >= KEEP)],
                                             ["doc_id", "weak_good", "score", "keep"])

    return score


def _dots(at: pa.ListArray, value: pa.ListArray, w: np.ndarray) -> np.ndarray:
    n = len(at)
    sizes = np.diff(at.offsets.to_numpy())
    flat = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    terms = w[flat].astype(float) * value.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(np.repeat(np.arange(n), sizes), weights=terms, minlength=n) + float(w[DIM])


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, weak_good (posterior of the labellers), score (of the scorer), keep."""
    facts = _facts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(facts))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return facts.select("doc_id", "pattern", "words", "at", "value").mapInArrow(
        _scored(shared), f"doc_id {kind}, weak_good double, score double, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, all columns as they are. The texts are described a second time
    where they lie, which is cheaper than moving them to their scores."""
    _, w = fit(_facts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(w)

    @arrow_udf(T.BooleanType())
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for texts in batches:
            out = []
            for t in texts:
                _, f = describe(t.as_py())
                s = float(w[DIM]) + sum(float(w[a]) * float(np.float32(x)) for a, x in f.items())
                out.append(bool(f) and 1 / (1 + np.exp(-np.clip(s, -30, 30))) >= KEEP)
            yield pa.array(out, pa.bool_())

    return docs.where(kept(F.col("text").cast("binary")))
