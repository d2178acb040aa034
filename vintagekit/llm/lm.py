"""Log-bilinear language model trained with noise-contrastive estimation, beside an add-half unigram.

Tokens are the words of the lowered (A-Z) text and one end. Words belong to ``CLASSES`` classes: the end, the most
frequent words (a class each) and the rest by a hash of their last two bytes. The neural model
predicts a token's class from the two classes before it: each of them has a vector, each position a matrix, and
the sum is compared with the output vectors of all classes. It is trained in numpy with noise-contrastive
estimation on the class trigram counts of all training documents (at most CLASSES ** 3 counts come to the
driver, however large the corpus). Each of the ``STEPS`` passes takes the whole gradient: every trigram with its count,
and the noise in expectation instead of draws, so no token of the corpus is left out. Batched matrix products then
give the normalised log-probabilities of all classes after every pair of classes; a word within a class has its
add-half share of the class, each class keeping half a count for words never seen, so every step is a distribution
over words.

Word counts cover all training documents and grow with them. The ``HEAD`` most frequent words (a bound) go to the
tasks; all other words are counted per document and joined with their counts by shuffle, which
adds sum(log10(c + 0.5)) for both scores.

Cases: a null or empty text has the end token alone; a null id may be learned from; repeated rows score
alike; an empty table gives an empty table; without training documents N = V = 0 and the model is
uniform over classes; very long texts are scored whole; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.llm.common import stage

HEAD, TOP, RARE = 100_000, 63, 64
CLASSES = 1 + TOP + RARE
END = 0
DEPTH, NOISE, STEPS, RATE, SEED = 24, 8, 800, 0.02, 7
FLUSH = 200_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def rare_class(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word[-2:]) % RARE


# --- counts -----------------------------------------------------------------------------------

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts of a partition, passed on whenever many distinct words are held."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for t in batch.column(0):
            held.update(words(t.as_py()))
            if len(held) >= FLUSH:
                yield flush()
    if held:
        yield flush()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training documents, written once."""
    partial = training.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count_words, "word binary, n long")
    return stage(partial.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


class Head:
    """What every task holds: the frequent words with their counts and classes."""

    def __init__(self, rows: list[tuple[bytes, int]], mass: np.ndarray, ends: int, total: int, distinct: int):
        self.name = uuid.uuid4().hex
        self.words, self.counts = [w for w, _ in rows], np.array([c for _, c in rows], float)
        self.ends, self.total, self.distinct = ends, total, distinct
        cls = [1 + i if i < TOP else rare_class(w) for i, w in enumerate(self.words)]
        self.classes = np.array(cls, np.int64)
        self.mass = mass
        self.logs: np.ndarray | None = None  # log10 P(class | two classes), flat

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


_INDEX: dict[str, dict[bytes, int]] = {}


def _index(head: Head) -> dict[bytes, int]:
    if head.name not in _INDEX:
        _INDEX.clear()
        _INDEX[head.name] = head.index()
    return _INDEX[head.name]


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most HEAD words, the most frequent first: those from the lowest level of counts (sixteenths of an
    octave, so about a thousand levels at any size) at which no more than HEAD qualify. No task and no
    answer to the driver holds more, however many partitions there are."""
    level = F.floor(F.log2("c") * 16).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > HEAD:
            break
        least = r["level"]
    if least is None:
        return []
    rows = counts.where(level >= least).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def head_of(counts: DataFrame, ends: int) -> Head:
    """The frequent words, the totals and the add-half mass of each class of words."""
    top = frequent(counts)
    own = [w for w, _ in top[:TOP]]
    cls = F.crc32(F.substring("word", -2, 2)) % RARE
    rest = counts.where(~F.col("word").isin(own)) if own else counts
    mass = np.full(RARE, 0.5)
    for r in rest.groupBy(cls.alias("cls")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["cls"]] += r["c"] + 0.5 * r["n"]
    total = counts.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    return Head(top, mass, ends, (total["c"] or 0) + ends, total["n"] + (ends > 0))


def classes_of(tokens: list[bytes], index: dict[bytes, int], head: Head) -> tuple[np.ndarray, np.ndarray]:
    """(head index or -1, class) of each word."""
    at = np.fromiter((index.get(w, -1) for w in tokens), np.int64, len(tokens))
    cls = head.classes[at] if len(head.words) else np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero(at < 0).tolist():
        cls[i] = rare_class(tokens[i])
    return at, cls


def codes_of(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all tokens (words and end) of the texts, and how many each text has."""
    sizes = np.array([len(c) + 1 for c in classes])
    pad = np.zeros(2, np.int64)
    flat = np.concatenate([x for c in classes for x in (pad, c, pad[:1])])
    start = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    at = np.arange(sizes.sum()) + np.repeat(start + 2 - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return (flat[at - 2] * CLASSES + flat[at - 1]) * CLASSES + flat[at], sizes


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total < 1 << 21):
            total += len(texts[end] or b"")
            end += 1
        yield texts[at:end]
        at = end


def _trigrams(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        index, n = _index(head), np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            for part in _chunks(batch.column(0).to_pylist()):
                codes, _ = codes_of([classes_of(words(t), index, head)[1] for t in part])
                seen, times = np.unique(codes, return_counts=True)
                n[seen] += times
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000].astype(np.int32)), pa.array(n[at[i:i + 100_000]])], ["code", "n"])

    return count


def trigram_counts(training: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) over all training documents: at most CLASSES ** 3 rows come to the driver."""
    rows = (training.select(F.col("text").cast("binary").alias("text")).mapInArrow(_trigrams(shared), "code int, n long")
            .groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow())
    return rows["code"].to_numpy().astype(np.int64), rows["n"].to_numpy()


# --- model ------------------------------------------------------------------------------------

def train(codes: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation: tell each corpus token from NOISE tokens of the unigram of classes, by passes
    over all counted trigrams."""
    rng, real = np.random.default_rng(SEED), np.float32
    p = {"r": rng.normal(0, 0.1, (CLASSES, DEPTH)), "q": rng.normal(0, 0.1, (CLASSES, DEPTH)),
         "c": np.stack([np.eye(DEPTH)] * 2) * 0.5, "b": np.zeros(CLASSES)}
    if not len(codes):
        return p
    noise = np.bincount(codes % CLASSES, weights=counts, minlength=CLASSES) + 0.5
    noise /= noise.sum()
    p["b"] = np.log(noise)
    p = {k: v.astype(real) for k, v in p.items()}
    real_n = np.zeros(CLASSES ** 3)
    real_n[codes] = counts
    real_n = real_n.reshape(-1, CLASSES)  # pairs of classes before, class
    all_n = (real_n + real_n.sum(axis=1, keepdims=True) * (NOISE * noise)).astype(real)  # and the noise tokens expected beside them
    real_n, log_kn = real_n.astype(real), np.log(NOISE * noise).astype(real)
    m, v2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        hat = ((p["r"] @ p["c"][0])[:, None] + p["r"] @ p["c"][1]).reshape(-1, DEPTH)
        s = hat @ p["q"].T + (p["b"] - log_kn)
        slope = all_n / (1 + np.exp(-np.clip(s, -30, 30))) - real_n  # belief that the tokens are from the corpus, less those that are
        d_hat = (slope @ p["q"]).reshape(CLASSES, CLASSES, DEPTH)
        d1, d2 = d_hat.sum(axis=1), d_hat.sum(axis=0)
        grad = {"r": d1 @ p["c"][0].T + d2 @ p["c"][1].T, "q": slope.T @ hat, "b": slope.sum(0),
                "c": np.stack([p["r"].T @ d1, p["r"].T @ d2])}
        rate = RATE * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.999 * v2[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.999 ** t)) + 1e-8)
    return p


def log_probabilities(p: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | class, class) for all pairs of classes, flat by trigram code: one matrix product
    per first class, normalised over the classes."""
    a, b = p["r"] @ p["c"][0], p["r"] @ p["c"][1]
    out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
    for h1 in range(CLASSES):
        s = (a[h1] + b) @ p["q"].T + p["b"]
        s -= s.max(axis=1, keepdims=True)
        out[h1] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)
    return out.ravel()


# --- scoring ----------------------------------------------------------------------------------

_ROW = ("rid long, doc_id {id}, held_out boolean, n_tokens long, head_known long, base_head double, model_head double, "
        "tail array<struct<word:binary,n:int>>")


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        index = _index(head)
        log_c = np.log10(head.counts + 0.5)
        log_mass = np.log10(head.mass)
        base_end, known_end = np.log10(head.ends + 0.5), int(head.ends > 0)
        log_total = np.log10(head.total + 0.5 * (head.distinct + 1))
        tail_kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        kinds = {"n_tokens": pa.int64(), "head_known": pa.int64(), "base_head": pa.float64(), "model_head": pa.float64(), "tail": tail_kind}
        for batch in batches:
            done = 0
            for part in _chunks(batch.column(3).to_pylist()):
                cols = {k: [] for k in kinds}
                lists = [words(t) for t in part]
                found = [classes_of(x, index, head) for x in lists]
                codes, sizes = codes_of([c for _, c in found])
                steps = head.logs[codes].astype(float)
                ends = np.cumsum(sizes)
                for tokens, (at, cls), hi, n in zip(lists, found, ends, sizes):
                    known = at >= 0
                    logs = log_c[at[known]]
                    rare = cls > TOP
                    model = steps[hi - n:hi].sum() - log_mass[cls[rare] - 1 - TOP].sum() + log_c[at[known & rare]].sum()
                    cols["n_tokens"].append(int(n))
                    cols["head_known"].append(int(known.sum()) + known_end)
                    cols["base_head"].append(float(logs.sum() + base_end - n * log_total))
                    cols["model_head"].append(float(model))
                    tail = Counter(tokens[i] for i in np.flatnonzero(~known).tolist())
                    cols["tail"].append([{"word": w, "n": c} for w, c in tail.items()])
                own = [batch.column(i).slice(done, len(part)) for i in range(3)]
                done += len(part)
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(cols[k], t) for k, t in kinds.items())],
                                                 ["rid", "doc_id", "held_out", *kinds])

    return score


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    sc = docs.sparkSession.sparkContext
    training = docs.where(~held_out)
    ends = training.count()
    counts = word_counts(training)
    head = head_of(counts, ends)
    codes, times = trigram_counts(training, sc.broadcast(head))
    head.logs = log_probabilities(train(codes, times))
    shared = sc.broadcast(head)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(_scorer(shared), _ROW.format(id=kind)))
    rows = stage(rows, "lm-rows")
    tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.n")
    tail = tail.join(counts, "word", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"),
                                   F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    extra = F.coalesce("tail_log", F.lit(0.0))
    return rows.drop("tail").join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"), (F.col("base_head") + extra).alias("base_score"),
        (F.col("model_head") + extra).alias("score"))


def lm_report(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32 of the id is not 1 mod 5."""
    return lm_scores(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
