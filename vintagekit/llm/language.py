"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed from
left to right into the longest phrases that occur in the sample (the automaton is walked until no
transition is left, then a new phrase begins); the language that needs the fewest phrases, normalised, wins. In a larger
sample phrases are longer by chance, so a phrase counts what it costs to name it: log2 of the sample's length for
its place and 2 log2 + 1 bits for its length, but no more than its letters cost one by one. Texts are lowered; runs of other characters count as one gap. Every letter of the sample is a symbol, in
any script; letters that a language's sample lacks match nothing in its automaton. A text is parsed whole, in segments of ``SEGMENT`` symbols, each of which begins a new
phrase; segments of many texts take their steps together, so the walk is vectorised.

Sample (bounds are parameters): the labelled rows that may be learned from are dealt into ``DOCS``
hash buckets per language, and the row with the smallest hash of each bucket gives one piece of ``PIECE`` characters from
a place that the hash chooses. Every label is learned, with at most ``SYMBOLS`` symbols, however many labels there are;
labels may have fewer. Only this sample, never the table, comes to the driver; tasks build the automata
from it. A parse costs a walk per label, so time grows with the labels.

An automaton holds the transitions of the ``DENSE`` most frequent letters of its language as a table and all others as
sorted keys that are searched; the split changes memory and time, not results.

``score`` is second / (best + second) of the normalised counts: 0.5 for a tie, near 1 when the
winner needs far less; 1 if only one language is known.

Cases: null text and text without letters give ``und`` and score 0, as does a table without labels;
ties go to the smaller label; repeated rows give equal rows; an empty table gives an empty table; very
long texts are parsed whole, in chunks of segments; lang, source and id are not used to predict; only
doc_id, text and (for the sample) lang are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCS, PIECE, SYMBOLS, DENSE = 64, 1000, 16_384, 60
SEGMENT, WIDTH = 512, 16_384


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions {code: state} of each state (the root is state 0) of the automaton that reads every substring of
    ``codes``."""
    steps, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


def phrase_bits(sample: int, letters: int) -> np.ndarray:
    """What a phrase of each length up to SEGMENT counts, given its label's sample and the letters of all samples."""
    length = np.arange(1, SEGMENT + 1)
    named = np.log2(max(2, sample)) + 2 * np.log2(length) + 1
    return np.concatenate([[0.0], np.minimum(named, length * np.log2(letters))])


class Automaton:
    """A language's automaton over local codes: the gap 0, its letters from the most frequent on, and last the letters it
    lacks. Codes up to DENSE are columns of ``table``; the others are found by search in ``keys``."""

    def __init__(self, codes: np.ndarray, letters: int):
        seen = np.bincount(codes, minlength=letters)
        seen[0] = 0
        own = np.argsort(-seen, kind="stable")[:np.count_nonzero(seen)]
        self.letters, self.width = len(own) + 2, min(len(own), DENSE) + 2
        self.local = np.full(letters, self.letters - 1, np.int32)
        self.local[0], self.local[own] = 0, np.arange(1, len(own) + 1)
        self.size = len(codes)
        steps = suffix_automaton(self.local[codes])
        kind = np.uint16 if len(steps) < 1 << 16 else np.uint32
        self.table = np.zeros(len(steps) * self.width, kind)  # its last column: no transition, or one among the keys
        self.root = np.zeros(self.letters, kind)
        for c, t in steps[0].items():
            self.root[c] = t
        far = []
        for s, out in enumerate(steps):
            for c, t in out.items():
                if c < self.width - 1:
                    self.table[s * self.width + c] = t
                else:
                    far.append((s * self.letters + c, t))
        far.sort()
        self.keys, self.to = np.array([k for k, _ in far], np.int64), np.array([t for _, t in far], kind)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state of each (0: none)."""
        if not len(self.keys):
            return self.table[state * self.width + c]
        last = self.width - 1
        t = self.table[state * self.width + np.minimum(c, last)]
        search = np.flatnonzero((c >= last) & (c < self.letters - 1))
        if len(search):
            key = state[search] * self.letters + c[search]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            t[search] = np.where(self.keys[at] == key, self.to[at], 0)
        return t


class Model:
    """Alphabet and automata of a sample {language: text}."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8)
        known = sorted({c for text in sample.values() for c in text.lower() if c.isalpha()})
        self.letters = len(known) + 2
        kind = np.uint8 if self.letters <= 1 << 8 else np.uint32
        self.code = letter * kind(self.letters - 1)  # letters of no sample are the last symbol, the rest is a gap
        for i, c in enumerate(known):
            self.code[ord(c)] = i + 1
        self.automata = [Automaton(self.encode([sample[lang]])[0][:SYMBOLS], self.letters) for lang in self.langs]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and how many each has; runs of non-letters are one gap."""
        low = [t.lower() for t in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.code[points]
        owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
        keep = codes != 0
        if len(codes):
            keep[1:] |= (codes[:-1] != 0) & (owner[1:] == owner[:-1])
        return codes[keep], np.bincount(owner[keep], minlength=len(low))

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Normalised phrases [language, text] of the cross-parse of each text: the bits that name them."""
        out = np.zeros((len(self.langs), len(sizes)))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
        start = begin[owner] + number * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
        order = np.argsort(-length, kind="stable")
        for i, automaton in enumerate(self.automata):
            local, bits = automaton.local[codes], phrase_bits(automaton.size, self.letters)
            for at in range(0, len(order), WIDTH):
                pick = order[at:at + WIDTH]
                long_, where = length[pick], start[pick]
                active = np.searchsorted(-long_, -np.arange(1, long_[0] + 1), side="right")  # segments with a symbol at each step
                state, so_far, cost = np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64), np.zeros(len(pick))
                for step in range(int(long_[0])):
                    m = active[step]
                    c = local[where[:m] + step]
                    s = state[:m]
                    t = automaton.step(s, c)
                    none = t == 0
                    begins = none | (s == 0)
                    cost[:m] += np.where(begins, bits[so_far[:m]], 0.0)
                    so_far[:m] = np.where(begins, 1, so_far[:m] + 1)
                    state[:m] = np.where(none, automaton.root[c], t)
                out[i] += np.bincount(owner[pick], weights=cost + bits[so_far], minlength=len(sizes))
        return out


_MODELS: dict[str, Model] = {}


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sample = shared.value
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(sample)
        model = _MODELS[name]
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            lang, score, at = [], [], 0
            while at < len(texts):  # about a million characters at a time
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end]) <= 1 << 20):
                    total += len(texts[end])
                    end += 1
                codes, sizes = model.encode(texts[at:end])
                owner = np.repeat(np.arange(len(sizes)), sizes)
                letters = np.bincount(owner[codes != 0], minlength=len(sizes))
                counts = model.phrases(codes, sizes)
                for j in range(len(sizes)):
                    if not letters[j] or not model.langs:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    ranked = np.argsort(counts[:, j], kind="stable")
                    best, second = counts[ranked[0], j], counts[ranked[1], j] if len(ranked) > 1 else 0
                    lang.append(model.langs[ranked[0]])
                    score.append(float(second / (best + second)) if len(ranked) > 1 else 1.0)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def sample_texts(docs: DataFrame, learn: Column) -> dict[str, str]:
    """Bounded sample of the rows that ``learn`` allows: {language: text}."""
    h = F.xxhash64("doc_id", "text")
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", h.alias("h"), F.pmod(h, F.lit(DOCS)).alias("bucket"), "text")
    picked = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    room = F.greatest(F.length("text") - PIECE, F.lit(0))
    piece = F.substring("text", F.pmod(F.col("h"), room + 1).cast("int") + 1, F.lit(PIECE))
    got = (rows.join(F.broadcast(picked), ["lang", "bucket", "h"])  # DOCS rows a label
           .select("lang", "h", piece.alias("piece")).distinct().orderBy("lang", "h").collect())
    out: dict[str, list[str]] = {}
    for r in got:
        out.setdefault(r["lang"], []).append(r["piece"])
    return {k: "\n".join(v) for k, v in out.items() if any(c.isalpha() for p in v for c in p)}


def identify(docs: DataFrame, sample: dict[str, str], held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _predictor(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32 of the id is not 2 mod 4; a null id may be learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, sample_texts(docs, ~held_out), held_out)
