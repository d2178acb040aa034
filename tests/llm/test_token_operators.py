"""Token counts, cross-tokenizer alignment and the divergence audit against brute force and the libraries themselves."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vintagekit.llm import align, divergence, tokens, vocab
from vintagekit.llm.common import table
from vintagekit.session import checkpoint_dir

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest binary, n_tokens long, n_bytes long, rid long, "
          "a int, b int, m int, link long, n long, best boolean, term string, tile int, block int, p long, item string, value long, rank int, docs int")
EDGES = [
    None, "", " ", "\n", "a", "x<|endoftext|>y", "one<|endoftext|> two <|endoftext|>", "a  b\n c\td \x00 z", "▁x ▁y", "a<s>b</s><unk>", "  lead",
    "trail ", "é ñ 漢字 \U0001F600 ﬁ İ ı ſ", "x́ ́y á.b", "1,000.50 a,b ,c .d e. f.. (g). h'll, don't. U.S.A.", "\r\n x \xa0y z",
    "\0start a \0b", "word," * 300, "aaaa " * 400, "z" * 20000, "the quick brown fox, jumps. over " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    fill = (None,) * 18
    rows = [(i, t, [None, "", "en", "xx"][i % 4], [None, "", "s", "ü"][i % 3], None) + fill for i, t in enumerate(EDGES)]
    rows += [(None, "nobody's text", "en", "s", 1) + fill, rows[4], rows[4], rows[0], (4, "another text", "en", "s", 1) + fill]
    edge = spark.createDataFrame(rows, SCHEMA)
    plain = table(spark, SF_SMALL, "documents").withColumn("doc_id", F.col("doc_id") + 2000)
    return edge.unionByName(plain, allowMissingColumns=True).repartition(4).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


# --- cuts -------------------------------------------------------------------------------------

def test_cut_texts_give_the_tokens_of_the_whole(rows):
    a, plain, b = (vocab.ByteBpe(vocab.vocabulary(vocab.BYTE_BPE)), vocab.ByteBpe(vocab.vocabulary(vocab.BYTE_BPE), special_as_text=True),
                   vocab.PieceBpe(vocab.vocabulary(vocab.PIECE_BPE)))
    assert a.separable and plain.separable and b.separable
    for r in rows:
        if not r.text:
            continue
        words = vocab.words(r.text)
        assert "".join(map(vocab.spelled, words)) == r.text
        assert sum(a.encode_words([vocab.spelled(w) for w in words]), []) == a.encode([r.text])[0]
        pieces = vocab.pieces(r.text)
        assert " ".join(pieces) == r.text
        assert sum(plain.encode_words([" " + p for p in pieces]), []) == plain.encode([" " + r.text])[0]
        if "▁" not in r.text:
            assert sum(b.encode(pieces), []) == b.encode([r.text])[0]


def test_fast_and_slow_cuts_agree():
    for t in ["a b", "a,b c. d", "x1,2", "é, ü. z", "ab", "a.\nb c"]:
        assert [vocab.spelled(w) for w in vocab.words(t)] == vocab.WORD.split(t)


# --- op11 -------------------------------------------------------------------------------------

def library_counts(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocab.vocabulary(vocab.BYTE_BPE))
    n = [len(t.encode(r.text or "", add_special_tokens=False).ids) for r in rows]
    return [(r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n)]


@pytest.fixture
def cache(spark, request):
    return f"{checkpoint_dir(spark)}/token-cache-{re.sub('[^a-z0-9]', '-', request.node.name)}"


@pytest.mark.parametrize("few", [0, 100_000])
def test_counts_are_the_library_s_and_the_cache_is_used(spark, docs, rows, cache, few, monkeypatch):
    path, want = vocab.vocabulary(vocab.BYTE_BPE), library_counts(rows)
    first = docs.where("doc_id % 2 = 0")
    got = tokens.token_counts(first, path, cache, few).collect()
    same([tuple(r) for r in got], [w[:3] for w in want if w[0] is not None and w[0] % 2 == 0])
    stored = spark.read.parquet(cache)
    before = {bytes(r.digest) for r in stored.collect()}
    assert len(before) == stored.count() == first.select(F.coalesce("text", F.lit(""))).distinct().count()
    same([tuple(r) for r in tokens.token_counts(docs, path, cache, few).collect()], [w[:3] for w in want])
    stored = spark.read.parquet(cache)
    assert stored.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()  # only the missing ones were added
    spark.createDataFrame([(hashlib.sha256(b"a").digest(), 77)], tokens.SCHEMA).write.mode("append").parquet(
        f"{cache}/tokenizer={vocab.version(path, tokens.OPTIONS)}")
    got = tokens.token_counts(docs.where("text = 'a'"), path, cache, few).collect()
    assert {r.n_tokens for r in got} == {77}  # a stored count is not counted again
    assert stored.select("tokenizer").distinct().count() == 1
    monkeypatch.setattr(tokens, "OPTIONS", "another version")
    assert {r.n_tokens for r in tokens.token_counts(docs.where("text = 'a'"), path, cache, few).collect()} == {1}


def test_count_report_and_empty_table(spark, docs, rows, nothing, cache):
    got = tokens.token_report(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    same(got.collect(), library_counts(rows))
    assert tokens.token_report(nothing, cache=cache).count() == 0
    sp = tokens.token_report(docs, vocab.vocabulary(vocab.PIECE_BPE), cache)
    model = vocab.PieceBpe(vocab.vocabulary(vocab.PIECE_BPE))
    same([(r.doc_id, r.n_tokens) for r in sp.collect()], [(r.doc_id, len(model.encode([r.text or ""])[0])) for r in rows])


def test_counter_forgets_and_counts_on():
    path = vocab.vocabulary(vocab.BYTE_BPE)
    small, large = tokens.Counter(path, keep=40), tokens.Counter(path)
    texts = [f"alpha{i} beta{i % 7}, gamma. delta{i}" for i in range(60)] + [""]
    for t in texts * 2:
        assert small.counts([t]) == large.counts([t])
    assert len(small.new) + len(small.old) <= 60


def test_a_worker_with_another_file_raises(docs):
    run = tokens._encoder(vocab.vocabulary(vocab.BYTE_BPE), "not this one")
    with pytest.raises(ValueError, match="differs"):
        list(run(iter([])))


# --- op12 -------------------------------------------------------------------------------------

def brute_alignment(rows):
    a, b = vocab.ByteBpe(vocab.vocabulary(vocab.BYTE_BPE), special_as_text=True), vocab.PieceBpe(vocab.vocabulary(vocab.PIECE_BPE))
    spell_a, spell_b = a.token_bytes(), b.token_bytes()
    found, holders = [], Counter()
    for r in rows:
        ids_a, ids_b = (a.encode([" " + r.text])[0], b.encode([r.text])[0]) if r.text else ([], [])
        if r.text and not all(b"".join(s[x] for x in ids) == (" " + r.text).encode() for s, ids in ((spell_a, ids_a), (spell_b, ids_b))):
            ids_a = ids_b = []
        ends_a, ends_b = (np.cumsum([len(s[x]) for x in ids]).astype(int).tolist() for s, ids in ((spell_a, ids_a), (spell_b, ids_b)))
        links, i, k, groups, at = [], 0, 0, [], (0, 0)
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[k]))
            here = ends_a[i], ends_b[k]
            i, k = i + (here[0] <= here[1]), k + (here[1] <= here[0])
            if here[0] == here[1]:
                groups.append(",".join(map(str, ids_a[at[0]:i])) + "|" + ",".join(map(str, ids_b[at[1]:k])))
                at = i, k
        holders.update(set(links))
        found.append((r.doc_id, ids_a, ids_b, groups, links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    return [(i, len(x), len(y), len(g), len(k), sum(holders[p] == best[p[0]] for p in k), sum(holders[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, g, k in found]


@pytest.mark.parametrize("head", [align.HEAD, 40])
def test_alignment_against_brute_force(docs, rows, head):
    got = align.alignment(docs, head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment(rows)
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[4] > w[3] for w in want)
    same(got.collect(), want)


def test_alignment_of_nothing(nothing):
    assert align.alignment(nothing).count() == 0


def test_aligner_lets_parts_go(rows):
    paths = vocab.vocabulary(vocab.BYTE_BPE), vocab.vocabulary(vocab.PIECE_BPE)
    small, large = align.Aligner(*paths, keep=50), align.Aligner(*paths)
    texts = [r.text for r in rows]
    for at in range(0, len(texts), 9):
        x, y = (k.documents(texts[at:at + 9]).to_pydict() for k in (small, large))
        assert x == y
    large.cuts = False  # whole texts give the same
    whole = large.documents(texts[:40]).to_pydict()
    assert whole == align.Aligner(*paths).documents(texts[:40]).to_pydict()


# --- op13 -------------------------------------------------------------------------------------

def brute_divergence(rows, min_docs=30, top=50):
    docs = [(r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r.text or "")))
            for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, w) for x, s, w in docs if x == lang]
        holders = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in holders.items() if n >= min_docs)
        every = Counter(t for _, w in own for t in w)
        count = {s: Counter(t for x, w in own if x == s for t in w) for s, _ in own}
        v = len(kept)

        def p(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return [1 + 10 ** 9 * (c[t] + 5) // (total + 5 * v) for t in kept]

        q, ps = p(every), {s: p(c) for s, c in count.items()}
        for s in ps:
            gaps = [(-sum(abs(x - y) for x, y in zip(ps[s], ps[h])), h.encode()) for h in ps if h != s]
            over = [(y - x, t.encode()) for x, y, t in zip(ps[s], q, kept) if count[s][t] and x > y]
            for part, items, most in (("pair", gaps, len(gaps)), ("term", over, top)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(items)[:most], 1)]
    return out


def test_a_worker_holds_little_of_what_it_has_aligned():
    """Texts that are one part each."""
    words, rng = [f"w{i}" for i in range(5000)], np.random.default_rng(7)
    paths = vocab.vocabulary(vocab.BYTE_BPE), vocab.vocabulary(vocab.PIECE_BPE)
    texts = ["▁ " + " ".join(rng.choice(words, 2500)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    rows = held = most = 0
    for out in align._align_texts(*paths)(iter([batch])):
        rows, most = rows + len(out), max(most, len(out))
        held = max(held, align._ALIGNERS[paths].table.nbytes)
    align._ALIGNERS.clear()
    assert rows == len(texts)
    assert held < 96 << 20
    assert most * len(texts[0].encode()) < 1.5 * (1 << 20)


@pytest.mark.parametrize("shape", [{}, {"tile": 16, "block": 3}, {"min_docs": 1, "top": 5}, {"min_docs": 10 ** 6}])
def test_divergence_against_brute_force(docs, rows, shape):
    got = divergence.divergence(docs, **shape)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    same(got.collect(), brute_divergence(rows, shape.get("min_docs", 30), shape.get("top", 50)))


def test_divergence_of_nothing(nothing):
    assert divergence.divergence(nothing).count() == 0


def test_tree_and_joint_traversal():
    rng = np.random.default_rng(3)
    for shape in [(1, 1), (3, 17), (20, 64), (7, 5)]:
        full = rng.random(shape) < 0.1
        p = np.where(full, rng.integers(1, 100, shape), rng.integers(1, 9, (shape[0], 1)))
        levels = divergence.tree(full)
        assert levels[-1].shape == (1, 1) and levels[-1][0, 0] == full.any()
        left, right = np.triu_indices(shape[0], 1)
        gap, columns = divergence.compare(p, levels, left, right)
        read = full[left] | full[right]
        assert (columns == read.sum(1)).all() and (gap == (np.abs(p[left] - p[right]) * read).sum(1)).all()


def test_counts_of_large_totals_are_exact(spark):
    df = spark.createDataFrame([(10 ** 13, 10 ** 15, 10 ** 6)], "n long, total long, v long")
    assert df.select(divergence.share("n", "total", "v").alias("p")).first().p == 1 + 10 ** 9 * (10 ** 13 + 5) // (10 ** 15 + 5 * 10 ** 6)
