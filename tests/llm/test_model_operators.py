"""Quality classifier, top-k search, language id, language model, WARC archives and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.test_text_operators import EDGES, SCHEMA, blanks, brute_components, brute_fingerprint, brute_hits, same
from vintagekit.llm import language, lm, pii, quality, queries, topk, warc
from vintagekit.llm.common import table


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "a", "b"][i % 3], None) + (None,) * 12 for i, t in enumerate(EDGES)]
    rows += [(None, "nobody's text here", None, None, None) + (None,) * 12] + [rows[5]] * 2
    plain = table(spark, SF_SMALL, "documents").withColumn("doc_id", F.col("doc_id") + 2000)
    return spark.createDataFrame(rows, SCHEMA).unionByName(plain, allowMissingColumns=True).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- quality ----------------------------------------------------------------------------------

def test_quality_agrees_with_held_back_labels(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    got = quality.quality_report(docs).join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    wrong = [r for r in got if r.keep != (r.quality == 1)]
    assert len(wrong) <= 0.01 * len(got)
    assert sum(not r.keep for r in got if r.quality == 1) <= 0.005 * len(got)  # clean documents stay


def test_quality_edges(docs, nothing):
    got = quality.quality_report(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for i in (0, 1, 2):
        assert not by_id[i].keep and by_id[i].score == 0.0
    assert all(0 <= r.score <= 1 and 0 <= r.weak_good <= 1 for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(r.doc_id,) for r in got if r.keep])
    assert quality.quality_report(nothing).collect() == [] and quality.keep_good(nothing).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    m, n = len(quality.LABELLERS), 20_000
    good = rng.random(n) < 0.8
    on_good, on_bad = np.linspace(0.85, 0.99, m), np.linspace(0.3, 0.7, m)
    right = rng.random((n, m)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random((n, m)) < 0.1] = quality.ABSTAIN
    model = quality.LabelModel(Counter(quality.pattern(v) for v in votes.tolist()))
    assert abs(model.share - 0.8) < 0.02
    assert np.abs(model.on_good - on_good).max() < 0.03 and np.abs(model.on_bad - on_bad).max() < 0.06


@pytest.mark.parametrize("rate", [0.6, 0.8, 0.95])
def test_em_recovers_a_poor_labeller(rate):
    """The model of production finds how often one labeller is wrong about good documents, whatever the others do."""
    rng = np.random.default_rng(9)
    m, n = len(quality.LABELLERS), 20_000
    good = rng.random(n) < 0.8
    on_good, on_bad = np.full(m, 0.98), np.full(m, 0.6)
    on_good[3] = rate
    votes = np.where(rng.random((n, m)) < np.where(good[:, None], on_good, on_bad), good[:, None], ~good[:, None]).astype(int)
    model = quality.LabelModel(Counter(quality.pattern(v) for v in votes.tolist()))
    assert abs(model.share - 0.8) < 0.02 and abs(model.on_good[3] - rate) < 0.02
    assert abs(model.on_bad[3] - 0.6) < 0.05


# --- top k ------------------------------------------------------------------------------------

def brute_top(rows, k=5):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [min(max(math.floor(256 * float(x)), -2**63), 2**63 - 1) for x in v]))
    out = []
    for at, (i, q) in enumerate(kept):
        if i % 50 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(q, c)), 1 - 2**63), 2**63 - 1), j) for n, (j, c) in enumerate(kept) if n != at)
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("block", [16_384, 7])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 1, 6) * (rng.random(6) < 0.5))]) for i in range(120)]
    rows += [(i, [1.0] * 6) for i in range(200, 230)] + [(250, [1.0] * 6), (300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf"), 1.0]),
             (500, []), (550, [0.5, -0.25]), (-50, [0.001, -0.001]), (None, [1.0]), (50, rows[50][1]), (7, [9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, q int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same(topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, block=block).collect(), brute_top(rows))


def test_top_k_takes_every_row_but_the_querys_own(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [3.0]), (2, [1.0]), (50, [4.0]), (50, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k_report(df).collect()
    same(got, brute_top(rows))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [50, 50, 1, 1, 2]


def test_top_k_in_many_groups_of_queries(spark):
    rng = np.random.default_rng(8)
    rows = [(int(50 * (i // 2)), [float(x) for x in rng.normal(0, 1, 3)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(topk.top_k(df, F.col("vec_id") % 50 == 0, block=100, chunks=1).collect(), brute_top(rows))


def test_top_k_of_large_values_and_few_rows(spark):
    rows = [(0, [3.0e30, 1.0]), (1, [3.0e30, -1.0]), (2, [1e6, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(topk.top_k_report(df).collect(), brute_top(rows))
    assert topk.top_k_report(df.limit(0)).collect() == []
    assert topk.top_k_report(df.limit(1)).collect() == []


# --- language ---------------------------------------------------------------------------------

def test_language_is_right_on_held_out_documents(spark):
    docs = table(spark, SF_CHECK, "documents")
    got = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_edges(spark, docs, nothing):
    got = {r.doc_id: r for r in language.language_report(docs).collect()}
    assert len(got) and got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.language_report(nothing).collect() == []
    unlabelled = language.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_cross_parse_equals_naive_parse():
    import random
    rng = random.Random(8)
    sample = {k: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(200)) for k, a in (("x", "abcde"), ("y", "defghé"))}
    model = language.Model(sample)
    texts = ["".join(rng.choice("abcdefgh ézZ.,") for _ in range(n)) for n in (0, 1, 5, 300, 1500)]
    codes, sizes = model.encode(texts)
    got = model.phrases(codes, sizes)
    for li, lang in enumerate(model.langs):
        c, _ = model.encode([sample[lang]])
        c = c[:language.SYMBOLS]
        hay = bytes(c[c < model.letters - 1])
        at = 0
        for t, n in enumerate(sizes):
            mine, count = bytes(codes[at:at + n]), 0.0
            at += n
            for s in range(0, len(mine), language.SEGMENT):
                part, i = mine[s:s + language.SEGMENT], 0
                while i < len(part):
                    j = i + 1
                    while j <= len(part) and part[i:j] in hay:
                        j += 1
                    n_letters = max(1, j - 1 - i)
                    count += min(np.log2(len(c)) + 2 * np.log2(n_letters) + 1, n_letters * np.log2(model.letters))
                    i += n_letters
            assert count == pytest.approx(got[li, t], rel=1e-12)


@pytest.mark.parametrize("ratio", [1, 10, 40])
def test_unequal_samples_are_normalised(ratio):
    """Two labels with related words in one alphabet: the one with the smaller sample is still found."""
    import random
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 6))) for _ in range(150)]
    words = {"a": [w + rng.choice(["", "en", "er"]) for w in stems], "b": [w[:-1] + rng.choice(["os", "a", "um"]) for w in stems]}

    def make(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    for small in "ab":
        sample = {lang: make(lang, 2400 // (ratio if lang == small else 1)) for lang in "ab"}
        model = language.Model(sample)
        truth = [lang for lang in "ab" for _ in range(100)]
        got = model.phrases(*model.encode([make(lang, 40) for lang in truth])).argmin(axis=0)
        assert np.mean([model.langs[k] == t for k, t in zip(got, truth)]) >= 0.95, (small, ratio)


def many_scripts(rng):
    """{language: a maker of texts}: pairs of languages that share a script and its letters, but not their words."""
    ranges = {"latin": (0x61, 26), "greek": (0x3B1, 17), "cyrillic": (0x430, 32), "chinese": (0x4E00, 1500), "korean": (0xAC00, 1500)}
    makers = {}
    for script, (first, n) in ranges.items():
        for k in "ab":
            known = ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(2, 4))) for _ in range(400)]
            makers[f"{script}-{k}"] = lambda size, known=known: " ".join(rng.choice(known) for _ in range(size))
    return makers


def test_language_of_many_scripts(spark):
    """With Latin, Greek, Cyrillic, Chinese and Korean together no letter of a sample is lost."""
    import random
    makers = many_scripts(random.Random(4))
    rows = [(i * 100 + j, make(150), lang) for i, (lang, make) in enumerate(makers.items()) for j in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language_report(df).collect()}
    held = [(lang, got[i]) for i, _, lang in rows if got[i].held_out]
    assert len({lang for lang, _ in held}) == len(makers) and all(r.lang_pred == lang and r.score > 0.55 for lang, r in held)


def test_letters_in_a_table_or_searched_are_one(monkeypatch):
    import random
    rng = random.Random(5)
    makers = many_scripts(rng)
    sample = {k: make(1200) for k, make in makers.items()}
    texts = [make(100) + make2(50) for make, make2 in zip(makers.values(), reversed(makers.values()))]
    got = []
    for dense in (1, 60, 5000):
        monkeypatch.setattr(language, "DENSE", dense)
        model = language.Model(sample)
        got.append(model.phrases(*model.encode(texts)))
    assert (got[0] == got[1]).all() and (got[0] == got[2]).all()


def test_every_label_is_learned(spark):
    names = [f"{i:03d}" for i in range(300)]
    rows = [(i * 10 + j, f"{chr(0x4E00 + 2 * i)}{chr(0x4E01 + 2 * i)} " * 30, lang) for i, lang in enumerate(names) for j in range(6)]
    sample = language.sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(sample) == names
    model = language.Model(sample)
    counts = model.phrases(*model.encode([r[1] for r in rows[::6]]))
    assert (counts.argmin(axis=0) == np.arange(300)).all()


# --- language model ---------------------------------------------------------------------------

def test_lm_base_score_and_gain(spark, docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, ends = Counter(), 0
    for r in rows:
        if not held(r.doc_id):
            counts.update(w.lower() for w in blanks(r.text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for r in rows:
        w = [x.lower() for x in blanks(r.text)]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [counts[x] for x in w] + [ends])
        want.append((r.doc_id, held(r.doc_id), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 5)))
    got = lm.lm_report(docs).collect()
    same([(*r[:5], round(r.base_score, 5)) for r in got], want)
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)
    assert lm.lm_report(nothing).collect() == []


def test_lm_tail_words_are_joined(spark, docs, monkeypatch):
    """With a head of ten words nearly all counts come from the join; the scores stay."""
    whole = {(r.doc_id, r.n_tokens): r for r in lm.lm_report(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", 70)
    for r in lm.lm_report(docs).collect():
        w = whole[r.doc_id, r.n_tokens]
        assert r.n_known == w.n_known and abs(r.base_score - w.base_score) < 1e-6 * abs(w.base_score) and abs(r.score - w.score) < 1e-6 * abs(w.score)


def test_lm_is_a_distribution():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, lm.CLASSES ** 3, 5000))
    logs = lm.log_probabilities(lm.train(codes, rng.integers(1, 50, len(codes)), steps=20))
    sums = (10.0 ** logs.reshape(-1, lm.CLASSES).astype(float)).sum(axis=1)
    assert np.abs(sums - 1).max() < 1e-4


def test_lm_learns_trigrams_that_are_rare():
    """Every counted trigram is trained on, also the few in a thousand million that draws would miss."""
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 40, (3000, 3)) @ np.array([lm.CLASSES ** 2, lm.CLASSES, 1]))
    counts = rng.integers(1, 1_000_000, len(codes))
    rare = (100 * lm.CLASSES + 100) * lm.CLASSES + 101
    logs = lm.log_probabilities(lm.train(np.append(codes, rare), np.append(counts, 5)))
    assert logs[rare] > np.log10(5 / counts.sum()) + 3  # a thousand times its share of all tokens
    seen = logs[codes].astype(float)
    unigram = np.bincount(codes % lm.CLASSES, weights=counts, minlength=lm.CLASSES) / counts.sum()
    assert (seen * counts).sum() > (np.log10(unigram[codes % lm.CLASSES]) * counts).sum()


# --- WARC -------------------------------------------------------------------------------------

def brute_warc(rows):
    of = {}
    for i, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            of[b] = max(of.get(b, i), i)
    out = []
    for i, html in rows:
        b = (html or "").encode()
        top = of.get(b, i)
        other = i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", top if other else None))
    return out


def test_warc_round_trip_and_index(spark):
    big = "<p>é中</p>" * 200
    rows = [(1, "http://www.a.org/x?y#z", big), (2, "https://b.a.org:8080/", big), (9, None, big), (3, "", ""), (4, "not an address", None), (5, "http://www.a.org/x?y", "s"),
            (6, "http://www.a.org:80/x?y", "s"), (None, "http://n.org/\r\nX: 1", big), (7, "http://[bad", "\r\n\r\nWARC/1.1\r\n"), (5, "http://www.a.org/x?y", "s"), (8, "http://h.org", "q" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "c", 1) for i, u, h in rows], "page_id long, url string, html string, path string, offset int").repartition(3)
    captures, shards = warc.archive(pages)
    got = warc.read_archives(warc.search(shards, warc.wanted(pages))).collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], brute_warc([(i, h) for i, _, h in rows]))
    top = warc.firsts(shards)
    for url, ids in (("http://www.a.org/x?y", [1, 5, 5, 6]), ("http://h.org/", [8]), ("http://nowhere.org/", [])):
        found = []
        for path, offset, length in warc.find(top, url):
            with warc._open(path) as f:
                f.seek(offset)
                found.append(warc._page_id(warc.parse(f.read(length))["warc-record-id"]))
        assert sorted(found) == ids
    assert warc.warc_report(pages.limit(0)).collect() == []


def test_warc_index_of_many_blocks(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.org/p%d", F.col("id") % 7, F.col("id") % 1000).alias("url"),
                                     F.concat(F.lit("body "), F.col("id").cast("string")).alias("html"))
    captures = warc.write_archives(pages, _folder(spark), archive=20_000)
    assert captures.select("path").distinct().count() > 5
    shards = warc.write_index(captures, _folder(spark), lines=50)
    top = warc.firsts(shards)
    for n in range(0, 3000, 371):
        places = warc.find(top, f"http://h{n % 7}.org/p{n % 1000}")
        want = captures.where(F.col("key") == warc.surt(f"http://h{n % 7}.org/p{n % 1000}")).select("path", "offset", "length").collect()
        same(places, want)


def test_warc_search_of_a_hot_address_and_of_absent_pages(spark):
    pages = spark.range(2000).select(F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") - 700).alias("page_id"),
                                     F.when(F.col("id") % 3 > 0, "http://hot.org/").otherwise(F.format_string("http://h%d.org/é", F.col("id"))).alias("url"),
                                     F.lit("x").alias("html"))
    captures = warc.write_archives(pages, _folder(spark), archive=20_000)
    shards = warc.write_index(captures.repartition(8), _folder(spark), lines=7)
    pairs = warc.wanted(pages).union(spark.createDataFrame([("org,hot)/", 9_999), ("zz", None), ("", 5)], "key string, page_id long"))
    got = warc.search(shards, pairs)
    same([tuple(r) for r in got.collect()], [tuple(r) for r in captures.select(got.columns).collect()])
    assert warc.read_archives(got, read=1 << 14).rdd.getNumPartitions() > 1
    assert warc.read_archives(got.limit(0)).collect() == []


def test_warc_results_come_from_the_directory(spark):
    """Directories that point at the wrong blocks lose records."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.format_string("http://h%02d.org/", F.col("id")).alias("url"), F.lit("x").alias("html"))
    shards = warc.write_index(warc.write_archives(pages, _folder(spark)).coalesce(1), _folder(spark), lines=5)
    for path in [r.shard for r in shards.collect()]:
        with warc._open(path + ".dir") as f:
            rows = [r.split("\t") for r in f.read().decode().split("\n")]
        places = [r[2:] for r in rows]
        with warc._create(path + ".dir") as f:
            f.write("\n".join("\t".join(r[:2] + p) for r, p in zip(rows, places[1:] + places[:1])).encode())
    assert warc.search(shards, warc.wanted(pages)).count() < 60


def _folder(spark):
    import re
    import uuid
    from vintagekit.session import checkpoint_dir
    return re.sub(r"^file:/+", "file:///", f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}")


# --- pipeline and registry --------------------------------------------------------------------

def test_pipeline_stages(spark, docs, nothing, tmp_path):
    rows = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "source mixing"]
    bench = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, rows, SF_SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        before, out = rows.collect(), spark.read.parquet(str(tmp_path / str(i)))
        after = out.collect()
        if i < 4:
            assert out.columns == rows.columns
        if i == 0:
            keep = {d: k for d, k in quality.quality_report(rows).select("doc_id", "keep").collect()}
            same([(r.doc_id,) for r in after], [(r.doc_id,) for r in before if keep[r.doc_id]])
        elif i == 1:
            comp = brute_components([r.doc_id for r in before], [brute_fingerprint(r.text) for r in before])
            same([(r.doc_id,) for r in after], [(c,) for c in set(comp)])
        elif i == 2:
            same([(r.doc_id,) for r in after], [(h[0],) for h in brute_hits(before, bench) if not h[-1]])
        elif i == 3:
            same([(r.doc_id, r.text) for r in after], [(r.doc_id, pii.mask(r.text)) for r in before])
        else:
            same([(r.doc_id, r.size) for r in after], [(r.doc_id, len(blanks(r.text))) for r in before])
        empty = step(spark, nothing, SF_SMALL)
        assert empty.count() == 0 and empty.columns == out.columns
        rows = out


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < got.count() <= 200


def test_registry():
    import __spark_entry__ as E
    names = E.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_CHECK)
    res = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    same(df.select(*cols).collect(), res.fetchall())
