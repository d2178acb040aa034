"""PII, license scan, SimHash, decontamination and mixing against brute-force versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vintagekit.llm import decontaminate, licenses, mixing, pii, simhash
from vintagekit.llm.common import table

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, anchor string, k_id int, k_hash int, "
          "k_text int, h int, u int, n long, size string, node int, win int, count int")
EDGES = [
    None, "", " \n\t ", "x", "ÉtÉ İ \U0001F600 é@a.b", "the quick brown fox jumps over the lazy dog again and again today",
    "the quick brown fox jumps over the lazy dog again and again today", "THE quick brown fox jumps over the lazy dog again and again Today",
    "a@b.c@d.e x@y a.b@c-d.e.f. 1.2.3.4.5.6.7.8 999.1.1.1.2 +1 (234) 567-8901 +12 4111 1111 1111 1111, 4111-1111-1111-1111",
    "00001.2.3.4 +123456789+123456789 ٣@x.y 1.2.3.4@5.6 4111111111111111 1234567890123456789012 +4 5 1.2.3.256 a@b@c.d",
    "see https://user:pw@www.example.com:80/x?y=1. IBAN: DE89 3704 0044 0532 0130 00 and iban GB00WEST12345698765432, account no: 12-345-678, ssn 123-45-6789",
    "under the MIT license under the mit license, cc by nc cc-by-nc apache license version 2.0 " * 40,
    "word " * 30000 + "me@here.org",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "a", "b", "ä"][i % 4], None) + (None,) * 12 for i, t in enumerate(EDGES)]
    rows += [(None, "nobody's text here", None, None, None) + (1, "x") + (2,) * 4 + (3, 4, "s", 5, 6, 7), (1000, EDGES[5], "en", "a", 3) + (None,) * 12]
    rows += [rows[5]] * 3 + [rows[0]] * 2
    edge = spark.createDataFrame(rows, SCHEMA)
    plain = table(spark, SF_SMALL, "documents").withColumn("doc_id", F.col("doc_id") + 2000)
    return edge.unionByName(plain, allowMissingColumns=True).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "source").collect()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def blanks(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# --- PII --------------------------------------------------------------------------------------

def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_spans_equal_the_patterns(docs, rows):
    want = []
    for r in rows:
        spans = base_spans(r.text)
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        want.append([r.doc_id] + [sum(s[2] == k for s in spans) for k in pii.BASE_KINDS] + [hashlib.sha256(text.encode()).hexdigest()])
    got = pii.pii_report(docs).collect()
    same([g[:6] for g in got], want)


def test_pii_added_kinds_and_mask():
    text = EDGES[10]
    found = {(k, text[s:e]) for s, e, k in pii.scan(text)}
    assert ("url", "https://user:pw@www.example.com:80/x?y=1") in found
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found and not any("GB00" in v for k, v in found if k == "iban")
    assert ("account", "12-345-678") in found and ("account", "123-45-6789") in found
    assert pii.mask("mail a@b.c now") == "mail [EMAIL] now" and pii.mask(None) is None and pii.mask("plain") == "plain"
    for t in EDGES:
        assert not [s for s in pii.scan(pii.mask(t)) if s[2] in pii.PRIVATE_KINDS]


def test_redact_keeps_columns_and_clean_rows(docs, rows, nothing):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    same([(r.doc_id, r.text) for r in out.collect()], [(r.doc_id, pii.mask(r.text)) for r in rows])
    assert pii.redact(nothing).count() == 0 and pii.pii_report(nothing).collect() == []


# --- licenses ---------------------------------------------------------------------------------

def brute_license(text, rules):
    w = alnum(text)
    norm = " " + " ".join(w) + " "
    det = set()
    n_base, first = 0, []
    for label, p, _, rx in rules:
        for m in re.finditer(rx, norm):
            start = norm[:m.start()].count(" ") - 1
            det.add((start, start + m.group().count(" ") + 1, p, label))
            n_base += p == 0
            first += [start] if p == 0 else []

    def inside(d, e):
        return e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or (e[2], e[3]) < (d[2], d[3]))

    near = defaultdict(list)
    for e in det:
        for at in range(e[0], e[1]):
            near[at].append(e)
    stand = [d for d in det if d[2] == 0 or not any(inside(d, e) for e in near[d[0]])]
    names = lambda ds: ",".join(sorted({d[3] for d in ds}))
    return (len(w), n_base, min(first, default=None), max(first, default=None), names(d for d in det if d[2] == 0), names(stand),
            max([licenses.CONFIDENCE[d[2]] for d in stand], default=0.0))


def test_license_report_equals_brute_force(docs, rows, nothing):
    rules = licenses.rules()
    assert len(rules) > 200
    same(licenses.license_report(docs).collect(), [(r.doc_id, *brute_license(r.text, rules)) for r in rows])
    assert licenses.license_report(nothing).collect() == []


def test_license_suppression(spark):
    texts = ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: Apache-2.0",
             "https://creativecommons.org/licenses/by-nc-sa/4.0/", "commit to a license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(df).collect()}
    assert got == {0: ("lgpl-2.1", 0.95), 1: ("apache-2", 0.95), 2: ("cc-by-nc-sa", 0.9), 3: ("", 0.0)}


def test_no_rule_hides_from_the_triggers():
    """Every rule's matches hold a trigger and the rule's keyword, so the gates lose nothing."""
    for label, p, key, rx in licenses.rules():
        keys = licenses.FAMILIES.get(key, (key,))
        body = re.sub(r"\(\?:[^()]*\)\?|\(\?[<=][^()]*\)", "", rx)
        assert any(k.strip() in body or k.split()[0] in body for k in keys), (label, rx)


def wordings(rx):
    """Texts that a rule matches: every choice of every branch, optional part and character class, the rule's grant
    (the same words before each name) once in each form."""
    def seq(tree):
        out = [""]
        for op, av in tree:
            match str(op):
                case "LITERAL":
                    parts = [chr(av)]
                case "IN":
                    parts = [chr(c) for kind, v in av for c in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))]
                case "SUBPATTERN":
                    parts = seq(av[3])
                case "BRANCH":
                    parts = [x for branch in av[1] for x in seq(branch)]
                case "MAX_REPEAT" if av[1] == 1:
                    parts = ["", *seq(av[2])]
                case "MAX_REPEAT":
                    parts = ["", "eu software page "]
                case "ASSERT" | "ASSERT_NOT":
                    parts = [""]
                case _:
                    raise AssertionError(op)
            out = [a + b for a in out for b in parts]
        return out

    if licenses._GRANT not in rx:
        return seq(re._parser.parse(rx))
    names = seq(re._parser.parse(rx.replace(licenses._GRANT, "")))
    return ["licensed under " + x for x in names] + [x + names[0] for x in seq(re._parser.parse(licenses._GRANT))]


def test_gates_lose_no_wording(spark):
    """Every wording of every rule is found with the gates, and all detections equal those of the rules without them."""
    rules = licenses.rules()
    texts = {}
    for label, p, key, rx in rules:
        for x in wordings(rx):
            assert re.search(rx, f" {x} "), (rx, x)
            assert any(k in f" {x} " for k in licenses.FAMILIES.get(key, (key,))), (label, key, x)
            texts.setdefault(x, (label, p))
    assert len(texts) > 1000
    some = sorted(texts)[::5] + [x for x in texts if "zero clause" in x or "freebsd" in x or "php 3" in x]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r) for r in licenses.license_report(df).collect()}
    same(got.values(), [(i, *brute_license(x, rules)) for i, x in enumerate(some)])
    assert all(r[7] >= licenses.CONFIDENCE[texts[x][1]] for x, r in zip(some, (got[i] for i in range(len(some)))))


def test_license_wordings_without_a_stem(spark):
    texts = {"Distributed under the 3-clause BSD": "bsd-3-clause", "2-clause BSD": "bsd-2-clause", "released under WTFPL": "wtfpl",
             "https://www.eclipse.org/legal/epl-v10": "epl-1", "http://scripts.sil.org/OFL": "ofl-1.1", "zero-clause BSD license": "0bsd",
             "SPDX-License-Identifier: PHP-3.01": "php-3", "the FreeBSD license": "bsd-2-clause", "CC Attribution-ShareAlike 4.0": "cc-by-sa"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in sorted(licenses.license_report(df).collect())] == list(texts.values())


# --- SimHash ----------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = [x.lower() for x in blanks(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=3):
    at = list(range(len(fps)))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                at[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_near_duplicates_equal_brute_force(docs, rows, nothing):
    fps = [brute_fingerprint(r.text) for r in rows]
    want = [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps))]
    same(simhash.near_duplicate_report(docs).collect(), want)
    assert simhash.near_duplicate_report(nothing).collect() == []


def test_keep_one_keeps_one_row_of_each_group(docs, rows, nothing):
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components([r.doc_id for r in rows], fps)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    same([(g,) for g in got], [(c,) for c in set(comp)])
    assert simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("block", [50_000, 16])
def test_dense_fingerprints_lose_no_link(spark, block):
    """A ball of fingerprints around one point, a chain and random points; with and without blocks."""
    import random
    rng = random.Random(4)
    centre, points = rng.getrandbits(64), set()
    for _ in range(150):
        points.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    x = rng.getrandbits(64)
    for _ in range(40):
        points.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
    points |= {rng.getrandbits(64) for _ in range(100)}
    points = sorted(points)
    want = brute_components(points, points)
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in points], "fp long")
    comp = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
    groups, brute = defaultdict(set), defaultdict(set)
    for p, c in zip(points, want):
        brute[c].add(p)
        groups[comp.get(p, p - (p >> 63 << 64))].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_anchors_meet_at_distance_three():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)

    def sets(v):
        out = [set() for _ in v]
        for r, a in zip(*simhash.anchors(v)):
            out[r].add(int(a))
        return out

    mine = sets(x)
    for bits in (1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        assert all(a & b for a, b in zip(mine, sets(y)))


# --- decontamination --------------------------------------------------------------------------

def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i:i + m])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for r in docs:
        w, hit, found = alnum(r.text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= {str(x) for x in windows[tuple(w[i:i + m])] if x is not None}
        out.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = {r.doc_id: r.text for r in rows}
    long_ = next(t for i, t in texts.items() if i and i >= 2000 and t and len(alnum(t)) > 60)
    mid = " ".join(alnum(long_)[20:45])
    got = [(i, t) for i, t in enumerate(["quick brown fox", "word word", "x", None, "", mid, mid, "nothing of the kind here at all"])]
    got += [(None, "lazy dog again"), (5, " ".join(alnum(long_)[10:30])), (9, "word " * 20)]
    return got + [(r.item_id + 100, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]


@pytest.mark.parametrize("short_set, broadcast", [(10_000, 1_000_000), (0, 0)])
def test_contamination_equals_brute_force(spark, docs, rows, items, monkeypatch, short_set, broadcast):
    monkeypatch.setattr(decontaminate, "SHORT_SET", short_set)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    same(decontaminate.contamination(docs, b).collect(), want)
    kept = decontaminate.drop_contaminated(docs, b)
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(w[0],) for w in want if not w[-1]])


def test_contamination_of_empty_tables(spark, docs, rows, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(nothing, table(spark, SF_SMALL, "benchmark")).collect() == []


def test_winnowing_keeps_a_fifth_and_meets_every_span(spark):
    import random
    rng = random.Random(2)
    a = [f"w{rng.randint(0, 400)}" for _ in range(600)]
    df = spark.createDataFrame([(a,)], "w array<string>").select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    kept = set(df.select(decontaminate.kept_starts(F.col("h"))).first()[0])
    assert len(kept) < 0.3 * len(a)
    for i in range(len(a) - 12):  # every 13-word span holds a kept 5-gram
        assert any(i <= k <= i + 8 for k in kept)


# --- mixing -----------------------------------------------------------------------------------

def brute_targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(blanks(r.text))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        rate = (left - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] >= 2 * sizes[s]}
        if not over:
            return sizes, target | {s: rate * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
    return sizes, target


def test_mix_meets_targets(docs, rows, nothing):
    got = mixing.mix_report(docs).collect()
    sizes, targets = brute_targets(rows)
    key = lambda i: (i is None, i)
    assert sorted(((r.doc_id, r.size) for r in got), key=lambda x: (key(x[0]), x[1])) == sorted(
        ((r.doc_id, len(blanks(r.text))) for r in rows), key=lambda x: (key(x[0]), x[1]))
    assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
    most = Counter()
    for r in rows:
        most[r.source] = max(most[r.source], len(blanks(r.text)))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= most[s] + 1e-6, (s, taken[s], t)
    again = mixing.mix_report(docs.repartition(3)).collect()
    same(again, got)
    assert mixing.mix_report(nothing).collect() == []


def test_mix_of_many_small_documents_comes_close(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = mixing.mix(df, fan=8).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 37 for r in got)


def test_mix_of_empty_texts_and_equal_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id int, text string, source string")
    assert [r.taken for r in mixing.mix_report(df).collect()] == [0, 0]
    copies = spark.createDataFrame([(7, "one two", "a")] * 900 + [(8, "three four", "b")] * 100, "doc_id int, text string, source string")
    got = mixing.mix_report(copies).collect()
    assert len(got) == 1000 and max(r.taken for r in got) <= 4 and abs(sum(r.taken for r in got) - 3000) <= 4


def test_license_bodies_and_expressions(spark):
    texts = {"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
             "GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
             "GNU Lesser General Public License as published by the Free Software Foundation; version 2.1": "lgpl-2.1",
             "under GPLv2+": "gpl-2", "Business Source License 1.1": "busl-1.1", "MIT or Apache-2.0": "apache-2,mit",
             "https://opensource.org/license/mit": "mit", "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in sorted(licenses.license_report(df).collect())] == list(texts.values())


def test_dense_texts_take_linear_time(spark):
    """A text full of license names, and one of account cues that touch their values."""
    import time

    def license_time(n):
        df = spark.createDataFrame([(1, "see the mit license and " * n)], "doc_id long, text string")
        at = time.perf_counter()
        assert licenses.license_report(df).first().labels == "mit"
        return time.perf_counter() - at

    license_time(100)
    assert license_time(80_000) < 60  # 2 MB
    at = time.perf_counter()
    assert pii.scan("acctX-" * 170_000) == [] and pii.scan("acct a-" * 150_000) == []  # 1 MB each
    assert len(pii.scan("acct: 12-345-678 " * 50_000)) >= 50_000
    assert time.perf_counter() - at < 30
