"""Operators over whole tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkscreen.llm import gru_lm, license_scan, ngram_join, quality_crf, secret_scan, topk
from sparkscreen.llm.graph import Steps, components
from sparkscreen.llm.shared import Scratch

SCHEMA = "doc_id long, extra string, text string, a long, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, "x", t, 3, "c") for i, t in rows], SCHEMA).repartition(3)


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(25)] + [(None, 3), (5, 5), (7, 6)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert found == {x: top(x) for x in list(root)}


def test_a_long_chain_takes_few_steps(spark):
    steps = Steps(Scratch(spark))
    found = components(spark.range(1000).selectExpr("id as a", "id + 1 as b"), steps).collect()
    assert {r["component"] for r in found} == {0} and len(found) == 1001
    assert steps.written <= 20


def near_rows():
    rng = random.Random(2)
    bank = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(bank) for _ in range(n)]
    rows, shared = [], say(60)
    for k in range(12):
        base = say(rng.randint(20, 150))
        rows.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(bank)
            rows.append(copy)
        rows.append(say(20) + shared + say(rng.randint(5, 20)))
    chain = say(100)
    for _ in range(8):
        chain = chain[3:] + say(3)
        rows.append(list(chain))
    texts = [" ".join(r) for r in rows] + ["", None, "  \n", "One two", "one TWO", "a b c d", "a b c d e", "A b\tc d e"]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def jaccard_classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("tile_rows,late_most", [(1024, 1 << 22), (3, 20), (3, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile_rows, late_most):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(ngram_join.late_grams, "__defaults__", (1 << 20, late_most))
    monkeypatch.setattr(ngram_join.met_grams, "__defaults__", (1 << 20, late_most))
    rows = near_rows()
    want = jaccard_classes(rows)
    docs = frame(spark, [*rows, rows[0], (None, rows[0][1])])
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, c in want.values()})


def test_tiles_find_links_that_leaders_miss(spark, monkeypatch):
    """With leaders out of the way, tiles alone must find every link."""
    rows = near_rows()
    want = jaccard_classes(rows)
    docs = frame(spark, rows)
    real = ngram_join.decided
    calls = []

    def without_star(pairs, *args):
        calls.append(1)
        return real(pairs.limit(0) if len(calls) == 1 else pairs, *args)

    monkeypatch.setattr(ngram_join, "CLOSEST_ROUNDS", 0)

    ngram_join.decided = without_star
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    finally:
        ngram_join.decided = real
    assert got == {i: c for i, (_, c) in want.items()}


def test_texts_that_share_an_id(spark):
    """Different texts of one id are documents of their own, and none of them is lost."""
    say = lambda w: " ".join(f"{w}{k}" for k in range(40))
    rows = [(1, say("a")), (1, say("b")), (2, say("b")), (3, say("c")), (3, say("c")), (4, ""), (4, None), (5, "é " + say("a"))]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (4, 4), (5, 1)]
    kept = sorted((r["doc_id"], r["text"] or "-") for r in ngram_join.one_of_each(frame(spark, rows)).collect())
    assert kept == [(1, say("a")), (1, say("b")), (3, say("c")), (4, "-"), (4, "-")]


def test_long_words_do_not_collide(spark):
    """The sums of these two words of 2,048 characters are equal modulo 2**64."""
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    y = x.translate(str.maketrans("ab", "ba"))
    got = ngram_join.near_duplicates(frame(spark, [(1, x), (2, y), (3, x.upper())])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_empty_documents_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicates(none).count() == 0
    assert license_scan.license_scan(none.selectExpr("doc_id", "text as path", "text")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 0.3, 12).round(2).tolist()) for i in range(400)]
    vectors += [(401, [float("nan")] * 12), (402, None), (450, [None] * 12), (500, [1.0, 2.0]), (550, [0.5, -2.0]), (None, [0.1] * 12), (403, vectors[7][1]), (600, [float("inf")] * 12), (650, [])]
    df = spark.createDataFrame([(i, [x for x in v] if v is not None else None, "z") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(3)
    usable = [(i, np.floor(256 * np.float32(v).astype(float))) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in usable:
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in usable if j != i and len(v) == len(q))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    for block in (4096, 3):
        got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0", query_block=block).collect())
        assert got == sorted(want)


def test_top_k_of_large_numbers_and_shared_ids(spark):
    rows = [(0, [2e5, 2e5]), (1, [-2e5, -2e5]), (2, [1e5, -1e5]), (50, [1e7, -3e6]), (50, [1e7, -3e6]), (50, [4.0, 4.0]), (7, [2e5, 2e5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, query int").repartition(2)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for a, (i, q) in enumerate(whole):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(whole) if b != a)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0").collect())) == sorted(want)
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"), "vec_id = 0").collect()


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_secret_scan(spark):
    rng = random.Random(8)
    pieces = ["secret=token:", "password = ", "\"abcdefghijkl\"", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "é\U0001f600", " ", "\n", "api_key:", "TOKEN='", "x9/+_.=-", "deadbeef", "user=bob ", "host=a.example.com "]
    texts = [None, "", *["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(150)]]
    rows = list(enumerate(texts))
    docs = frame(spark, [*rows, rows[5], (None, texts[6])])
    got = secret_scan.secret_digests(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = base(texts[6 if r["doc_id"] is None else r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("linked")] == want


def test_weak_parts_need_a_complement(spark):
    gap = " " * (secret_scan.SCOPE + 5)
    near = " " * (secret_scan.SCOPE - 5)
    texts = ["user=bob" + near + "pwd=abcd", "user=bob" + gap + "pwd=abcd", "pwd=abcd", "host=db.example.com pwd=abcd", "user=bob host=db.example.com", "user=bob" + near + "pwd=abcd" + near + "https://x.example/"]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digests(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i].count("linked") for i in range(6)] == [2, 0, 0, 2, 0, 3]
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame(spark, [(1, "é password=b7db7aa4a5fcc78305 end"), (2, None), (3, "clean"), (None, "AKIAABCDEFGHIJKLMN!")])).collect()}
    assert out == {1: "é <assign> end", 2: None, 3: "clean", None: "<access>!"}


def linked(text, scope):
    """All pairs of weak parts, one by one."""
    text = text or ""
    parts = [(m.start(), m.end(), role) for role, p in secret_scan.WEAK.items() for m in re.finditer(p, text, re.A)]
    own = [tuple(map(int, b.split(":")[1:])) for b in base(text)]
    near = lambda x, y: y[2] in secret_scan.COMPLEMENTS[x[2]] and y[0] - x[1] <= scope and x[0] - y[1] <= scope
    return sorted({x[:2] for x in parts if any(near(x, y) for y in parts) and not any(a <= x[0] and x[1] <= b for a, b in own)})


@pytest.mark.parametrize("scope,folded", [(240, 256), (30, 2)])
def test_links_equal_all_pairs(spark, monkeypatch, scope, folded):
    monkeypatch.setattr(secret_scan, "FOLDED", folded)
    rng = random.Random(5)
    pieces = ["user=bob", "client_id: 'ab-12'", "AKIAABCD", "pwd=abcd", 'token = "0123456789abcdef0123456789abcdef01234567"', "Authorization: Bearer abc.def", "10.20.30.40:8080", "https://u:p@db.example/x", "host=db.example.com", "plain words", "é\U0001f600", "\n", " " * 20, " " * 90]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "pwd=abcd " * 700 + "user=bob"]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digests(frame(spark, list(enumerate(texts))), scope).collect()}
    for i, t in enumerate(texts):
        assert sorted(tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("linked")) == linked(t, scope), (i, t)
    assert sum("linked" in s for s in got.values()) > 30


def test_license_scan(spark):
    files = [
        ("r/LICENSE", "Released under the MIT License"), ("r/a/x.py", "print(1)"), ("r/a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("r/a/b/y.py", "no header"),
        ("r/a/b/z.py", "code\nmore\nThis work is licensed under the GNU General Public License, version 3.\nend"), ("s/t.py", "nothing"), (None, "orphan"), ("r/c/n.py", None), ("r/c/NOTICE", "all RIGHTS reserved"), ("r/q.py", "x"),
    ]
    odd = "directory licence basis best own_place place units keys is_licence_file".split()
    df = spark.createDataFrame([(i, p, t, *odd) for i, (p, t) in enumerate(files)], f"doc_id long, path string, text string, {', '.join(f'{c} string' for c in odd)}")
    assert license_scan.license_scan(df).where("directory = 'directory' and best = 'best'").count() == len(files)
    got = {r["doc_id"]: (r["licence"], r["basis"], r["from_directory"]) for r in license_scan.license_scan(df).collect()}
    assert got[9] == ("MIT", "inherited", "r") and got[1] == ("Apache-2.0", "inherited", "r/a") and got[3] == ("Apache-2.0", "inherited", "r/a")
    assert got[4] == ("GPL-3.0", "own", None) and got[5] == (None, "none", None) and got[6] == (None, "none", None)
    assert got[7] == ("Proprietary", "inherited", "r/c") and got[0][1] == "own"


def test_license_weights_count_all_terms(spark):
    """Words that all files have weigh little, also those that no template has; by brute force."""
    rng = np.random.default_rng(3)
    words = ["our", "library", "is", "code", "the", "and", "zebra", "quux", "mit", "license", "released", "under", "version"]
    header = "Our library is released under the MIT License"
    texts = [header] + ["our library is here\n" + "\n".join(" ".join(rng.choice(words, int(rng.integers(2, 9)))) for _ in range(3)) for _ in range(400)] + [None, ""]
    terms = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    df = Counter(w for t in texts for w in set(terms(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1

    def cosine(x, y):
        x, y = ({w: c * idf(w) for w, c in Counter(z).items()} for z in (x, y))
        return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x else 0.0

    want = [max((round(cosine(terms(line), terms(s)), 6), -k) for line in (t or "").split("\n") for k, (_, s) in enumerate(license_scan.TEMPLATES)) for t in texts]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, list(enumerate(texts))).selectExpr("doc_id", "concat('d/', doc_id) as path", "text")).collect()}
    assert len(got) == len(texts) and (got[0]["licence"], got[0]["basis"]) == ("MIT", "own")
    for i, (score, place) in enumerate(want):
        fits = score >= license_scan.LIKE
        assert got[i]["licence"] == (license_scan.TEMPLATES[-place][0] if fits else None), (i, texts[i], score)
        assert not fits or abs(got[i]["own_score"] - score) < 2e-6
    assert 10 < sum(score >= license_scan.LIKE for score, _ in want) < len(texts)


def test_licence_files_with_whole_bodies(spark):
    """Bodies over many lines, none of which is a statement, and the files below them."""
    bsd = """Copyright (c) 2019, Some People

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES, HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY."""
    third = bsd.replace("THIS SOFTWARE", "3. Neither the name of the holder nor the names of its contributors may be\nused to endorse or promote products derived from this software without\nspecific prior written permission.\n\nTHIS SOFTWARE", 1)
    isc = """Copyright 2020 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY."""
    gpl = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    top = {"b": ("LICENSE", bsd, "BSD-2-Clause"), "c": ("LICENSE.md", third, "BSD-3-Clause"), "i": ("COPYING", isc, "ISC"), "g": ("LICENSE", gpl, "GPL-2.0")}
    files = [(f"{d}/{name}", text) for d, (name, text, _) in top.items()] + [(f"{d}/x/y/{k}.py", f"plain code of {w}") for d in top for k, w in enumerate(("one", "two"))] + [("z/notes.txt", bsd), ("z/u.py", "pass")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["path"]: (r["licence"], r["basis"], r["from_directory"]) for r in license_scan.license_scan(df).collect()}
    for d, (name, _, licence) in top.items():
        assert got[f"{d}/{name}"] == (licence, "own", None)
        assert got[f"{d}/x/y/0.py"] == got[f"{d}/x/y/1.py"] == (licence, "inherited", d)
    assert got["z/notes.txt"] == got["z/u.py"] == (None, "none", None)


def test_licences_of_a_system(spark):
    """Versions are told apart, unknown licences stay unknown, and a copyright line is no licence."""
    import glob
    import os

    want = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "GPL-1": None, "LGPL-2": None, "MPL-1.1": None, "Artistic": None, "GFDL-1.3": None}
    files = [(n, f"{n}/LICENSE-{n}", open(f, errors="replace").read()) for f in glob.glob("/usr/share/common-licenses/*") if (n := os.path.basename(f)) in want]
    if not files:
        pytest.skip("no licences here")
    files += [(f"x{k}", f"src/{k}.py", "some code here\nprint(1)\nthe software is fine") for k in range(60)]
    got = {r["name"]: r["licence"] for r in license_scan.license_scan(spark.createDataFrame(files, "name string, path string, text string")).collect()}
    assert {n: got[n] for n, _, _ in files if n in want} == {n: want[n] for n, _, _ in files if n in want}


def test_quality_field():
    rng = np.random.default_rng(1)
    # Forward and backward sums against all labelings.
    unary, pairs = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    there = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    good, expected, norm = quality_crf.forward_backward(unary, there, pairs)
    want = np.zeros((2, 2))
    for d in range(3):
        n = int(there[d].sum())
        z, marg, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for m in range(1 << n):
            y = [m >> k & 1 for k in range(n)]
            s = math.exp(sum(unary[d, k] * y[k] for k in range(n)) + sum(pairs[y[k], y[k + 1]] for k in range(n - 1)))
            z += s
            marg += s * np.array(y)
            for k in range(n - 1):
                pr[y[k], y[k + 1]] += s
        assert np.allclose(good[d, :n], marg / z) and math.isclose(norm[d], math.log(z), rel_tol=1e-9)
        want += pr / z
    assert np.allclose(expected, want)


def test_lines_belong_to_their_documents():
    import pyarrow as pa

    from sparkscreen.llm.bytetext import text_buffers

    texts = ["a\nB!!\n", "", None, "\n", "x y\nx y", "word word word", "last"]
    x = quality_crf.lines_of(*text_buffers(pa.array(texts)))
    lines = [line for t in texts for line in (t or "").split("\n")]
    assert x.size.tolist() == [len(line) for line in lines]
    assert np.diff(x.first).tolist() == [(t or "").count("\n") + 1 for t in texts]
    alone = [quality_crf.lines_of(*text_buffers(pa.array([t]))).own for t in texts]
    assert np.allclose(x.own, np.concatenate(alone))


def test_quality_on_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality_crf.fit(docs, labels, use=~quality_crf.held_out(0, 5))
    rows = quality_crf.score_documents(docs, field).withColumn("held_out", quality_crf.held_out(0, 5)).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])
    assert ((rows["score"] >= quality_crf.LIMIT) == (rows["quality"] == 1)).mean() > 0.97
    odd = quality_crf.score_documents(frame(spark, [(1, None), (2, ""), (2, ""), (None, "text\n" * 5000)]), field).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5001, None), (5002, ""), (5003, "never seen words qqqq"), (5003, "never seen words qqqq"), (None, "null id")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = gru_lm.score_documents(docs, quality_crf.held_out(2, 7)).toPandas()
    rows = docs.toPandas()
    counts = {}
    tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = lambda i: i == i and i is not None and zlib.crc32(str(int(i)).encode()) % 7 == 2
    for i, t in zip(rows["doc_id"], rows["text"], strict=True):
        for w in tokens(t) if not held(i) else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert set(got["train_tokens"]) == {n} and len(got) == len(rows)
    own = {i: g for i, g in got.dropna(subset="doc_id").groupby("doc_id")}
    for i, t in zip(rows["doc_id"], rows["text"], strict=True):
        if i == i:
            g, w = own[i].iloc[0], tokens(t)
            assert (g["held_out"], g["n_tokens"], g["n_known"]) == (held(i), len(w), sum(x in counts for x in w))
            assert math.isclose(g["base_score"], sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in gru_lm.score_documents(d, quality_crf.held_out(2, 7)).collect()} for d in (docs.coalesce(1), docs.repartition(4)))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-4) for i in one)


def test_language_model_is_a_distribution():
    counts = np.array([50, 20, 5, 1, 0, 9, 3])
    model = gru_lm.Model(counts, size=4, classes=3)
    rng = np.random.default_rng(0)
    model.flat[:] += rng.normal(0, 0.1, len(model.flat)).astype(np.float32)
    model.w["tb"][~model.there] = -30
    end = 6

    def total(prefix, depth):
        if depth == 0:
            return math.exp(sum(score_prefix(prefix)))
        return sum(total([*prefix, k], depth - 1) for k in range(7))

    def score_prefix(prefix):
        h, table, x, out = np.zeros((1, 4), np.float32), model.inputs(), end, []
        for y in prefix:
            h = model.step(table, np.array([x]), h if x != end else h * 0)[0]
            out.append(float(model.log_probs(h, np.array([y]))[0]))
            x = y
        return out

    assert math.isclose(total([], 3), 1, rel_tol=1e-4)
    text = np.array([0, 3, 1, end], np.int32)
    assert math.isclose(model.score([text], end)[0], sum(score_prefix(text.tolist())), rel_tol=1e-5)
    # Gradients against differences.
    x, y = np.array([[end, 0], [1, end], [2, 1]]), np.array([[1, end], [2, 1], [end, 0]])
    grad = np.zeros_like(model.flat)
    model.window(x, y, np.zeros((2, 4), np.float32), model.views(grad), end)
    for k in rng.integers(0, len(grad), 40):
        was = model.flat[k]
        loss = []
        for step in (1e-2, -1e-2):
            model.flat[k] = was + step
            loss.append(model.window(x, y, np.zeros((2, 4), np.float32), model.views(np.zeros_like(grad)), end)[1])
        model.flat[k] = was
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[k]) < 2e-3


def test_language_model_sorts_targets_once_for_all_classes(monkeypatch):
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 1000, 70)
    model = gru_lm.Model(counts, size=6, classes=9)
    h, y = np.tanh(rng.normal(0, 1, (900, 6))).astype(np.float32), rng.integers(0, 70, 900)
    scale = rng.random(900).astype(np.float32)

    def plain(h):
        """In float64, a target at a time: log-probabilities, and gradients of the loss."""
        w = {n: v.astype(float) for n, v in model.w.items()}
        logp, dh, grads = [], [], {n: np.zeros(v.shape) for n, v in w.items()}
        for x, t, f in zip(h.astype(float), y, scale, strict=True):
            c, k = model.class_of[t], model.in_class[t]
            one, back = 0.0, np.zeros(6)
            for at, (m, b), own in ((None, ("cw", "cb"), c), (c, ("tw", "tb"), k)):
                m, b, gm, gb = (v[n] if at is None else v[n][at] for v in (w, grads) for n in (m, b))
                a = x @ m + b
                p = np.exp(a - a.max())
                p /= p.sum()
                one += a[own] - a.max() - math.log(np.exp(a - a.max()).sum())
                d = (p - np.eye(len(p))[own]) * f
                gm += np.outer(x, d)
                gb += d
                back += m @ d
            logp.append(one)
            dh.append(back)
        return np.array(logp), np.array(dh), grads

    calls = []
    exp = np.exp
    # Weights of every size: as they are, with rows whose largest logit has to be taken off, and states beyond 1.
    for factor, states in ((1, h), (400, h), (1, h * 300)):
        for n in ("cw", "tw"):
            model.w[n][:] = rng.normal(0, 0.5 * factor, model.w[n].shape)
        got = model.views(np.zeros_like(model.flat))
        with monkeypatch.context() as m:
            m.setattr(gru_lm.np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
            logp, dh = model.log_probs(states, y, got, scale)
        expected = plain(states)
        assert np.allclose(logp, expected[0], rtol=1e-4, atol=1e-3) and np.allclose(model.log_probs(states, y), logp)
        assert np.allclose(dh, expected[1], rtol=1e-3, atol=1e-3 * factor)
        assert all(np.allclose(got[n], expected[2][n], rtol=1e-3, atol=2e-2) for n in ("cw", "cb", "tw", "tb"))
    # One pass over the classes and one over the tokens in them, not one a class.
    assert len(calls) == 2 * 3


def test_pipeline_against_brute_force(spark):
    """Each stage by itself, judged on its own input."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = p.good_quality(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert first.join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * good
    assert first.columns == docs.columns
    second = p.one_of_near_duplicates(spark, first, sf)
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    kept = sorted(r["doc_id"] for r in second.collect())
    assert kept == sorted({c for _, c in jaccard_classes(rows).values()})
    third = p.uncontaminated(spark, second, sf)
    assert third.columns == docs.columns and 0 < third.count() < second.count()
    fourth = p.without_secrets(spark, third, sf)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert not any(base(r["text"]) for r in fourth.collect())
    last = p.encoded(spark, fourth, sf)
    assert last.count() == fourth.count() and last.columns == ["doc_id", "n_tokens", "ids"]
    assert last.where("n_tokens <> size(ids)").count() == 0
