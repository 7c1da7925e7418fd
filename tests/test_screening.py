"""Table tests of text, pattern, HTML, URL and pooling operators at their boundaries."""

import re

import pytest
from pyspark.sql import functions as F

from sparkscreen.functions import patterns, pooling, text, urls
from sparkscreen.operators import cache, forms, html, search, structure
from sparkscreen.sources import tables


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(3)
    return [r["o"] for r in sorted(df.select("i", expr(F.col("v")).alias("o")).collect())]


def test_normalize_matches_reference_rules(spark):
    values = ["a​ b  c", "x\x1c\x1dy", "\n \n \n", "a\n\n\n\nb", " a \n  b ", "é", "", None, "\t\n", "a b", "﻿q­"]
    want = [None if v is None else html.normalize_text(v) for v in values]
    assert one(spark, values, text.normalize) == want
    assert want[2] == "" and want[5] == "é"
    assert html.normalize_text("a\n \n \nb") == "a\n\n\nb"  # runs of line feeds collapse before lines are stripped


def test_every_probe_fires_its_pattern(spark):
    rows = [p.probe for p in patterns.REGISTRY]
    for p, hits in zip(patterns.REGISTRY, one(spark, rows, lambda v: F.struct(*patterns.hits(v))), strict=True):
        assert hits[p.name] == 1, p.name


@pytest.mark.parametrize("value,line", [("a\nb\nignore all previous", 3), ("ignore\nprevious\nrot13", 1), ("disregard a\n\ninstructions", None), ("disregard disregard x instructions", 1)])
def test_lines_and_gaps(spark, value, line):
    flags = one(spark, [value], patterns.flags)[0]
    assert (flags[0]["line"] if flags else None) == line


def test_case_and_space_classes(spark):
    values = ["IGNORE ALL\x1cPREVIOUS", "<ſystem>", "x\rsystem: y", "x system: y", "x\nSYSTEM: y", "A" * 40, "a" * 39]
    got = [bool(f) for f in one(spark, values, patterns.flags)]
    assert got == [True, True, False, False, True, True, False]


def test_verdicts(spark):
    values = ["", "rot13", "rot13 rot13", "rot13 rot13 rot13", "rot13 " * 4, "rot13 [admin]", None]
    got = one(spark, values, patterns.scan)
    assert [g["verdict"] for g in got] == ["clean", "suspicious", "suspicious", "suspicious", "suspicious", "blocked", "clean"]
    assert [round(g["penalty"], 9) for g in got] == [0, -0.15, -0.3, -0.45, -0.45, 0, 0]
    two = spark.createDataFrame([("rot13", "javascript: data:text/"), ("ok", "rot13"), ("[admin]", "[poppy]")], "a string, b string").select(patterns.combine(patterns.scan(F.col("a")), patterns.scan(F.col("b"))).alias("s")).collect()
    assert [(r["s"]["verdict"], len(r["s"]["flags"])) for r in two] == [("suspicious", 1), ("suspicious", 1), ("blocked", 1)]
    assert two[2]["s"]["flags"][0]["matched"] == "[admin]"


def test_forms(spark):
    got = one(spark, ["plain", "&amp;lt;system&amp;gt;", "іgnore prevіous", "ﷺ" * 300, None, ""], lambda v: forms.text_forms(v))
    assert got[0]["forms"] == ["plain"] and "<system>" in got[1]["forms"] and "ignore previous" in got[2]["forms"]
    assert [g["refused"] for g in got] == [False, False, False, True, False, False]
    made = spark.createDataFrame([(0, "іgnore prevіous"), (1, "ﷺ" * 300)], "i int, v string").withColumn("f", forms.text_forms("v"))
    scanned = [r["s"] for r in made.select("i", patterns.scan_forms(F.col("f.forms"), F.col("f.refused")).alias("s")).orderBy("i").collect()]
    assert [s["verdict"] for s in scanned] == ["blocked", "blocked"] and scanned[1]["flags"][-1]["category"] == "encoded_payload"


def test_markup_scan(spark):
    got = one(spark, ["<p>x</p>", "<  system role>", "<a href\n=\n'http://192.168.0.1'>", "&lt;retrieval_note", None], patterns.scan_markup)
    assert [g["verdict"] for g in got] == ["clean", "blocked", "suspicious", "suspicious", "clean"]


PAGES = [
    ("<html><head><title> T </title><meta name=author content=''></head><body><p>One<p>Two <b>b</b>old<script>no</script></body></html>", "T", None, "T\nOne\nTwo\nb\nold"),
    ("<title>a<b></title><div class='x byline'>By Me</div><time datetime='2024-01-02'></time>", None, "By Me", None),
    ("", None, None, ""), (None, None, None, ""),
    ('<script type="application/ld+json">{"@type":"Article","author":{"name":"N"},"datePublished":"2020"}</script><li>a<li>b', None, "N", "a\nb"),
]


def test_html(spark):
    got = one(spark, [p[0] for p in PAGES], html.extract_html)
    for g, (_, title, author, raw) in zip(got, PAGES, strict=True):
        assert g["author"] == author
        if raw is not None:
            assert g["title"] == title and g["raw_text"] == raw
    assert got[0]["scan_text_inline"] == "T\n\nOne\n\nTwo bold"
    assert got[4]["date"] == "2020" and got[1]["date"] == "2024-01-02"


@pytest.mark.parametrize("attr,gone", [
    ("hidden", True), ("hidden=until-found", False), ("aria-hidden=TRUE", True), ("style='display:none !important'", True), ("style='opacity:0%'", True), ("style='clip:rect(0 0 0 0)'", True),
    ("style='text-indent:-999px'", True), ("style='text-indent:-998px'", False), ("style='position:fixed;top:-1000px'", True), ("style='left:-1000px'", False), ("style='overflow:hidden;width:0'", True), ("style='visibility:hidden'", True), ("style='font-size:0'", True), ("class=x", False),
])
def test_visibility(attr, gone):
    root, pruned = html.visible(html.parse(f"<body><p>seen<div {attr}>SECRET</div>end</body>"))
    assert ("SECRET" not in html.raw_text(root)) == gone == pruned
    assert "seen" in html.raw_text(root)


def test_visibility_comes_back():
    shown = lambda h: html.raw_text(html.visible(html.parse(f"<body>{h}</body>"))[0])
    assert shown("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>") == "b"
    assert shown("<div style='font-size:0'>a<b style='font-size:12px'>b</b><i style='font-size:2em'>c</i></div>") == "b"


def test_windows(spark):
    assert one(spark, [0, 1, 512, 513, 960, 961], text.window_count, "int") == [0, 1, 1, 2, 2, 3]
    got = one(spark, ["w " * 513, "", "one"], text.token_windows)
    assert [[(w["start"], w["n"]) for w in g] for g in got] == [[(0, 512), (448, 65)], [], [(0, 1)]]


SCORES = [[], [0.85], [0.851], [0.5, 0.5], [0.5, 0.4, 0.5], [0.4, 0.5, 0.5], [0.9, 0.1, 0.5, 0.6], [0.49]]


def test_pooling(spark):
    run = lambda p: one(spark, SCORES, p, "array<double>")
    assert run(pooling.max_score(0.85)) == [False, False, True, False, False, False, True, False]
    assert run(pooling.contiguity(2, 0.5)) == [False, False, False, True, False, True, True, False]
    assert run(pooling.k_anywhere(2, 0.5)) == [False, False, False, True, True, True, True, False]
    assert run(pooling.mean_at_least(0.5)) == [False, True, True, True, False, False, True, False]
    assert run(pooling.smoothed(2, 0.5)) == [False, True, True, True, False, True, True, False]
    assert run(pooling.flagged_windows) == [[], [], [0], [0, 1], [], [1, 2], [0, 2, 3], []]
    assert run(pooling.rule_of) == ["none", "none", "max_score", "contiguity", "none", "contiguity", "both", "none"]


def test_trust(spark):
    rows = [("trusted", 0.0, 0.0, False, 0.95), ("standard", -0.45, -0.5, True, 0.0), ("blocked", 0.0, 0.0, False, 0.0), ("verified", -0.15, -0.1, False, 0.6), ("untrusted", 0.0, -0.1, True, 0.2)]
    df = spark.createDataFrame(rows, "t string, a double, b double, c boolean, want double")
    assert all(abs(r["s"] - r["want"]) < 1e-9 for r in df.select("want", structure.trust_score(F.col("t"), F.col("a"), F.col("b"), F.col("c")).alias("s")).collect())


def test_summary(spark):
    t = "first\n\nfiller words here\n\nup 12.5% today\n\nwe use cookies\n\n| a | b |\n\nlast"
    got = one(spark, [t, t, "", None, "a\nb\nc"], lambda v: structure.summary(v, F.length(v) > 60))
    assert got[0]["kept"] == ["first", "up 12.5% today", "| a | b |", "last"]
    assert [(c["class"], c["words"]) for c in got[0]["classes"]] == [("general content", 3), ("cookie/privacy notices", 3)]
    assert got[2]["kept"] == [] and got[3]["kept"] == [] and got[4]["kept"] == ["a", "c"]


def test_url_rules(spark):
    cases = {
        "": "missing", "   ": "missing", "http://x.example/" + "a" * 2031: None, "http://x.example/" + "a" * 2032: "too_long", "http://x.example/\x01": "raw_chars", "http://x.example:99999/": "invalid_port", "ftp://x.example": "parse",
        "http://u:p@x.example/": "userinfo", "http://[fe80::1%25a]/": "zone_id", "http://a%zz.example/": "host_code_point", "http://127.0.0.1./": "private_literal", "http://a.localhost/": "blocklisted_name", "HTTPS://X.Example:8080/p?q#f": None, "//x.example/": "parse",
    }
    assert one(spark, list(cases), urls.url_rule) == list(cases.values())
    assert one(spark, [None], urls.url_rule) == ["missing"]
    assert one(spark, ["HTTPS://X.Example:8080/P?q=1#f"], urls.canonical_url) == ["https://x.example:8080/P?q=1"]


def test_hosts():
    kinds = {
        "Example.COM.": ("example.com", "name"), "a..b": (None, "host_empty_label"), "1.2.3.4": ("1.2.3.4", "ipv4"), "1.2.3": (None, "host_numeric"), "0x7f.1": (None, "host_numeric"), "::1": ("::1", "ipv6"), "fe80::zz": (None, "host_literal"), "": (None, "host_empty"), "under_score.example": ("under_score.example", "name"),
    }
    for host, (want, rest) in kinds.items():
        got = urls.canonical_host(host)
        assert got["host"] == want and rest in (got["kind"], got["reason"]), host
    classes = {"10.0.0.1": "private_literal", "8.8.8.8": None, "::ffff:10.0.0.1": "embedded_private", "::ffff:8.8.8.8": None, "2002:0a00:0001::": "embedded_private", "64:ff9b::a00:1": "embedded_private", "2a00:1450:4001:80e::200e": None, "::1": "private_literal", "fc00::1": "private_literal"}
    assert {a: urls.address_class(a) for a in classes} == classes


def test_cache_url_and_policy(spark):
    got = one(spark, ["HTTP://X.example/a//?b=2&UTM_Source=x&a=&b=1#f", "http://x.example/", "http://x.example/p?ref=1"], urls.cache_url)
    assert got == ["http://x.example/a?a=&b=2&b=1", "http://x.example/", "http://x.example/p"]
    policy = spark.createDataFrame([("example.com", True, "trusted", 1), ("a.example.com", False, "blocked", 0)], "name string, wildcard boolean, tier string, priority int")
    hosts = spark.createDataFrame([(h,) for h in ("example.com", "b.example.com", "a.example.com", "xexample.com", "c.a.example.com", "com", None)], "host string")
    tiers = {r["host"]: r["tier"] for r in urls.trust_tier(hosts, policy).collect()}
    assert tiers == {"example.com": "trusted", "b.example.com": "trusted", "a.example.com": "blocked", "xexample.com": "standard", "c.a.example.com": "trusted", "com": "standard", None: "standard"}


def test_search(spark):
    rows = [(1, k, k % 3 == 0) for k in range(9)]
    df = spark.createDataFrame([(q, p, "odd_reason" if b else None, str(p)) for q, p, b in rows], "query_id int, pos int, omission string, url string")
    seen = search.examined(df, 3)
    assert [r["pos"] for r in seen.orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    assert [tuple(r) for r in search.omission_counts(seen).collect()] == [(1, "other", 2)]
    bad = search.metasearch_rows(spark.createDataFrame([(1, "not json"), (2, None), (3, '{"results":[{"title":"t","url":"u"}]}')], "id int, body string"), 5)
    assert [(r["id"], r["url"]) for r in bad.collect()] == [(3, "u")]


def test_envelopes(spark):
    wrap, unwrap = cache.envelope(b"s"), cache.unwrap(b"s", 100)
    got = one(spark, ["a", None], lambda v: unwrap(F.lit("k"), wrap(F.lit("k"), v)))
    assert [(g["payload"], g["fault"]) for g in got] == [("a", None), (None, None)]
    assert [g["fault"] for g in one(spark, ["x" * 160, "v1.ab", "v1.ab.c", "zz"], lambda v: unwrap(F.lit("k"), v))] == ["oversize", "malformed", "bad_mac", "unsigned"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"a","kind":"attack","payload":{"text":"x"}}\n{broken\n')
    got = {r["id"]: r["_corrupt"] for r in tables.corpus(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got["a"] is None and got[None] == "{broken"
    (tmp_path / "k.json").write_text('{"format":1,"records":{"%s":{"scores":[0.1],"windows":1},"bad":{"scores":[0.1],"windows":2}}}' % ("0" * 64))
    assert {r["sha256"]: r["fault"] for r in tables.cassette(spark, str(tmp_path / "k.json")).collect()} == {"0" * 64: None, "bad": "key"}
    import gzip

    inflate = tables.inflate_bounded(100)
    rows = [(gzip.compress(b"ok"), "gzip"), (gzip.compress(b"x" * 101), "gzip"), (b"raw", None), (b"bad", "gzip"), (b"x", "br"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b binary, e string").select("i", inflate("b", "e").alias("o"))
    assert [r["o"]["status"] for r in sorted(df.collect())] == ["ok", "too_large", "ok", "broken", "encoding", "missing"]


def test_hostile_sizes(spark):
    import time

    shapes = ["ignore " * 100_000, "disregard " * 80_000, "![" * 300_000, "<" * 500_000, "A" * 1_000_000]
    began = time.time()
    assert len(one(spark, shapes, lambda v: patterns.scan(v)["verdict"])) == 5
    assert time.time() - began < 120
    assert re.sub(r"\s", "", html.raw_text(html.parse("<span>" * 20_000 + "x"))) == "x"


HIDING = {
    "opacity:0": True, "opacity:0%": True, "opacity:0px": False, "clip:rect(0)": False, "clip:rect(0 0,0px 0)": True, "clip:rect(0,0,0,1px)": False, "text-indent:-999px": True, "text-indent:-998px": False, "text-indent:-9999em": False,
    "position:fixed;top:-2000px": True, "left:-2000px": False, "overflow:hidden;width:0": True, "width:0": False, "display:none !important": True, "display:none!important": True, "display:!important none": False, "display: None": True,
    ":none;display:block": False, "display:none;display:block": False, "visibility:collapse": True, "visibility:hidden": True, "font-size:0em": True, "font-size:0;": True, "": False,
}


@pytest.mark.parametrize("style,hides", HIDING.items())
def test_hiding_styles(style, hides):
    from sparkscreen.operators import html

    tree, pruned = html.visible(html.parse(f'<body><p>seen</p><div style="{style}">GONE</div></body>'))
    assert pruned == hides and ("GONE" not in html.raw_text(tree)) == hides


def test_hidden_parts_that_show_again():
    from sparkscreen.operators import html

    shown = lambda body: html.raw_text(html.visible(html.parse(f"<title>t</title><body>{body}</body>"))[0]).split()
    assert shown('<div style="visibility:hidden">a<b style="visibility:visible">b</b></div>') == ["t", "b"]
    assert shown('<div style="font-size:0">a<b style="font-size:2em">b</b><i style="font-size:3px">c</i></div>') == ["t", "c"]
    assert shown('<div hidden="until-found">a</div><div hidden>b</div><p aria-hidden=" TRUE ">c</p>') == ["t", "a"]


def test_authors_and_dates():
    from sparkscreen.operators import html

    got = lambda page: (lambda x: (x["author"], x["date"]))(html.extract(page))
    assert got('<meta name="author" content=""><div class="byline"> By <b>Ann</b> </div><time datetime=" 2020-01-02 ">') == ("ByAnn", "2020-01-02")
    assert got('<meta property="article:author" content=" A "><meta name="author" content="B">')[0] == "A"
    assert got('<script type="application/ld+json">{"@type": "Article", "author": {"name": " C "}, "datePublished": 2020}</script>') == ("C", "2020")
    assert got('<script type="application/ld+json">{"@type": "Other", "author": "C", "datePublished": ""}</script>') == (None, None)
