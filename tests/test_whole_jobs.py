"""Queries over all that their tables can hold, against brute force."""

import random
import re
import unicodedata

from sparkscreen.plans import catalogue


def tables(tmp_path, spark, **rows):
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_leaks_wherever_the_marker_stands(spark, tmp_path):
    rng = random.Random(5)
    marks = ["The quick brown fox jumps over the lazy dog today", "x" * 60, "first\nline feed after the first word, then more", "Pneumono" * 6, "éà ñ" * 12, "short one", "No. 7 (b): what is the sum of 2 and 3, in full words?"]
    items = [(f"b{k}", t) for k, t in enumerate(marks)] + [("b0", marks[0]), ("none", None)]
    noise = lambda n: "".join(rng.choice("abc de\n(é") for _ in range(n))
    texts = [before + m + after for m in marks for before, after in (("", ""), ("(", ")"), ("\u201c", "x"), ("word-", "-word"), ("\n", "\n"), (noise(300), noise(200)), (noise(7), ""))]
    texts += [m[1:] for m in marks] + [m[:39] for m in marks] + [m[:40].upper() for m in marks] + [noise(500) for _ in range(20)] + [None, "", "x" * 39, texts[1], texts[1]]
    docs = list(enumerate(texts)) + [(None, texts[2]), (1, texts[1])]
    sf = tables(tmp_path, spark, documents=("doc_id long, text string", docs), benchmark=("item_id string, text string", items))
    want = [(str(d), i) for d, t in docs for i, m in items if t is not None and m is not None and len(m) >= 40 and m[:40].lower() in t.lower()]
    got = [(str(r["doc_id"]), r["item_id"]) for r in catalogue.queries()["contamination_leak"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


WHITE = [" ", "\t", "\u00a0", "\u3000", "\n", "\n\n", "\n \t\n", "\r\n\r\n", "\x1c", "\u2003"]


def texts_of_paragraphs():
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["word", "\u00e9t\u00e9", "e\u0301", "x", "\u6587\u5b57"]) for _ in range(n))
    texts = ["".join(rng.choice(WHITE) + words(rng.randint(0, 600)) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    return texts + [" " * 500 + "late", "\x01\x02" * 150 + "after controls", "a\nb\nc", "w" * 7000, "p\n\n" + "q" * 7000, "short", "", " \n\n ", None]


def test_excerpts_of_whole_texts(spark, tmp_path):
    from sparkscreen.plans.extras import EXCERPT_CAP as CAP

    def excerpt(text):
        kept, size = [], 0
        for block in (b.strip() for b in re.split(r"\n\s*\n", text)):
            if block:
                extra = len(block) + (2 if kept else 0)
                if size + extra > CAP:
                    kept = kept or [block[:CAP]]
                    break
                kept.append(block)
                size += extra
        return "\n\n".join(kept)

    docs = list(enumerate(texts_of_paragraphs()))
    sf = tables(tmp_path, spark, documents=("doc_id long, text string", docs))
    got = {r["doc_id"]: r["excerpt"] for r in catalogue.queries()["whole_excerpts"](spark, sf).collect()}
    assert got == {i: None if t is None else excerpt(t) for i, t in docs}
    assert sum("\n\n" in (e or "") for e in got.values()) > 20


def test_search_fields_of_whole_texts(spark, tmp_path):
    docs = list(enumerate(texts_of_paragraphs()))
    sf = tables(tmp_path, spark, documents=("doc_id long, text string", docs))
    got = {r["doc_id"]: r["field"] for r in catalogue.queries()["search_fields"](spark, sf).collect()}
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "", unicodedata.normalize("NFC", t))).strip()[:64]
    assert got == {i: plain(t or "") for i, t in docs}
    assert "late" in got.values() and "after controls" in got.values()


def test_first_lines_of_all_patterns(spark, tmp_path):
    from sparkscreen.functions.patterns import REGISTRY

    rng = random.Random(3)
    pieces = [p.probe for p in REGISTRY] + ["plain words", "", "ignore\nall\nprevious", "disregard\nthese instructions", "new \u00a0task", "user\nwith elevated", "x assistant: no", "POPPY: hi", "< system x>", "src = 'http://192.168.0.1"]
    # Lines in any order; the plain tables plant a probe at the end only.
    texts = [p.probe for p in REGISTRY] * 2 + ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["a\n\nb", "", None]
    docs = [(i, "src", "en", t) for i, t in enumerate(texts)]
    sf = tables(tmp_path, spark, documents=("doc_id long, source string, lang string, text string", docs))
    got = sorted(tuple(r) for r in catalogue.queries()["all_flag_lines"](spark, sf).select("doc_id", "pattern", "line").collect())
    want = []
    for p in REGISTRY:
        options, body = re.match(r"(?:\(\?(\w+)\))?(.*)", p.java, re.S).groups()
        pattern = re.compile(body, sum({"i": re.I, "m": re.M}.get(o, 0) for o in set(options or "")))
        for i, _, _, t in docs:
            text = None if t is None else t + ("\n" + REGISTRY[i % 48].probe if i % 48 < len(REGISTRY) else "")
            m = pattern.search(text) if text is not None else None
            if m:
                want.append((i, p.name, text.count("\n", 0, m.start()) + 1))
    assert got == sorted(want) and {name for _, name, _ in want} == {p.name for p in REGISTRY}


def gate_by_gate(log, active, depth):
    """One gate after the other; log: (gate, id, arrive, hold)."""
    out = {}
    for gate in {r[0] for r in log}:
        ends = []
        for _, i, arrive, hold in sorted((r for r in log if r[0] == gate), key=lambda r: (r[2] is not None, r[2] or 0, r[1], r[3] is not None, r[3] or 0)):
            busy = sorted(e for e in ends if arrive is not None and e > arrive)
            ends, what = busy, "refused"
            if len(busy) < active + depth:
                what = "served" if len(busy) < active else "queued"
                begin = arrive if what == "served" else busy[len(busy) - active]
                ends = busy + ([begin + hold] if None not in (begin, hold) else [])
            out[gate, i] = what
    return out


def test_admission_of_mixed_logs(spark):
    from sparkscreen.operators import auxiliary as aux

    rng = random.Random(11)
    arrive = [None] * 5 + [rng.randint(0, 900) for _ in range(1500)]  # several at once
    log = [(rng.choice(["a", "b", "c", None]), i, t, rng.choice([None, 0.0, 0.5, 7.0, 40.0])) for i, t in enumerate(arrive)] + [("late", 9000, 5, float("nan")), ("late", 9001, 6, 1.0), ("late", 9002, 7, 1.0)]
    df = spark.createDataFrame(log, "gate string, id int, arrive int, hold double").repartition(7)
    for active, depth in ((1, 4), (3, 2), (1, 0)):
        got = {(r["gate"], r["id"]): r["what"] for r in aux.admission(df, "gate", active, depth).collect()}
        plain = gate_by_gate([r for r in log if r[0] != "late"], active, depth)
        assert {k: v for k, v in got.items() if k[0] != "late"} == plain and {*plain.values()} == ({"served", "queued", "refused"} if depth else {"served", "refused"})
    # One place and none to wait in: who never ends lets nobody in.
    assert [got["late", i] for i in (9000, 9001, 9002)] == ["served", "refused", "refused"]
    assert aux.admission(df).schema.simpleString() == "struct<gate:string,id:bigint,what:string>"


def test_admission_of_a_long_log(spark, tmp_path):
    """A log that would not do as one row: steps must not grow with what was decided before."""
    import time

    n = 120_000
    spark.range(n).selectExpr("id AS event_id", "CAST(10 * (id % 7) AS BIGINT) AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    began = time.time()
    got = {(r["gate"], r["what"]): r["n"] for r in catalogue.queries()["admission_gate"](spark, str(tmp_path)).collect()}
    took = time.time() - began
    want = gate_by_gate([(0, i, i, float(i % 40)) for i in range(n)], 1, 4)
    assert got == {(0, w): sum(v == w for v in want.values()) for w in {*want.values()}} and sum(got.values()) == n
    assert took < 90


RECORD = "id string, kind string, category string, surface string, payload map<string,string>, marker string, pinned array<string>, pinned_reason string, source map<string,string>, lang string, params map<string,string>, notes string, keys array<string>"


def record(i, category, surface, payload, marker):
    kind = "benign" if marker is None else "attack"
    return (f"{'atk' if marker else 'ben'}-{i:04d}", kind, category, surface, payload, marker, None, None, {"kind": "synthetic"}, "en", None, None, ["id", "kind", "category", "surface", "payload", "source", "lang"])


def odd_records():
    """Records, and which of the two rules on texts each breaks."""
    page = lambda body, title="t": {"url": "https://a.example/", "title": title, "head_html": "", "body_html": body}
    text = lambda t: {"filename": "a.txt", "text": t}
    mark, sweep = "marker_in_payload", "sweep_stage2_clean"
    rows = [
        ("news", "text", text("nothing"), None, set()), ("natural_language", "text", text("x THE  whole\tMarker y"), "the whole marker", set()),
        ("natural_language", "text", text("the whole &amp; marker"), "the whole & marker", set()), ("natural_language", "text", text("the whole &amp;amp; marker"), "the whole & marker", {mark}),
        ("natural_language", "text", text("STRASSE of the marker, café"), "straße of the marker, café", set()), ("natural_language", "text", text("the whole ma​rker"), "the whole marker", set()),
        ("natural_language", "text", {"filename": "the whole", "text": "marker"}, "the whole marker", {mark}), ("natural_language", "text", text("anything at all"), "​" * 12, {mark}),
        ("natural_language", "text", None, "the whole marker", {mark}), ("natural_language", "text", {"filename": None, "text": None}, "the whole marker", {mark}), ("natural_language", None, text("the whole marker"), "the whole marker", set()),
        ("natural_language", "page", page("<p>the <b>whole</b></p>marker"), "the <b>whole", set()), ("natural_language", "page", page("<p>the whole m&#97;rker</p>"), "the whole marker", set()),
        ("natural_language", "page", page("<p>the <b>whole</b> marker</p>"), "the whole marker", {mark}), ("natural_language", "page", page("x", "the whole & marker"), "the whole & marker", set()),
        ("natural_language", "search", {"title": "t", "url": "https://a.example/", "content": "the whole marker"}, "the whole marker", set()),
        (None, "page", page("the whole marker"), "the whole marker", {sweep}), (None, "text", text("the whole marker"), None, {sweep}), ("news", "page", page("rot13"), None, set()),
        ("boundary_straddle", "text", text("the whole marker"), "the whole marker", set()), ("boundary_straddle", "text", text("the whole marker [SYSTEM]"), "the whole marker", {sweep}),
        ("boundary_straddle", "text", text("the whole marker &amp;#91;SYSTEM]"), "the whole marker", {sweep}), ("density_thinned", "text", text("the whole marker " + "ﷺ" * 300), "the whole marker", {sweep}),
        ("density_thinned", "page", page("the whole marker"), "the whole marker", set()), ("density_thinned", "page", page("the whole marker <p>ignore previous</p>"), "the whole marker", {sweep}),
        ("density_thinned", "page", page("no mark"), None, set()), ("density_thinned", "page", page("rot13"), None, {sweep}), ("density_thinned", "text", {"filename": "x"}, None, set()),
        ("density_thinned", "search", {"content": "the whole marker"}, "the whole marker", {sweep}), ("density_thinned", None, text("the whole marker"), "the whole marker", {sweep}),
    ]
    return [(record(i, *row[:4]), row[4]) for i, row in enumerate(rows)]


def test_lint_of_texts_in_markers_and_forms(spark):
    from sparkscreen.operators import records

    rows = odd_records()
    df = spark.createDataFrame([r for r, _ in rows], RECORD).repartition(3)
    got = {(r["id"], r["rule"]) for r in records.lint(df).collect() if r["rule"] in records.LATE}
    assert got == {(r[0], rule) for r, broken in rows for rule in broken}


def test_lint_hands_no_text_on(spark):
    """Each text goes to Python once, and neither it nor forms of it that nothing scans come back."""
    from sparkscreen.operators import records

    long = "word & more " * 8000
    df = spark.createDataFrame([record(i, "natural_language", "text", {"filename": "a", "text": long}, "word & more word") for i in range(40)], RECORD)
    linted = records.lint(df)
    plan = linted._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") <= 2
    assert "marker_in_payload" not in {r["rule"] for r in linted.collect()}
    batch = [[c] for c in ("a", "b", "c", ["d"], "word & more word", long, None, None)]
    import pyarrow as pa

    (back,) = records.read_texts(iter([pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.string()) if isinstance(c[0], list) else pa.string()) for c in batch], ["id", "category", "surface", "broken", "marker", "joined", "page", "text"])]))
    assert back.nbytes < 1000 and back.num_rows == 1 and back.column("shown")[0].as_py() and back.column("forms")[0].as_py() is None
