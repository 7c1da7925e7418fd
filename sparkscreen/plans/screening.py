"""Queries on texts and pages: normalisation, patterns, verdicts, HTML, structure."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, pooling, text
from ..operators import forms, html, structure
from ..sources.tables import table
from .registry import COUNTS, PLANTED, SCORED, VERDICTS, planted, query, quoted, scored, scores, sql_pattern

_COLLAPSED = r"""trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(translate({}, chr(8203) || chr(8204) || chr(8205) || chr(8206) || chr(8207) || chr(8238) || chr(65279) || chr(8288) || chr(173), ''), '[^\S\n]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, md5(t) AS digest, CAST(len(t) AS INTEGER) AS chars FROM (SELECT doc_id, {_COLLAPSED.format('nfc_normalize(text)')} AS t FROM documents)")
def normalize_documents(spark, sf_dir):
    t = text.normalize(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query(r"SELECT doc_id, md5(regexp_replace(chr(7) || text || chr(13), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g')) AS digest FROM documents")
def strip_controls(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.strip_controls(F.concat(F.lit("\x07"), "text", F.lit("\r")))).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'empty' WHEN doc_id % 10 = 2 THEN 'controls' END AS refusal, CASE WHEN doc_id % 10 = 3 THEN 'pdf' ELSE 'html' END AS kind FROM documents")
def upload_text_gate(spark, sf_dir):
    changed = F.when(F.col("doc_id") % 10 == 1, F.lit("  \n")).when(F.col("doc_id") % 10 == 2, F.lit("a\x01\x02")).when(F.col("doc_id") % 10 == 3, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", text.upload_refusal(changed).alias("refusal"), text.content_type(F.lit(None).cast("string"), changed).alias("kind"))


@query(f"WITH {PLANTED} SELECT doc_id, {COUNTS} FROM planted")
def pattern_hits(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", *[c.cast("bigint").alias(p.name) for c, p in zip(patterns.hits(F.col("text")), patterns.REGISTRY, strict=True)])


@query(f"WITH {VERDICTS} SELECT doc_id, verdict, round(penalty, 6) AS penalty, nb + ns AS n_flags FROM verdicts")
def structural_verdict(spark, sf_dir):
    s = planted(spark, sf_dir).select("doc_id", patterns.scan(F.col("text")).alias("s"))
    return s.select("doc_id", "s.verdict", F.round("s.penalty", 6).alias("penalty"), F.size("s.flags").cast("bigint").alias("n_flags"))


@query(f"WITH {VERDICTS} SELECT source, lang, verdict, count(*) AS n, round(sum(penalty), 6) AS penalty FROM verdicts GROUP BY ROLLUP (source, lang, verdict)")
def verdict_by_source_lang(spark, sf_dir):
    counts = patterns.hits(F.col("text"))
    sums = {k: sum((F.col(p.name) for p in patterns.REGISTRY if p.category in c), F.lit(0)) for k, c in (("nb", patterns.BLOCKING), ("ns", patterns.SUSPICIOUS))}
    rows = planted(spark, sf_dir).select("source", "lang", *counts).select("source", "lang", *[c.alias(k) for k, c in sums.items()])
    v = patterns.verdict_from_counts(F.col("nb"), F.col("ns"))
    rows = rows.select("source", "lang", v.alias("verdict"), F.when((F.col("nb") > 0) | (F.col("ns") == 0), 0.0).otherwise(F.greatest(F.lit(-0.45), F.lit(-0.15) * F.col("ns"))).alias("penalty"))
    return rows.rollup("source", "lang", "verdict").agg(F.count("*").alias("n"), F.round(F.sum("penalty"), 6).alias("penalty"))


@query(f"WITH {PLANTED}, e AS (SELECT doc_id, " + ", ".join(f"regexp_matches(text, {quoted(sql_pattern(i))}) AS e{i}" for i in (1, 22)) + " FROM planted) SELECT doc_id, e1 AS disregard, e22 AS exfil FROM e")
def pattern_lookaround(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", F.col("text").rlike(patterns.REGISTRY[1].java).alias("disregard"), F.col("text").rlike(patterns.REGISTRY[22].java).alias("exfil"))


_FIRST_LINES = " UNION ALL ".join(f"SELECT doc_id, {quoted(p.name)} AS pattern, CAST(len(string_split(split_part(text, regexp_extract(text, {quoted(sql_pattern(p.index))}), 1), chr(10))) AS INTEGER) AS line FROM planted WHERE regexp_matches(text, {quoted(sql_pattern(p.index))})" for p in patterns.REGISTRY if p.index in (0, 3, 6, 13, 17, 20))


@query(f"WITH {PLANTED} {_FIRST_LINES}")
def flag_lines(spark, sf_dir):
    return _first_lines(spark, sf_dir, [p for p in patterns.REGISTRY if p.index in (0, 3, 6, 13, 17, 20)])


@query()
def all_flag_lines(spark, sf_dir):
    """Of every pattern of the registry."""
    return _first_lines(spark, sf_dir, patterns.REGISTRY)


def _first_lines(spark, sf_dir, registry):
    rows = [F.struct(F.lit(p.name).alias("pattern"), F.when(F.col("text").rlike(p.java), F.get(patterns._lines(F.col("text"), p.java), F.lit(0))).alias("line")) for p in registry]
    return planted(spark, sf_dir).select("doc_id", F.explode(F.array(*rows)).alias("r")).where("r.line is not null").select("doc_id", "r.pattern", "r.line")


@query(f"WITH {VERDICTS}, raw AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)rot13') THEN 'suspicious' ELSE 'clean' END AS first FROM planted) SELECT doc_id, CASE WHEN verdict = 'blocked' THEN 'blocked' WHEN first = 'suspicious' OR verdict = 'suspicious' THEN 'suspicious' ELSE 'clean' END AS verdict, CASE WHEN verdict = 'blocked' THEN 0.0 WHEN first = 'suspicious' THEN -0.15 ELSE round(penalty, 6) END AS penalty FROM verdicts JOIN raw USING (doc_id)")
def combine_forms(spark, sf_dir):
    """The first of equally bad scans keeps its penalty: a narrow scan, then the whole one."""
    rot = F.filter(patterns.flags(F.regexp_substr(F.col("text"), F.lit("(?i)rot13"))), lambda f: f["category"] == "encoded_payload")
    narrow = patterns.verdict_of(F.coalesce(rot, F.array().cast(f"array<{patterns.FLAG}>")))
    s = planted(spark, sf_dir).select("doc_id", patterns.combine(narrow, patterns.scan(F.col("text"))).alias("s"))
    return s.select("doc_id", "s.verdict", F.round("s.penalty", 6).alias("penalty"))


_MARKUP = [f"regexp_matches(h, {quoted(sql_pattern(i))})" for i in (4, 21, 23)]


@query(f"SELECT page_id, CASE WHEN {_MARKUP[0]} THEN 'blocked' WHEN {_MARKUP[1]} OR {_MARKUP[2]} THEN 'suspicious' ELSE 'clean' END AS verdict FROM (SELECT page_id, regexp_replace(html || CASE page_id % 3 WHEN 0 THEN '<a href = \"http://10.0.0.1/\">' WHEN 1 THEN '</retrieval_note>' ELSE '' END, '\\s+', ' ', 'g') AS h FROM pages)")
def raw_markup_scan(spark, sf_dir):
    more = F.when(F.col("page_id") % 3 == 0, '<a href = "http://10.0.0.1/">').when(F.col("page_id") % 3 == 1, "</retrieval_note>").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", patterns.scan_markup(F.concat("html", more))["verdict"].alias("verdict"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title_column(F.col("html")).alias("title"))


@query()
def page_extraction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.extract_html("html").alias("x")).select("page_id", "x.title", "x.author", "x.date", "x.raw_text", "x.scan_text_inline", "x.main_content", "x.word_count", "x.main_content_is_fallback")


@query("SELECT page_id, CAST(page_id % 6 < 5 AS BOOLEAN) AS pruned, CAST(false AS BOOLEAN) AS secret_seen FROM pages")
def visibility_prune(spark, sf_dir):
    hides = ("hidden", "aria-hidden='true'", "style='display:none'", "style='position:absolute; left:-9999px'", "style='font-size:0'")
    attr = F.element_at(F.array(*[F.lit(h) for h in hides], F.lit("")), (F.col("page_id") % 6 + 1).cast("int"))
    page = F.concat(F.lit("<html><body><p>seen</p><div "), attr, F.lit(">"), F.when(F.col("page_id") % 6 < 5, "SECRET").otherwise("plain"), F.lit("</div></body></html>"))
    v = table(spark, sf_dir, "pages").select("page_id", html.visible_text(page).alias("v"))
    return v.select("page_id", "v.pruned", F.contains("v.visible_text", F.lit("SECRET")).alias("secret_seen"))


@query()
def scan_forms(spark, sf_dir):
    """Verdict over all forms of look-alike, entity-coded and plain probes."""
    rows = planted(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.translate("text", "oeac", "оеас")).otherwise(F.replace("text", F.lit("<"), F.lit("&amp;lt;"))).alias("t"))
    f = rows.select("doc_id", forms.text_forms("t").alias("f"))
    return f.select("doc_id", F.size("f.forms").alias("n_forms"), "f.refused", patterns.scan_forms(F.col("f.forms"), F.col("f.refused"))["verdict"].alias("verdict"))


@query("SELECT doc_id, doc_id % 4 = 0 AS refused FROM documents")
def fold_refusal(spark, sf_dir):
    """A code point that composition makes 18 long is refused when there are many of it."""
    t = F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("ﷺ"), 300)).otherwise(F.lit("plain"))
    return docs(spark, sf_dir).select("doc_id", forms.text_forms(t)["refused"].alias("refused"))


_SHAPES = " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in patterns.SECRET_SHAPES.values())


@query(f"SELECT doc_id, {_SHAPES} AS has_secret FROM documents")
def secret_shapes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", patterns.has_secret_shape(F.col("text")).alias("has_secret"))


@query(f"""WITH {PLANTED}, first AS (SELECT doc_id, coalesce(CASE {' '.join(f"WHEN regexp_matches(text, {quoted(sql_pattern(p.index))}) THEN {quoted(p.category)}" for p in patterns.REGISTRY)} END, 'natural_language') AS category FROM planted) SELECT category, count(*) AS n FROM first GROUP BY category""")
def ingest_category(spark, sf_dir):
    return planted(spark, sf_dir).select(patterns.ingest_category(patterns.flags(F.col("text"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS n FROM documents),
w AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448.0) AS BIGINT) + 1 END AS windows FROM t),
e AS (SELECT doc_id, n, unnest(range(0, windows)) AS k FROM w)
SELECT doc_id, CAST(k AS INTEGER) AS pos, CAST(448 * k AS INTEGER) AS start, CAST(least(512, n - 448 * k) AS INTEGER) AS n FROM e""")
def token_windows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.token_windows(F.col("text"))).alias("pos", "w")).select("doc_id", "pos", "w.start", "w.n")


@query("SELECT doc_id, CAST(least(8, greatest(1, CASE WHEN ceil(n_chars / 4.5) <= 512 THEN 1 ELSE ceil((ceil(n_chars / 4.5) - 512) / 448.0) + 1 END)) AS INTEGER) AS estimate, n_chars > 114688 AS too_long FROM documents")
def windows_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.windows_estimate(F.col("n_chars")).alias("estimate"), text.too_long(F.col("text")).alias("too_long"))


_POOL_SQL = {
    "pool_max": "coalesce(list_max(scores), 0) > 0.85",
    "pool_k_anywhere": "len(list_filter(scores, lambda x: x >= 0.5)) >= 2",
    "pool_mean": "len(scores) > 0 AND list_sum(scores) / len(scores) >= 0.5",
    "pool_contiguity": "len(list_filter(range(1, len(scores)), lambda i: scores[i] >= 0.5 AND scores[i + 1] >= 0.5)) > 0",
    "pool_smoothed": "CASE WHEN len(scores) < 2 THEN list_sum(scores) / len(scores) >= 0.5 ELSE len(list_filter(range(1, len(scores)), lambda i: (scores[i] + scores[i + 1]) / 2 >= 0.5)) > 0 END",
}
_POOL_SQL["pool_live"] = f"({_POOL_SQL['pool_max']}) OR ({_POOL_SQL['pool_contiguity']})"
_POOLERS = {
    "pool_max": pooling.max_score(0.85), "pool_k_anywhere": pooling.k_anywhere(2, 0.5), "pool_mean": pooling.mean_at_least(0.5), "pool_contiguity": pooling.contiguity(2, 0.5),
    "pool_smoothed": pooling.smoothed(2, 0.5), "pool_live": pooling.live(),
}


def _pool(name: str, pooler) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir).select("doc_id", pooler(F.col("scores")).alias("fired"))

    run.__name__ = name
    query(f"WITH {SCORED} SELECT doc_id, {_POOL_SQL[name]} AS fired FROM scored")(run)


for _name, _pooler in _POOLERS.items():
    _pool(_name, _pooler)


@query(f"WITH {SCORED}, e AS (SELECT doc_id, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS pos FROM scored), i AS (SELECT *, sum(CASE WHEN s < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM e) SELECT doc_id, count(*) AS n_runs, max(n) AS longest FROM (SELECT doc_id, island, count(*) AS n FROM i WHERE s >= 0.5 GROUP BY doc_id, island) WHERE n >= 2 GROUP BY doc_id")
def contiguity_islands(spark, sf_dir):
    from pyspark.sql import Window

    e = scored(spark, sf_dir).select("doc_id", F.posexplode("scores").alias("pos", "s"))
    i = e.withColumn("island", F.sum((F.col("s") < 0.5).cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    runs = i.where("s >= 0.5").groupBy("doc_id", "island").agg(F.count("*").alias("n")).where("n >= 2")
    return runs.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN m AND c THEN 'both' WHEN m THEN 'max_score' WHEN c THEN 'contiguity' ELSE 'none' END AS rule FROM (SELECT doc_id, {_POOL_SQL['pool_max']} AS m, {_POOL_SQL['pool_contiguity']} AS c FROM scored)")
def stage3_rule(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", pooling.rule_of(F.col("scores")).alias("rule"))


@query(f"""WITH {SCORED}, f AS (SELECT doc_id, list_filter(range(1, len(scores) + 1), lambda i: (list_max(scores) > 0.85 AND scores[i] = list_max(scores)) OR (scores[i] >= 0.5 AND ((i > 1 AND scores[greatest(i - 1, 1)] >= 0.5) OR coalesce(scores[i + 1], 0) >= 0.5))) AS w FROM scored)
SELECT doc_id, array_to_string(list_transform(w, lambda i: i - 1), ',') AS windows FROM f""")
def flagged_windows(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.array_join(pooling.flagged_windows(F.col("scores")), ",").alias("windows"))


_TIER_SQL = "CASE doc_id % 5 WHEN 0 THEN 'trusted' WHEN 1 THEN 'verified' WHEN 2 THEN 'standard' WHEN 3 THEN 'untrusted' ELSE 'blocked' END"
_STATE_SQL = f"""
{VERDICTS}, {SCORED},
t AS (SELECT v.doc_id, verdict, penalty, {_TIER_SQL.replace("doc_id", "v.doc_id")} AS tier, CASE WHEN v.doc_id % 7 = 0 THEN NULL ELSE scores END AS scores, v.doc_id % 2 = 0 AS fc, v.doc_id % 3 = 0 AS changed FROM verdicts v JOIN scored USING (doc_id)),
s AS (SELECT *, CASE WHEN tier = 'trusted' THEN 'skipped_trusted' WHEN verdict = 'blocked' THEN 'structural_blocked' WHEN scores IS NULL THEN CASE WHEN fc AND tier IN ('standard', 'untrusted') THEN 'unavailable_blocked' ELSE 'unavailable_allowed' END ELSE 'scanned' END AS state, coalesce({_POOL_SQL["pool_live"]}, false) AS fired FROM t),
p AS (SELECT *, CASE WHEN state = 'scanned' THEN fired ELSE state = 'unavailable_blocked' END AS detected, CASE state WHEN 'scanned' THEN CASE WHEN fired THEN -0.5 ELSE 0 END WHEN 'unavailable_blocked' THEN -0.5 WHEN 'unavailable_allowed' THEN -0.1 ELSE 0 END::DOUBLE AS p3 FROM s)
"""


def _screened(spark, sf_dir) -> DataFrame:
    rows = planted(spark, sf_dir).select("doc_id", patterns.scan(F.col("text")).alias("scan"))
    tier = F.element_at(F.array(*map(F.lit, structure.TIERS)), (F.col("doc_id") % 5 + 1).cast("int"))
    s = F.when(F.col("doc_id") % 7 != 0, scores(F.col("doc_id")))
    rows = rows.withColumn("tier", tier).withColumn("scores", s)
    fired = F.coalesce(pooling.live()(F.col("scores")), F.lit(False))
    return rows.withColumn("c", structure.classifier_outcome(F.col("tier"), F.col("scan.verdict"), F.col("scores"), fired, F.col("doc_id") % 2 == 0))


@query(f"WITH {_STATE_SQL} SELECT doc_id, state, round(greatest(0, least(1, CASE tier WHEN 'trusted' THEN 0.95 WHEN 'verified' THEN 0.85 WHEN 'standard' THEN 0.70 WHEN 'untrusted' THEN 0.40 ELSE 0 END::DOUBLE + penalty + p3 + CASE WHEN changed THEN -0.1 ELSE 0 END)), 6) AS trust_score FROM p")
def trust_score(spark, sf_dir):
    rows = _screened(spark, sf_dir)
    return rows.select("doc_id", "c.state", F.round(structure.trust_score(F.col("tier"), F.col("scan.penalty"), F.col("c.penalty"), F.col("doc_id") % 3 == 0), 6).alias("trust_score"))


@query(f"WITH {_STATE_SQL} SELECT diagnostic, count(*) AS n, count(title) AS titled, CAST(sum(CASE WHEN body = 'Content quarantined due to potential prompt injection.' THEN 1 ELSE 0 END) AS BIGINT) AS quarantined FROM (SELECT d, CASE WHEN d IS NULL THEN 't' END AS title, CASE WHEN d IS NULL THEN 'b' ELSE 'Content quarantined due to potential prompt injection.' END AS body, d AS diagnostic FROM (SELECT CASE WHEN verdict = 'blocked' THEN 'structural_blocked' WHEN state = 'unavailable_blocked' THEN 'promptguard_unavailable' WHEN detected THEN 'injection_detected' END AS d FROM p)) GROUP BY diagnostic")
def quarantine(spark, sf_dir):
    rows = _screened(spark, sf_dir).select(structure.quarantine(F.lit("t"), F.lit("b"), F.lit("n"), F.col("scan.verdict"), F.col("c.state"), F.col("c.detected")).alias("q"))
    return rows.groupBy("q.diagnostic").agg(F.count("*").alias("n"), F.count("q.title").alias("titled"), F.sum((F.col("q.body") == structure.QUARANTINE_BODY).cast("bigint")).alias("quarantined"))


#: The marked patterns in the SQL engine's dialect, which has no flags for Unicode classes.
_KEEP_SQL = " OR ".join(f"regexp_matches(p, {quoted(re.sub(r'^[(][?]([a-zA-Z]+)[)]', lambda m: ''.join(x for x in m[1] if x in 'im') and '(?' + ''.join(x for x in m[1] if x in 'im') + ')', k))})" for k in structure.KEEP)


@query(rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS blank, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS single, text FROM documents),
paras AS (SELECT doc_id, CASE WHEN len(blank) <= 1 AND contains(text, chr(10)) THEN single ELSE blank END AS ps FROM b),
e AS (SELECT doc_id, len(ps) AS total, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM paras),
k AS (SELECT doc_id, p, i, (i = 1 OR i = total OR {_KEEP_SQL}) AS keep FROM e)
SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, md5(string_agg(CASE WHEN keep THEN p END, chr(10) || chr(10) ORDER BY i)) AS digest, CAST(coalesce(sum(CASE WHEN NOT keep THEN len(regexp_split_to_array(p, '[ \n]+')) END), 0) AS BIGINT) AS words_gone FROM k GROUP BY doc_id""")
def summary_paragraphs(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", structure.summary(F.col("text"), F.lit(False)).alias("s")).select("doc_id", "s", F.col("s.paragraphs").alias("n")).where("n > 0")
    words = F.aggregate("s.classes", F.lit(0), lambda a, c: a + c["words"])
    return s.select("doc_id", F.col("n").cast("bigint").alias("n_paragraphs"), F.size("s.kept").cast("bigint").alias("n_kept"), F.md5("s.summary").alias("digest"), words.cast("bigint").alias("words_gone"))


@query("SELECT doc_id, 'Content extracted from 60 word page. Summary preserves statistics, quotes, and referenced claims. Omitted: ' || CASE doc_id % 2 WHEN 0 THEN 'cookie/privacy notices (4 words), general content (3 words)' ELSE 'general content (7 words)' END || '. Use extract_mode=''full'' to retrieve complete content.' AS notice FROM documents")
def summary_notice(spark, sf_dir):
    t = F.lit("First stays.\n\nHere we use cookies\n\nplain words here\n\nLast stays.")
    return docs(spark, sf_dir).select("doc_id", structure.notice(structure.summary(t, F.col("doc_id") % 2 == 0)["classes"], F.lit(60)).alias("notice"))


@query(r"SELECT doc_id, round(CASE WHEN len(d) > 0 THEN len(regexp_replace(d, '[^\p{L}]', '', 'g')) / len(d)::DOUBLE ELSE 0 END, 6) AS share FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS d FROM documents)")
def alpha_share(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(text.alpha_share(F.col("text")), 6).alias("share"))


_VOTES = ", ".join(f"len(list_intersect(w, [{', '.join(map(quoted, words))}])) AS {k}" for k, words in text.COMMON_WORDS.items())


@query(rf"WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS w FROM documents), v AS (SELECT doc_id, {_VOTES} FROM w), m AS (SELECT *, greatest(en, fr, de, es) AS top FROM v) SELECT voted, count(*) AS n FROM (SELECT CASE WHEN top < 2 THEN 'und' WHEN en = top THEN 'en' WHEN fr = top THEN 'fr' WHEN de = top THEN 'de' ELSE 'es' END AS voted FROM m) GROUP BY voted")
def lang_vote(spark, sf_dir):
    v = docs(spark, sf_dir).select("doc_id", *text.language_votes(F.col("text")))
    return v.groupBy(text.language({k: F.col(k) for k in text.COMMON_WORDS}).alias("voted")).agg(F.count("*").alias("n"))


@query("SELECT lower(role) AS role, count(*) AS n FROM conversations WHERE lower(role) IN ('assistant', 'system') GROUP BY lower(role)")
def role_lines(spark, sf_dir):
    """Turns written as lines with their role in front: the line patterns find assistant and system."""
    a, s = (F.col("line").rlike(patterns.REGISTRY[i].java) for i in (8, 10))
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("x\n"), "role", F.lit(": ")).alias("line"))
    return rows.select(F.when(a, "assistant").when(s, "system").alias("role")).where("role is not null").groupBy("role").agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d),
b AS (SELECT doc_id, arg_max(x, len(x) * 100000 - i) AS best FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(best) < 12 THEN NULL WHEN len(best) <= 60 THEN best WHEN contains(best[1:60], ' ') THEN regexp_replace(best[1:60], ' [^ ]*$', '') ELSE best[1:60] END AS marker FROM b""")
def marker_choice(spark, sf_dir):
    from ..operators.corpus import marker_of

    return docs(spark, sf_dir).select("doc_id", marker_of(F.col("text")).alias("marker"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2024-02-29' WHEN doc_id % 4 = 1 THEN '1999-12-31' END AS day FROM documents")
def calendar_dates(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, ("2024-02-29", "1999-12-31", "2023-02-29", "20240229"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", structure.calendar_date(v).alias("day"))
