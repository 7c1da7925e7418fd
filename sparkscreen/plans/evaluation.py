"""Queries of the labelled-corpus evaluation suite."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import patterns, pooling
from ..operators import corpus
from ..sources.tables import table
from .registry import SCORED, VERDICTS, planted, query, scored, scores
from .screening import _POOL_SQL

#: Records: labelled documents, toxic ones being attacks; what the verdict says is the outcome.
_RECORDS = f"""{VERDICTS}, {SCORED}, records AS (SELECT v.doc_id, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS kind, v.source AS category, v.lang AS route, v.doc_id % 5 = 0 AS leaked,
CASE WHEN verdict = 'blocked' THEN 'blocked' WHEN {_POOL_SQL["pool_live"]} THEN 'flagged' WHEN v.doc_id % 3 = 0 THEN 'clean' WHEN v.doc_id % 5 = 0 THEN 'leaked' ELSE 'neutralised' END AS outcome
FROM verdicts v JOIN labels USING (doc_id) JOIN scored USING (doc_id))"""


def records(spark, sf_dir):
    docs = planted(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    verdict = patterns.scan(F.col("text"))["verdict"]
    flagged = pooling.live()(scores(F.col("doc_id")))
    leaked = F.col("doc_id") % 5 == 0
    return docs.select("doc_id", F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("kind"), F.col("source").alias("category"), F.col("lang").alias("route"), leaked.alias("leaked"), corpus.outcome(verdict == "blocked", flagged, F.col("doc_id") % 3 != 0, leaked).alias("outcome"))


_ATTACK = """attack AS (SELECT category, route, count(*) AS n, count_if(outcome = 'blocked') AS n_blocked, count_if(outcome = 'flagged') AS n_flagged, count_if(outcome = 'neutralised') AS n_neutralised, count_if(outcome = 'leaked') AS n_leaked,
count_if(outcome = 'blocked' AND leaked) AS n_blocked_leaked FROM records WHERE kind = 'attack' GROUP BY category, route)"""
_BENIGN = "benign AS (SELECT category, route, count(*) AS n, count_if(outcome = 'blocked') AS n_blocked, count_if(outcome = 'flagged') AS n_flagged FROM records WHERE kind = 'benign' GROUP BY category, route)"


@query(f"WITH {_RECORDS}, {_ATTACK} SELECT category, route, n, CAST(n_blocked AS BIGINT) AS n_blocked, CAST(n_flagged AS BIGINT) AS n_flagged, CAST(n_neutralised AS BIGINT) AS n_neutralised, CAST(n_leaked AS BIGINT) AS n_leaked, CAST(n_blocked_leaked AS BIGINT) AS n_blocked_leaked, round((n_blocked + n_flagged) / n::DOUBLE, 6) AS catch_rate, round(n_blocked / n::DOUBLE, 6) AS block_rate FROM attack")
def attack_cells(spark, sf_dir):
    return corpus.attack_cells(records(spark, sf_dir).where("kind = 'attack'"), ["category", "route"])


@query(f"WITH {_RECORDS}, {_BENIGN} SELECT category, route, n, CAST(n_blocked AS BIGINT) AS n_blocked, CAST(n_flagged AS BIGINT) AS n_flagged, round((n_blocked + n_flagged) / n::DOUBLE, 6) AS fpr FROM benign")
def benign_cells(spark, sf_dir):
    return corpus.benign_cells(records(spark, sf_dir).where("kind = 'benign'"), ["category", "route"])


@query(f"""WITH {_RECORDS}, {_ATTACK}, {_BENIGN}, a AS (SELECT route, sum(n) AS attacks, sum(n_blocked + n_flagged) AS caught FROM attack GROUP BY route), b AS (SELECT route, sum(n) AS benign, sum(CASE WHEN category <> 'src0' THEN n END) AS external, sum(CASE WHEN category <> 'src0' THEN n_blocked + n_flagged END) AS external_hits FROM benign GROUP BY route)
SELECT route, CAST(attacks AS BIGINT) AS attacks, CAST(caught AS BIGINT) AS caught, CAST(benign AS BIGINT) AS benign, CAST(external AS BIGINT) AS external, CAST(external_hits AS BIGINT) AS external_hits, round(caught / attacks::DOUBLE, 6) AS catch_all, round(external_hits / external::DOUBLE, 6) AS fpr_external FROM a FULL JOIN b USING (route)""")
def headline(spark, sf_dir):
    r = records(spark, sf_dir)
    keys = ["category", "route"]
    return corpus.headline(corpus.attack_cells(r.where("kind = 'attack'"), keys), corpus.benign_cells(r.where("kind = 'benign'"), keys), ["route"], F.col("category") != "src0")


@query(f"WITH {SCORED}, v AS (SELECT CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS kind, CASE WHEN doc_id % 7 <> 0 THEN scores END AS scores FROM scored JOIN labels USING (doc_id)) SELECT kind, count(*) AS n, count(scores) AS reached, CAST(count_if({_POOL_SQL['pool_max']} AND scores IS NOT NULL) AS BIGINT) AS max_fired, CAST(count_if(scores IS NOT NULL AND {_POOL_SQL['pool_contiguity']}) AS BIGINT) AS run_fired FROM v GROUP BY kind")
def classifier_view(spark, sf_dir):
    rows = scored(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").withColumn("scores", F.when(F.col("doc_id") % 7 != 0, F.col("scores")))
    there = F.col("scores").isNotNull()
    return rows.groupBy(F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("kind")).agg(F.count("*").alias("n"), F.count("scores").alias("reached"), F.count_if(there & pooling.max_score(0.85)(F.col("scores"))).alias("max_fired"), F.count_if(there & pooling.contiguity(2, 0.5)(F.col("scores"))).alias("run_fired"))


def _fires(name: str) -> str:
    """A setting of the sweep in SQL, over ``scores``."""
    rule, numbers = re.match(r"([a-z_]+)(.*)", name).groups()
    n = [float(x) for x in re.findall(r"[0-9.]+", numbers)]
    if rule == "live_contiguity":
        return f"(({_POOL_SQL['pool_max']}) OR ({_POOL_SQL['pool_contiguity']}))"
    if rule == "max":
        return f"coalesce(list_max(scores), 0) > {n[0]}"
    if rule == "contiguity":
        run = " AND ".join(f"scores[i + {k}] >= {n[1]}" for k in range(int(n[0])))
        return f"len(list_filter(range(1, len(scores) - {int(n[0]) - 2}), lambda i: {run})) > 0"
    if rule == "k_anywhere":
        return f"len(list_filter(scores, lambda x: x >= {n[1]})) >= {int(n[0])}"
    if rule == "mean":
        return f"list_sum(scores) / len(scores) >= {n[0]}"
    return f"CASE WHEN len(scores) < 2 THEN list_sum(scores) / len(scores) >= {n[1]} ELSE len(list_filter(range(1, len(scores)), lambda i: (scores[i] + scores[i + 1]) / 2 >= {n[1]})) > 0 END"


_SWEEP = f"""{SCORED}, g AS (SELECT unnest([lang, 'all']) AS "group", scores, len(scores) AS w FROM scored JOIN documents USING (doc_id)),
swept AS (""" + " UNION ALL ".join(f"""SELECT "group", count(*) AS n, '{name}' AS pooler, CAST(count_if({_fires(name)}) AS BIGINT) AS fired, max(w) < {needs} AS not_applicable FROM g GROUP BY "group" """ for name, _, needs in pooling.sweep()) + ")"


@query(f"WITH {_SWEEP} SELECT * FROM swept")
def pool_sweep(spark, sf_dir):
    return corpus.pool_sweep(scored(spark, sf_dir), pooling.sweep(), F.array("lang", F.lit("all")))


@query(f"""WITH {_SWEEP}, r AS (SELECT "group", pooler, CASE WHEN not_applicable THEN 'n/a' ELSE printf('%.4f', round_even(fired / n::DOUBLE, 4)) END AS rate FROM swept)
SELECT pooler, """ + ", ".join(f"""max(CASE WHEN "group" = '{g}' THEN rate END) AS "{g}" """ for g in ("all", "de", "en", "es", "fr")) + " FROM r GROUP BY pooler")
def pool_sweep_table(spark, sf_dir):
    """All settings by group, as a table of rates with n/a where a setting can't apply."""
    rows = corpus.pool_sweep(scored(spark, sf_dir), pooling.sweep(), F.array("lang", F.lit("all")))
    rate = F.when(F.col("not_applicable"), "n/a").otherwise(F.format_string("%.4f", F.bround(F.col("fired") / F.col("n"), 4)))
    return rows.groupBy("pooler").pivot("group", ["all", "de", "en", "es", "fr"]).agg(F.first(rate))


@query(f"WITH {_RECORDS}, {_ATTACK} SELECT category, route, round(floor(round_even((n_blocked + n_flagged) / n::DOUBLE, 4) * 20 + 1e-9) / 20, 2) AS min_catch, round(ceil(round_even(n_blocked / n::DOUBLE, 4) * 20 - 1e-9) / 20, 2) + 0.0::DOUBLE AS block_ceiling FROM attack")
def floors_grid(spark, sf_dir):
    cells = corpus.attack_cells(records(spark, sf_dir).where("kind = 'attack'"), ["category", "route"])
    return cells.select("category", "route", corpus.floor_down((F.col("n_blocked") + F.col("n_flagged")) / F.col("n")).alias("min_catch"), corpus.ceil_up(F.col("n_blocked") / F.col("n")).alias("block_ceiling"))


@query("""WITH o AS (SELECT doc_id AS path, (doc_id % 20) / 20.0::DOUBLE AS v FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS path, (doc_id * 3 % 20) / 20.0::DOUBLE AS v FROM documents WHERE doc_id % 11 <> 0)
SELECT CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN n.v > o.v THEN 'tighten' WHEN n.v < o.v THEN 'loosen' ELSE 'same' END AS change, count(*) AS n FROM o FULL JOIN n USING (path) GROUP BY 1""")
def floors_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    old = d.where("path % 7 <> 0").withColumn("value", (F.col("path") % 20) / F.lit(20.0))
    new = d.where("path % 11 <> 0").withColumn("value", (F.col("path") * 3 % 20) / F.lit(20.0))
    return corpus.floors_diff(old, new).groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH {_RECORDS} SELECT doc_id, route FROM records WHERE outcome IN ('blocked', 'flagged') AND doc_id % 4 = 0")
def regressed(spark, sf_dir):
    old = records(spark, sf_dir)
    new = old.withColumn("outcome", F.when(F.col("doc_id") % 4 == 0, "leaked").otherwise(F.col("outcome")))
    return corpus.regressed(old, new, ["doc_id", "route"])


@query(f"WITH {_RECORDS} SELECT doc_id, route, CASE WHEN doc_id % 6 = 0 AND outcome <> 'blocked' THEN CASE WHEN doc_id % 10 = 0 THEN 'outcome,leaked' ELSE 'outcome' END WHEN doc_id % 10 = 0 THEN 'leaked' END AS changed FROM records WHERE (doc_id % 6 = 0 AND outcome <> 'blocked') OR doc_id % 10 = 0")
def parity_verdicts(spark, sf_dir):
    live = records(spark, sf_dir)
    other = live.withColumn("outcome", F.when(F.col("doc_id") % 6 == 0, "blocked").otherwise(F.col("outcome"))).withColumn("leaked", F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("leaked")))
    return corpus.verdict_changes(live, other, ["doc_id", "route"], ["outcome", "leaked"])


@query(f"""WITH {SCORED}, p AS (SELECT scores AS a, list_transform(scores, lambda s, i: s + (doc_id * i % 10) / 1000.0::DOUBLE) AS b FROM scored),
e AS (SELECT abs(unnest(list_transform(range(1, len(a) + 1), lambda i: a[i] - b[i]))) AS d FROM p)
SELECT CAST((SELECT count_if(len(a) <> len(b)) FROM p) AS BIGINT) AS count_mismatches, round((SELECT max(abs(list_max(a) - list_max(b))) FROM p), 6) AS max_page_drift, round(max(d), 6) AS max_drift, round(quantile_disc(d, 0.99), 6) AS p99_drift FROM e""")
def score_drift(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("other", F.transform("scores", lambda s, i: s + (F.col("doc_id") * (i + 1) % 10) / F.lit(1000.0)))
    return corpus.score_drift(rows)


@query(f"WITH {SCORED} SELECT doc_id FROM scored WHERE len(list_filter(scores, lambda s: abs(s - 0.85) <= 0.01 + 1e-12)) > 0")
def near_threshold(spark, sf_dir):
    return scored(spark, sf_dir).where(corpus.near_threshold(F.col("scores"))).select("doc_id")


@query("SELECT event_type, n, p50, CASE WHEN n >= 5 THEN p95 END AS p95 FROM (SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type)")
def percentile_nearest_rank(spark, sf_dir):
    return corpus.nearest_rank(table(spark, sf_dir, "events"), "value", ["event_type"])


def _cassette(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.array(F.min("doc_id") / F.lit(1.0)).alias("scores"))


@query("WITH c AS (SELECT sha256(text) AS h, min(doc_id) / 1.0::DOUBLE AS s FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT doc_id, coalesce(s, 0.25) AS score FROM documents LEFT JOIN c ON sha256(text) = h")
def replay_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.replayed(d, _cassette(spark, sf_dir), 0.25).select("doc_id", F.col("scores")[0].alias("score"))


@query("WITH c AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM c WHERE sha256(text) = h)")
def replay_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.missing_recordings(d, _cassette(spark, sf_dir)).select("doc_id")


@query("""SELECT doc_id, 'lang_known' AS rule FROM documents WHERE lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, 'long_enough' FROM documents WHERE len(text) < 200
UNION ALL SELECT doc_id, 'unique_id' FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 0) GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'lang_known' FROM documents WHERE doc_id % 50 = 0 AND lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, 'long_enough' FROM documents WHERE doc_id % 50 = 0 AND len(text) < 200""")
def lint_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    d = d.unionByName(d.where("doc_id % 50 = 0"))
    return corpus.lint(d, [("lang_known", F.col("lang").isin("en", "de")), ("long_enough", F.length("text") >= 200)], "doc_id")


@query(r"SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first(spark, sf_dir):
    return corpus.first_of_equal(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT source, doc_id, turn FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '7')) AS INTEGER) AS turn FROM documents)")
def sample_strata(spark, sf_dir):
    return corpus.interleaved(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "7").select("source", "doc_id", "turn")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '7')) AS turn FROM documents) WHERE turn <= 3")
def sample_quota(spark, sf_dir):
    return corpus.quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "7", 3).select("source", "doc_id")


@query("""WITH c AS (SELECT source AS genre, CASE WHEN doc_id % 9 = 0 THEN 'licence' WHEN doc_id % 8 = 0 THEN 'unpinned' WHEN n_chars < 300 THEN 'too_short' END AS reason FROM documents WHERE source <> 'src3'), g AS (SELECT DISTINCT source AS genre FROM documents)
SELECT genre, count(c.genre) AS examined, count(reason) AS rejected, round(count(reason) / nullif(count(c.genre), 0)::DOUBLE, 6) AS rate FROM g LEFT JOIN c USING (genre) GROUP BY genre""")
def candidate_rejection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    reason = corpus.screen_reason(F.when(F.col("doc_id") % 9 != 0, F.lit("CC0")), F.col("doc_id") % 8 != 0, F.lit(False), F.col("n_chars"), F.lit(1.0), 300)
    return corpus.rejections(d.where("source <> 'src3'").select(F.col("source").alias("genre"), reason.alias("reason")), d.select(F.col("source").alias("genre")).distinct())


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(substr(b.text, 1, 40))) WHERE len(b.text) >= 40")
def contamination_leak(spark, sf_dir):
    """Markers of the benchmark in documents."""
    return corpus.documents_with_markers(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 40)


@query(f"WITH {_RECORDS} SELECT category, count(DISTINCT doc_id) AS ids, count(DISTINCT route) AS langs FROM records GROUP BY category HAVING count(DISTINCT doc_id) >= 5")
def corpus_size(spark, sf_dir):
    return records(spark, sf_dir).groupBy("category").agg(F.countDistinct("doc_id").alias("ids"), F.countDistinct("route").alias("langs")).where("ids >= 5")


@query(f"WITH {_RECORDS} SELECT DISTINCT doc_id FROM records WHERE outcome = 'leaked' OR (outcome = 'blocked' AND leaked)")
def leaked_ids(spark, sf_dir):
    return records(spark, sf_dir).where("outcome = 'leaked' or (outcome = 'blocked' and leaked)").select("doc_id").distinct()


@query(f"WITH {SCORED} SELECT CAST(len(scores) AS INTEGER) AS windows, count(*) AS n FROM scored GROUP BY 1")
def window_histogram(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.size("scores").alias("windows")).agg(F.count("*").alias("n"))
