"""Queries on corpus records, attribution and changes, over records made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pooling
from ..operators import attribution, records
from ..sources.tables import table
from .registry import SCORED, query, scored
from .screening import _POOL_SQL


def made_records(spark, sf_dir):
    """A text record a document; what is wrong with it follows from its id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    i = F.col("doc_id")
    attack = i % 2 == 0
    pick = lambda n, value, other: F.when(i % n == 0, F.lit(value)).otherwise(other)
    first = F.trim(F.substring("text", 1, 40))
    return d.select(
        F.concat(pick(11, "bad-", F.when(attack, "atk-").otherwise("ben-")), F.lpad((i % 10000).cast("string"), 4, "0")).alias("id"),
        F.when(attack, "attack").otherwise("benign").alias("kind"),
        pick(13, "nowhere", F.when(attack, "natural_language").otherwise("news")).alias("category"),
        pick(17, "voice", F.lit("text")).alias("surface"),
        F.create_map(F.lit("filename"), F.lit("a.txt"), F.lit("text"), F.concat("text", pick(19, " FAKEKEY-123456789", F.lit("")))).alias("payload"),
        F.when(attack, F.when(i % 14 == 0, "nowhere to be found").when(i % 10 == 0, "short").otherwise(F.concat(first, F.lit("")))).alias("marker"),
        F.when(i % 23 == 0, F.array(F.lit("blocked"), F.lit("blocked"))).alias("pinned"),
        F.when(i % 29 == 0, F.lit("why")).alias("pinned_reason"),
        F.when(i % 31 == 0, F.create_map(F.lit("kind"), F.lit("third_party"))).otherwise(F.create_map(F.lit("kind"), F.lit("synthetic"))).alias("source"),
        pick(37, "english", F.lit("en")).alias("lang"),
        F.when(i % 41 == 0, F.create_map(F.lit("other"), F.lit("1"))).when(i % 43 == 0, F.create_map(F.lit("carrier"), F.lit("pigeon"))).alias("params"),
        F.lit(None).cast("string").alias("notes"),
        F.when(i % 47 == 0, F.array(*map(F.lit, ("kind", "id", "category", "surface", "payload", "source", "lang")))).otherwise(F.array(*map(F.lit, ("id", "kind", "category", "surface", "payload", "source", "lang")))).alias("keys"),
    )


_SHAPE = r"(hf_[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}|sk-ant-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:(api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}))"
_RULES = {
    "key_order": "doc_id % 47 = 0", "id_prefix": "doc_id % 11 = 0", "category": "doc_id % 13 = 0", "payload_keys": "doc_id % 17 = 0",
    "marker_iff_attack": "doc_id % 2 = 0 AND (len(m) < 12 OR contains(m, chr(10)))", "marker_in_payload": "doc_id % 2 = 0 AND (m = '' OR (doc_id % 14 = 0 AND NOT contains(text, m)) OR (doc_id % 14 <> 0 AND doc_id % 10 = 0 AND NOT contains(lower(text), m)))",
    "pinned": "doc_id % 23 = 0", "pinned_reason": "(doc_id % 23 = 0) <> (doc_id % 29 = 0)", "secret_shapes": f"doc_id % 19 = 0 OR regexp_matches(text, '{_SHAPE.replace(chr(39), chr(39) * 2)}')", "sizes": "doc_id % 17 <> 0 AND len(text) + CASE WHEN doc_id % 19 = 0 THEN 18 ELSE 0 END > 114688",
    "lang": "doc_id % 37 = 0", "source": "doc_id % 31 = 0", "params_keys": "doc_id % 41 = 0 OR (doc_id % 43 = 0 AND doc_id % 13 = 0)", "params_values": "doc_id % 43 = 0 AND doc_id % 41 <> 0",
}


@query(
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 14 = 0 THEN 'nowhere to be found' WHEN doc_id % 10 = 0 THEN 'short' ELSE trim(substr(text, 1, 40)) END AS m, CASE WHEN doc_id % 11 = 0 THEN 'bad-' WHEN doc_id % 2 = 0 THEN 'atk-' ELSE 'ben-' END || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS id FROM documents), e AS ("
    + " UNION ALL ".join(f"SELECT id, '{name}' AS rule FROM d WHERE {broken}" for name, broken in _RULES.items())
    + " UNION ALL SELECT id, 'unique_ids' FROM d GROUP BY id HAVING count(*) > 1) SELECT rule, count(*) AS n FROM e GROUP BY rule"
)
def lint_records(spark, sf_dir):
    """How many records break each of the 16 rules, and ids that occur twice."""
    return records.lint(made_records(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


def caught_results(spark, sf_dir):
    """Results of attacks on three routes, whose signals follow from the id and the window scores."""
    i = F.col("doc_id")
    route = F.element_at(F.array(*map(F.lit, ("/search", "/retrieve", "/extract"))), (i % 3 + 1).cast("int"))
    config = F.when(i % 2 == 0, "contiguity").otherwise("max")
    fired = pooling.max_score(pooling.MAX_THRESHOLD)(F.col("scores")) | ((config == "contiguity") & pooling.contiguity(pooling.RUN_LENGTH, pooling.RUN_THRESHOLD)(F.col("scores")))
    omit = F.when(route != "/search", None).when(i % 5 == 0, "structural_blocked").when(fired, "injection_detected").when(i % 7 == 1, "blocked_url").when(i % 7 == 2, "promptguard_unavailable")
    state = F.when(i % 5 == 0, "structural_blocked").when(i % 7 == 2, "unavailable_blocked").otherwise("scanned")
    signals = F.struct(
        (i % 13 == 0).alias("refusal"), omit.alias("omit_reason"), F.lit(True).alias("suspicious"), F.array_max("scores").alias("score"), state.alias("state"), fired.alias("detected"), (i % 2).alias("n_flags"), F.col("scores").alias("scores")
    )
    return scored(spark, sf_dir).select("doc_id", route.alias("route"), config.alias("config"), F.lit("blocked").alias("outcome"), attribution.attribution(signals, route, config).alias("a")).select("*", "a.stage", "a.rule")


_CAUGHT = f"""{SCORED}, r AS (SELECT doc_id, scores, CASE doc_id % 3 WHEN 0 THEN '/search' WHEN 1 THEN '/retrieve' ELSE '/extract' END AS route, CASE WHEN doc_id % 2 = 0 THEN 'contiguity' ELSE 'max' END AS config,
{_POOL_SQL["pool_max"]} AS top, doc_id % 2 = 0 AND ({_POOL_SQL["pool_contiguity"]}) AS run FROM scored),
s AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'refused' WHEN route = '/search' THEN CASE WHEN doc_id % 5 = 0 THEN 'stage2' WHEN top OR run THEN 'stage3' WHEN doc_id % 7 = 1 THEN 'url' WHEN doc_id % 7 = 2 THEN 'unavailable' WHEN list_max(scores) > 0.5 THEN 'sub' ELSE 'stage2' END
ELSE CASE WHEN doc_id % 5 = 0 THEN 'stage2' WHEN doc_id % 7 = 2 THEN 'unavailable' WHEN top OR run THEN 'stage3' WHEN doc_id % 2 = 1 THEN 'stage2' END END AS stage FROM r)"""


_COUNTERS = {
    "stage2": "stage = 'stage2'", "stage3": "stage IN ('stage3', 'sub')", "url": "stage = 'url'", "unavailable": "stage = 'unavailable'", "refused": "stage = 'refused'",
    "rule_max_score": "stage = 'stage3' AND top AND NOT run", "rule_contiguity": "stage = 'stage3' AND run AND NOT top", "rule_both": "stage = 'stage3' AND top AND run", "rule_sub_threshold": "stage = 'sub'", "unexplained": "stage IS NULL",
}


@query(f"WITH {_CAUGHT} SELECT route, config, count(*) AS n, " + ", ".join(f"CAST(count_if({c}) AS BIGINT) AS {n}" for n, c in _COUNTERS.items()) + " FROM s GROUP BY route, config")
def attack_attribution(spark, sf_dir):
    """Five stage and four rule counters of caught attacks, by route and configuration."""
    return attribution.attack_counters(caught_results(spark, sf_dir), ["route", "config"])


def _floors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("route"), F.col("source").alias("category"))
    i = F.col("doc_id")
    section = F.element_at(F.array(*map(F.lit, ("attacks", "benign", "headline"))), (i % 3 + 1).cast("int"))
    key = F.when(i % 17 == 0, "floor").when(i % 3 == 0, "min_catch").otherwise("max_fpr")
    rows = d.select(section.alias("section"), "category", "route", F.concat(F.lit("m"), i).alias("model"), F.lit("c").alias("config"), key.alias("key"), F.when(i % 19 != 0, (i % 20) / F.lit(20.0)).alias("old"), F.when(i % 23 != 0, (i * 3 % 20) / F.lit(20.0)).alias("new"), i.alias("doc_id"))
    word = lambda n: F.when(F.col("doc_id") % n == 0, "blocked").otherwise("leaked")
    changes = rows.where("doc_id % 2 = 0 and category <> 'src3'").select("category", "route", "model", "config", F.concat(F.lit("r"), F.col("doc_id")).alias("id"), word(4).alias("was"), word(3).alias("now"))
    return rows.drop("doc_id"), changes


@query("""WITH d AS (SELECT doc_id AS i, lang AS route, source AS category FROM documents),
f AS (SELECT i, category, CASE i % 3 WHEN 0 THEN 'attacks' WHEN 1 THEN 'benign' ELSE 'headline' END AS section, CASE WHEN i % 17 = 0 THEN 'floor' WHEN i % 3 = 0 THEN 'min_catch' ELSE 'max_fpr' END AS key, CASE WHEN i % 19 <> 0 THEN (i % 20) / 20.0::DOUBLE END AS o, CASE WHEN i % 23 <> 0 THEN (i * 3 % 20) / 20.0::DOUBLE END AS n FROM d),
v AS (SELECT *, i % 2 = 0 AND category <> 'src3' AS seen, CASE WHEN i % 3 = 0 THEN n > o ELSE n < o END AS better FROM f),
r AS (SELECT *, CASE WHEN o IS NULL OR n IS NULL THEN 'cell set' WHEN i % 17 = 0 THEN 'unknown key' WHEN better THEN NULL WHEN section = 'headline' THEN 'unprovable'
 WHEN category NOT IN (SELECT category FROM v WHERE seen) THEN 'no records' WHEN section = 'attacks' THEN CASE WHEN seen AND i % 4 = 0 AND i % 3 <> 0 THEN 'caught before' END ELSE CASE WHEN seen AND i % 3 = 0 AND i % 4 <> 0 THEN 'newly caught' END END AS reason FROM v)
SELECT section, CASE WHEN reason IS NOT NULL THEN 'problem' WHEN better THEN 'tightened' ELSE 'justified' END AS verdict, reason, count(*) AS n FROM r WHERE (o IS DISTINCT FROM n) OR reason = 'unknown key' GROUP BY ALL""")
def floor_verdicts(spark, sf_dir):
    floors, changes = _floors(spark, sf_dir)
    return attribution.floor_verdicts(floors, changes).groupBy("section", "verdict", "reason").agg(F.count("*").alias("n"))


@query("""SELECT lang, source, CAST(count_if(doc_id % 4 = 0) AS BIGINT) AS hits_was, CAST(count_if(doc_id % 3 = 0) AS BIGINT) AS hits_now FROM documents WHERE doc_id % 10 <> 0 GROUP BY lang, source HAVING count_if(doc_id % 3 = 0) > count_if(doc_id % 4 = 0)""")
def risen_rates(spark, sf_dir):
    word = lambda n: F.when(F.col("doc_id") % n == 0, "flagged").otherwise("clean")
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select("lang", "source", F.col("doc_id").cast("string").alias("id"), word(4).alias("was"), word(3).alias("now"))
    return attribution.risen_rates(d, ["lang", "source"]).select("lang", "source", "hits_was", "hits_now")


@query("""WITH r AS (SELECT source AS run, doc_id, lang, doc_id % 3 <> 0 AS scored FROM documents), s AS (SELECT run, doc_id, lang, row_number() OVER (PARTITION BY run ORDER BY doc_id) AS turn FROM r WHERE scored)
SELECT run, lang AS record_id, count(*) AS results, CASE WHEN run = 'src1' THEN -1 ELSE count(DISTINCT sha256(CAST(doc_id AS VARCHAR))) FILTER (scored) END AS n_shas FROM r GROUP BY run, lang""")
def positional_merge(spark, sf_dir):
    """Calls of a run in order, merged with its scored results; one run has a call too many."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("pos"), F.col("lang").alias("record_id"), (F.col("doc_id") % 3 != 0).alias("scored"))
    calls = d.where("scored").select("run", "pos", F.sha2(F.col("pos").cast("string"), 256).alias("sha256"))
    more = d.where("run = 'src1'").groupBy("run").agg(F.max("pos").alias("pos")).select("run", (F.col("pos") + 1).alias("pos"), F.lit("x").alias("sha256"))
    merged = attribution.walked_together(d, calls.unionByName(more))
    return d.groupBy("run", "record_id").agg(F.count("*").alias("results")).join(merged, ["run", "record_id"]).select("run", "record_id", "results", F.when(F.col("shas").isNotNull(), F.size("shas")).otherwise(-1).cast("bigint").alias("n_shas"))


@query("""WITH l AS (SELECT 'p' || CAST(event_id % 50 AS VARCHAR) AS name, 'v' || CAST(event_id % 3 AS VARCHAR) AS version FROM events WHERE event_id % 50 < 40), r AS (SELECT DISTINCT 'p' || CAST(event_id % 50 AS VARCHAR) AS name, 'v' || CAST(event_id % 50 % 5 AS VARCHAR) AS version FROM events)
SELECT r.name, r.version, coalesce((SELECT string_agg(DISTINCT l.version, ',' ORDER BY l.version) FROM l WHERE l.name = r.name), 'absent') AS lock FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.name = r.name AND l.version = r.version)""")
def stale_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("event_id") % 50).alias("name"), "event_id")
    recorded = e.select("name", F.concat(F.lit("v"), F.col("event_id") % 50 % 5).alias("version")).distinct()
    return attribution.versions_differ(recorded, e.where("event_id % 50 < 40").select("name", F.concat(F.lit("v"), F.col("event_id") % 3).alias("version")))
