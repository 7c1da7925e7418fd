"""Queries on the small tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, render, tallies
from ..sources.tables import table
from .registry import SCORED, query, scored
from .screening import _POOL_SQL


@query("SELECT DISTINCT source AS model FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND doc_id % 5 = 0)")
def unmeasured_models(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("model"))
    return tallies.unmeasured(d, d.where("lang = 'fr' and doc_id % 5 = 0"))


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS k FROM documents WHERE doc_id % 4 = 1), m AS (SELECT max(doc_id % 1000) AS g FROM documents WHERE doc_id % 4 = 0)
SELECT doc_id, 'ben-' || lpad(CAST(g + k AS VARCHAR), CAST(greatest(4, len(CAST(g + k AS VARCHAR))) AS INTEGER), '0') AS id, CASE (k - 1) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'page' ELSE 'text' END AS surface FROM n, m""")
def numbered_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    held = d.where("doc_id % 4 = 0").select(F.format_string("ben-%04d", F.col("doc_id") % 1000).alias("id"))
    return tallies.numbered_after(d.where("doc_id % 4 = 1"), held, "ben", "doc_id").select("doc_id", "id", "surface")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, doc_id % 3 = 0 AS caught, row_number() OVER (PARTITION BY source, doc_id % 3 = 0 ORDER BY md5(doc_id::VARCHAR || '7')) AS turn FROM documents) WHERE turn <= CASE WHEN caught THEN 2 ELSE 3 END")
def half_caught(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") % 3 == 0).alias("caught"))
    return tallies.half_caught(d, "source", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("7"))), 5).select("source", "doc_id")


@query(f"""WITH {SCORED}, f AS (SELECT lang AS kind, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN list_reverse(scores) ELSE scores END AS scores FROM scored JOIN documents USING (doc_id))
SELECT kind, count(*) AS n, count(scores) AS reached, CAST(count_if(scores IS NOT NULL AND {_POOL_SQL["pool_max"]}) AS BIGINT) AS max_fired, CAST(count_if(scores IS NOT NULL AND {_POOL_SQL["pool_contiguity"]}) AS BIGINT) AS run_fired FROM f GROUP BY kind""")
def first_scores(spark, sf_dir):
    """Scores of the first of two configurations that a record reaches; some reach only the second, some neither."""
    s = scored(spark, sf_dir).select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"), "scores")
    none = F.lit(None).cast("array<double>")
    one = s.select("kind", "id", F.lit("max").alias("config"), F.when(F.col("id") % 3 != 0, F.col("scores")).otherwise(none).alias("scores"))
    two = s.select("kind", "id", F.lit("contiguity").alias("config"), F.when(F.col("id") % 4 != 0, F.reverse("scores")).otherwise(none).alias("scores"))
    return tallies.first_scores(two.unionByName(one), ("max", "contiguity"))


@query("""WITH c AS (SELECT source AS genre, CASE WHEN doc_id % 9 = 0 THEN 'licence' WHEN doc_id % 8 = 0 THEN 'unpinned' WHEN n_chars < 300 THEN 'too_short' END AS reason FROM documents WHERE source <> 'src3'), g AS (SELECT DISTINCT source AS genre FROM documents),
e AS (SELECT genre, count(*) AS examined FROM c GROUP BY genre), r AS (SELECT genre, reason, count(*) AS rejected FROM c WHERE reason IS NOT NULL GROUP BY genre, reason)
SELECT genre, reason, coalesce(rejected, 0) AS rejected, coalesce(examined, 0) AS examined, round(coalesce(rejected, 0) / nullif(coalesce(examined, 0), 0)::DOUBLE, 6) AS rate FROM g LEFT JOIN e USING (genre) LEFT JOIN r USING (genre)""")
def rejections_by_reason(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    reason = corpus.screen_reason(F.when(F.col("doc_id") % 9 != 0, F.lit("CC0")), F.col("doc_id") % 8 != 0, F.lit(False), F.col("n_chars"), F.lit(1.0), 300)
    return tallies.rejections_by_reason(d.where("source <> 'src3'").select(F.col("source").alias("genre"), reason.alias("reason")), d.select(F.col("source").alias("genre")).distinct())


@query(f"WITH {SCORED} SELECT CASE WHEN doc_id % 7 = 0 THEN -1 ELSE CAST(len(scores) AS INTEGER) END AS windows, count(*) AS n FROM scored GROUP BY 1")
def windows_with_unscanned(spark, sf_dir):
    return tallies.windows_with_unscanned(scored(spark, sf_dir).withColumn("scores", F.when(F.col("doc_id") % 7 != 0, F.col("scores"))))


@query("SELECT doc_id, len(t) <= 1792 AND strlen(t) <= 7168 AS fits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def upload_budgets(spark, sf_dir):
    """Which documents fit into one window's budget."""
    return table(spark, sf_dir, "documents").select("doc_id", tallies.upload_budget(F.coalesce("text", F.lit("")), 1).alias("fits"))


@query("SELECT doc_id, doc_id % 4 = 1 OR (doc_id % 4 = 2 AND contains(lower(text), 'the')) OR (doc_id % 4 = 3) AS leaked FROM documents")
def markers_on_wire(spark, sf_dir):
    """Markers in the body, in the quoted spans only, in the name of a field, and from the text itself."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 1, "\nThe  SECRET​ Marker ß").otherwise("")).alias("body"), F.array(F.lit("secret marker ss")).alias("injection_spans"))
    rows = render.wire_rows(d, ("title", "body", "injection_spans", "redirect_chain"))
    marker = F.when(F.col("doc_id") % 4 < 2, "secret  marker SS").when(F.col("doc_id") % 4 == 2, "tHe ​").otherwise("Redirect_Chain")
    marked = d.select("doc_id", "body", "injection_spans", F.lit(None).cast("string").alias("title"), marker.alias("marker"))
    strings = tallies.wire_strings({c: k for c, k in rows.dtypes})
    return marked.withColumn("redirect_chain", F.lit(None).cast("string")).select("doc_id", tallies.marker_on_wire(strings, F.col("marker")).alias("leaked"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 50 + 10.5 <= 40 THEN 'ok' ELSE 'over by ' || CAST(CAST(ceil(event_id % 50 + 10.5 - 40) AS BIGINT) AS VARCHAR) END AS rule FROM events")
def memory_rules(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select("event_id", tallies.memory_rule(F.array((F.col("event_id") % 50).cast("double"), F.lit(10.5), F.lit(None).cast("double")), F.when(F.col("event_id") % 7 != 0, F.lit(40.0))).alias("rule"))


@query("SELECT doc_id, 'attacks/' || source || '/min_catch' AS path, (doc_id % 20) / 20.0::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 'headline', doc_id::DOUBLE FROM documents")
def json_numbers(spark, sf_dir):
    tree = F.to_json(F.struct(F.create_map("source", F.create_map(F.lit("min_catch"), (F.col("doc_id") % 20) / F.lit(20.0))).alias("attacks"), F.col("doc_id").alias("headline")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tallies.numbers_of(tree)).alias("path", "value"))
