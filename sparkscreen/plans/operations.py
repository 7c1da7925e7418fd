"""Queries on searches, providers and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pooling, text, urls
from ..operators import metrics, search
from ..sources.tables import table
from .registry import query, scores
from .screening import _POOL_SQL

_LADDER = f"""r AS (SELECT page_id % 50 AS query_id, page_id AS pos, url, page_id % 13 = 0 AS private, page_id % 7 = 0 AS denied, page_id % 11 = 0 AS blocked,
  list_transform(range(0, 1 + page_id % 6), lambda p: ((page_id * 31 + p * 17) % 100) / 100.0::DOUBLE) AS scores FROM pages),
o AS (SELECT *, CASE WHEN private THEN 'private_ip' WHEN denied THEN 'blocked_domain' WHEN blocked THEN 'structural_block' WHEN {_POOL_SQL["pool_live"]} THEN 'injection_detected' END AS omission FROM r),
x AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN omission IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_before FROM o) WHERE kept_before < 2)"""


def ladder(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select((F.col("page_id") % 50).alias("query_id"), F.col("page_id").alias("pos"), "url", scores(F.col("page_id")).alias("scores"))
    bad = F.when(rows["pos"] % 13 == 0, F.lit("http://10.0.0.1/")).otherwise(F.col("url"))
    token = urls.url_rule(bad)
    verdict = F.when(F.col("pos") % 11 == 0, "blocked").otherwise("clean")
    rows = rows.withColumn("omission", search.omission(token, token == "private_literal", F.col("pos") % 7 == 0, verdict, F.lit("scanned"), pooling.live()(F.col("scores"))))
    return search.examined(rows, 2)


@query(f"WITH {_LADDER} SELECT query_id, pos, omission FROM x")
def search_ladder(spark, sf_dir):
    return ladder(spark, sf_dir).select("query_id", "pos", "omission")


@query(f"""WITH {_LADDER}, c AS (SELECT query_id, omission, count(*) AS n FROM x WHERE omission IS NOT NULL GROUP BY 1, 2), m AS (SELECT query_id, string_agg(omission || '=' || n, ',' ORDER BY omission) AS t FROM c GROUP BY query_id)
SELECT query_id, coalesce(string_agg(CASE WHEN omission IS NULL THEN url END, ' ' ORDER BY pos), '') AS urls, CAST(count_if(omission IS NULL) AS INTEGER) AS n_results, CAST(count(omission) AS INTEGER) AS omitted_results, coalesce(any_value(t), '') AS omitted_by_reason FROM x LEFT JOIN m USING (query_id) GROUP BY query_id""")
def search_response(spark, sf_dir):
    return search.response(ladder(spark, sf_dir))


@query(f"WITH {_LADDER} SELECT query_id, omission AS reason, count(*) AS n FROM x WHERE omission IS NOT NULL GROUP BY 1, 2")
def omission_counts(spark, sf_dir):
    return search.omission_counts(ladder(spark, sf_dir))


@query("""WITH a AS (SELECT event_id // 4 AS request_id, event_id % 4 AS pos, event_type AS provider, value > 100 AS ok FROM events), f AS (SELECT *, min(CASE WHEN ok THEN pos END) OVER (PARTITION BY request_id) AS first FROM a)
SELECT request_id, max(CASE WHEN pos = first THEN provider END) AS provider_used, coalesce(min(first), 0) > 0 AS fallback_fired, coalesce(string_agg(CASE WHEN first IS NULL OR pos < first THEN provider END, ',' ORDER BY pos), '') AS provider_errors FROM f GROUP BY request_id""")
def provider_chain(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("request_id"), (F.col("event_id") % 4).alias("pos"), F.col("event_type").alias("provider"), (F.col("value") > 100).alias("ok"))
    return search.served_chain(a)


@query("""WITH a AS (SELECT event_id // 5 AS request_id, event_id % 5 AS pos, event_id % 3 <> 0 AS paid, event_id % 4 <> 0 AS named, (event_id // 5) % 2 = 0 AS allowed FROM events), n AS (SELECT *, min(CASE WHEN named THEN 1 ELSE 0 END) OVER (PARTITION BY request_id, paid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS all_named FROM a)
SELECT request_id, pos FROM n WHERE NOT paid OR (allowed AND all_named = 1)""")
def paid_prefix(spark, sf_dir):
    e = F.col("event_id")
    a = table(spark, sf_dir, "events").select(F.floor(e / 5).alias("request_id"), (e % 5).alias("pos"), (e % 3 != 0).alias("paid"), (e % 4 != 0).alias("named"), (F.floor(e / 5) % 2 == 0).alias("paid_allowed"))
    return search.paid_prefix(a).select("request_id", "pos")


@query("SELECT page_id, 0 AS pos, url, 't' || page_id AS title, CAST(NULL AS VARCHAR) AS date FROM pages UNION ALL SELECT page_id, 1, 'u2', 'second', '2024-01-02' FROM pages WHERE page_id % 2 = 0")
def metasearch_rows(spark, sf_dir):
    one = F.struct(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("url"), F.lit(None).cast("string").alias("publishedDate"))
    two = F.struct(F.lit("second").alias("title"), F.lit("u2").alias("url"), F.lit("2024-01-02").alias("publishedDate"))
    body = F.to_json(F.struct(F.when(F.col("page_id") % 2 == 0, F.array(one, two, two)).otherwise(F.array(one)).alias("results")))
    rows = search.metasearch_rows(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), 2)
    return rows.select("page_id", "pos", "url", "title", "date")


@query("SELECT page_id, url, 'a' || chr(10) || chr(10) || 'b' AS content, CASE WHEN page_id % 2 = 0 THEN '2024-05-06' END AS date FROM pages")
def grounding_rows(spark, sf_dir):
    entry = F.struct(F.lit("t").alias("title"), F.col("url").alias("url"), F.array(F.lit("a"), F.lit("b")).alias("snippets"))
    age = F.struct(F.when(F.col("page_id") % 2 == 0, F.array(F.lit("May 6"), F.lit("2024-05-06T01:00"))).otherwise(F.array(F.lit("May"))).alias("age"))
    body = F.to_json(F.struct(F.struct(F.array(entry).alias("generic")).alias("grounding"), F.create_map("url", age).alias("sources")))
    return search.grounding_rows(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), 5).select("page_id", "url", "content", "date")


@query("SELECT cls, count(*) AS n FROM (SELECT CASE s WHEN 200 THEN NULL WHEN 301 THEN 'redirect' WHEN 401 THEN 'auth' WHEN 403 THEN 'auth' WHEN 404 THEN 'client_error' WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'server_error' ELSE 'unexpected' END AS cls FROM (SELECT [200, 301, 401, 403, 404, 429, 503, 700][event_id % 8 + 1] AS s FROM events)) GROUP BY cls")
def failure_classes(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, (200, 301, 401, 403, 404, 429, 503, 700))), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(search.failure_class(s).alias("cls")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'alpha,' || lower(event_type) ELSE 'metasearch' END AS names FROM events")
def provider_names(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Alpha ,, "), F.upper("event_type"), F.lit(",ALPHA"))).otherwise(F.lit(" , "))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(search.provider_names(raw, "metasearch"), ",").alias("names"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def metrics_counters(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT event_type, CAST(max(floor(value)) AS BIGINT) AS high_water, CAST(count_if(value > 100) AS BIGINT) AS exceeded FROM events GROUP BY event_type")
def latency_high_water(spark, sf_dir):
    return metrics.high_water(table(spark, sf_dir, "events"), "value", 100.0, ["event_type"])


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def error_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(metrics.bucketed(F.col("event_type"), ("click", "view")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(substr(text, 1, 200), '\\s+', ' ', 'g'))[1:64] AS field FROM documents")
def search_fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.search_field(F.col("text"), 64).alias("field"))


@query("SELECT item, n FROM (VALUES ('ordered_union', 'a,b,c'), ('overlap', 'true'), ('missing', 'm2')) t(item, n)")
def set_operations(spark, sf_dir):
    a, b = F.array(*map(F.lit, ("a", "b"))), F.array(*map(F.lit, ("b", "c", "a")))
    rows = [("ordered_union", F.array_join(F.array_union(a, b), ",")), ("overlap", F.arrays_overlap(a, b).cast("string")), ("missing", F.array_join(F.array_except(F.array(F.lit("m1"), F.lit("m2")), F.array(F.lit("m1"))), ","))]
    one = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("n")) for k, v in rows])).alias("r"))
    return one.select("r.item", "r.n")


@query("SELECT user_id AS key, count(*) AS n, max(value) AS high_water FROM events GROUP BY user_id")
def stream_counters(spark, sf_dir):
    import uuid

    from ..streaming import state

    schema = table(spark, sf_dir, "events").schema
    files = f"{sf_dir}/events.parquet"
    path = files if spark.read.parquet(files).inputFiles()[0].rstrip("/").split("/")[-2] == "events.parquet" else sf_dir
    reader = spark.readStream.schema(schema)
    events = (reader if path == files else reader.option("pathGlobFilter", "events.parquet")).parquet(path)
    counted = state.stream_counters(events.withColumn("key", F.col("user_id")), "key")
    return state.run_to_end(counted, f"counters_{uuid.uuid4().hex}")
