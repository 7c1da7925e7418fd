"""Queries on the small transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import auxiliary as aux
from ..operators import render
from ..sources.tables import table
from .registry import query

#: Fixed value: characters of an excerpt.
EXCERPT_CAP = 6_000


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def pick(values, by="event_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _list(values) -> str:
    """Values in SQL; line feeds are written out."""
    text = lambda v: " || chr(10) || ".join(f"'{part}'" for part in v.split("\n"))
    return "[" + ", ".join("NULL" if v is None else text(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def pairs(name: str, inputs: list, outputs: list, column, kind: str = "VARCHAR"):
    """Register a query that puts an input by id through a column function; SQL knows the outputs."""

    def run(spark, sf_dir):
        return events(spark, sf_dir).groupBy(column(pick(inputs)).alias("o")).agg(F.count("*").alias("n"))

    run.__name__ = name
    query(f"SELECT o, count(*) AS n FROM (SELECT CAST({_list(outputs)}[event_id % {len(inputs)} + 1] AS {kind}) AS o FROM events) GROUP BY o")(run)


pairs("endpoint_origin", ["https://A.example:8080/x", "http://a.example:99999", "ftp://x", "http://u:p@b.example/q"], ["https://a.example:8080", "http://a.example", "invalid", "http://b.example"], aux.origin)
pairs("usable_keys", [" abc ", "a b", "é", "k-1"], ["abc", None, None, "k-1"], aux.usable_key)
pairs("closed_tokens", ["ok_1", "Bad", "x y", "a"], ["ok_1", "other", "other", "a"], lambda v: aux.closed_token(v, "other"))
pairs("memory_sizes", ["512m", "1.5GiB", "1048576", "x"], [512.0, 1536.0, 1.0, None], aux.memory_mib, "DOUBLE")
pairs("public_reasons", [*aux.FAILURES, "zzz"], [*aux.FAILURES.values(), None], aux.public_reason)
pairs("licence_sniff", ["MIT License etc", "Apache License v2", "none"], ["MIT", "Apache-2.0", None], aux.licence_of)
pairs("markdown_titles", ["x\n# Title \ny", "no title"], ["Title", "fb"], lambda v: aux.markdown_title(v, F.lit("fb")))
pairs("slug_urls", ["A  Title!", "--x--"], ["https://news.example/a-title", "https://news.example/x"], lambda v: aux.slug_url(F.lit("News"), v))
pairs("rst_prose", ["T\n===\n.. note::\n   gone\n\nkept", "a"], ["T\nkept", "a"], lambda v: F.regexp_replace(aux.rst_prose(v), "\n", "\n"))
pairs("upload_names", ["a\\b/c.txt", "\x01x.pdf"], ["c.txt", "x.pdf"], text.upload_name)
pairs(
    "reserved_urls", ["see http://Foo.com/x", "http://a.example/", "ftp://u:p@www.Big_Shop.co.uk:21/a b", "mail x@deep.sub.host.io now", "no host"],
    ["see http://foo.example/x", "http://a.example/", "ftp://big-shop-co.example/a b", "mail x@deep-sub-host.example now", "no host"], lambda v: aux.reserved_urls(v)["text"],
)
pairs("host_classes", ["10.0.0.1", "::ffff:10.0.0.1", "Example.com.", "1.2.3", "2606:4700::1111"], ["private_literal", "embedded_private", "example.com", "host_numeric", "2606:4700::1111"], lambda v: F.coalesce(urls.host_info(v)["class"], urls.host_info(v)["reason"], urls.host_info(v)["host"]))


@query("SELECT event_id AS path, CASE WHEN event_id % 5 = 0 THEN 'removed' WHEN event_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM events WHERE (event_id % 5 = 0 AND event_id % 7 <> 0) OR (event_id % 7 = 0 AND event_id % 5 <> 0) OR (event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0)")
def manifest_changes(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").alias("path"), F.lit("s").alias("sha"), F.lit(1).alias("size"))
    new = e.where("path % 5 <> 0").withColumn("size", F.when(F.col("path") % 3 == 0, 2).otherwise(1))
    return aux.manifest_diff(e.where("path % 7 <> 0"), new)


@query("SELECT event_id AS path, CASE WHEN event_id % 7 = 0 THEN 'extra' WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 2 = 0 THEN 'size,hash' ELSE 'hash' END AS reasons FROM events WHERE (event_id % 5 = 0) <> (event_id % 7 = 0) OR (event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0)")
def exact_sets(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").alias("path"), F.lit("s").alias("sha"), F.lit(1).alias("size"))
    odd = F.col("path") % 3 == 0
    found = e.where("path % 5 <> 0").withColumn("sha", F.when(odd, "t").otherwise("s")).withColumn("size", F.when(odd & (F.col("path") % 2 == 0), 2).otherwise(1))
    return aux.exact_set(e.where("path % 7 <> 0"), found)


@query("""WITH c AS (SELECT user_id AS key, event_id AS pos, sum(event_id % 7) OVER w AS a, sum(event_id % 3) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT key, coalesce(max(CASE WHEN a <= 30 AND b <= 10 THEN pos END), 0) AS prefix FROM c GROUP BY key""")
def longest_prefixes(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("event_id") % 7).alias("a"), (F.col("event_id") % 3).alias("b"))
    return aux.longest_prefix(e, "key", "pos", "a", "b", 30, 10)


@query("""SELECT key, pos, coalesce(sum(cost) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 40 AS in_time FROM (SELECT user_id AS key, event_id AS pos, event_id % 11 AS cost FROM events)""")
def shared_deadline(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("event_id") % 11).alias("cost"))
    return aux.deadline(e, "key", "pos", "cost", 40.0).select("key", "pos", "in_time")


@query()
def admission_gate(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 10).alias("gate"), F.col("event_id").alias("id"), F.col("event_id").alias("arrive"), (F.col("event_id") % 40).cast("double").alias("hold"))
    return aux.admission(e).groupBy("gate", "what").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, 'r' || event_id % 2 AS route, 'c' || event_id % 3 AS config, event_type AS outcome FROM events")
def nested_outcomes(spark, sf_dir):
    """There and back: rows to nested maps and to rows again."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(F.lit("r"), F.col("event_id") % 2).alias("route"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("config"), F.col("event_type").alias("outcome"))
    return aux.flat_outcomes(aux.nested_outcomes(e))


@query("SELECT event_id FROM events WHERE event_id % 4 = 1 OR (event_id % 4 = 2 AND event_id % 3 = 0)")
def blocking_errors(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.lit("retrieve").alias("route"), pick((200, 403, 422, 500)).alias("status"), F.lit("refused").alias("error"), F.when(F.col("event_id") % 3 == 0, "private_ip").alias("reason"))
    rules = spark.createDataFrame([("retrieve", 403, "refused", None), ("retrieve", 422, "refused", "private_ip")], "route string, status int, error string, reason string")
    return aux.blocking_error(e, rules).select("event_id")


@query("SELECT doc_id, substr(text, 1, 30) AS excerpt FROM documents WHERE NOT contains(text, chr(10)) AND len(trim(text)) > 30 AND len(text) = len(trim(text))")
def excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("not contains(text, '\n') and length(trim(text)) > 30 and length(text) = length(trim(text))")
    return d.select("doc_id", text.excerpt(F.col("text"), 30).alias("excerpt"))


@query()
def whole_excerpts(spark, sf_dir):
    """Of every document, however many paragraphs it has."""
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), EXCERPT_CAP).alias("excerpt"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_counters(spark, sf_dir):
    w = F.window(F.col("ts"), "1 hour")
    return events(spark, sf_dir).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def _policy_lists(spark, sf_dir):
    """Hosts of pages as entries of policy lists, some with dots, spaces or a single label."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)).alias("host"))
    kind = F.col("page_id") % 5
    entry = F.when(kind == 0, F.concat(F.lit("."), "host")).when(kind == 1, F.concat(F.lit("  "), F.upper("host"), F.lit(" "))).when(kind == 2, F.lit("single")).when(kind == 3, F.lit(".10.0.0.1")).otherwise(F.col("host"))
    return p.select((F.col("page_id") % 16).alias("list"), F.col("page_id").alias("pos"), entry.alias("entry"), (F.col("page_id") % 16 % 2 == 0).alias("deny"))


_LISTS = """p AS (SELECT page_id % 16 AS list, page_id AS pos, page_id % 5 AS kind, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, page_id % 16 % 2 = 0 AS deny FROM pages),
e AS (SELECT *, CASE kind WHEN 0 THEN '.' || host WHEN 1 THEN '  ' || upper(host) || ' ' WHEN 2 THEN 'single' WHEN 3 THEN '.10.0.0.1' ELSE host END AS entry FROM p)"""


@query(f"""WITH {_LISTS}, b AS (SELECT *, sum(strlen(entry) + 1) OVER (PARTITION BY list ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS used FROM e)
SELECT list, pos, CASE WHEN kind = 3 OR NOT (deny OR used <= 200) OR (kind = 2 AND NOT deny) THEN NULL WHEN kind = 2 THEN 'single' WHEN kind = 0 AND NOT deny THEN '.' || host ELSE host END AS entry FROM b""")
def domain_entries(spark, sf_dir):
    return urls.domain_entries(_policy_lists(spark, sf_dir), 200).select("list", "pos", "entry")


@query(f"WITH {_LISTS} SELECT list, CAST(sum(strlen(entry)) + count(*) - 1 AS BIGINT) AS bytes, sum(strlen(entry)) + count(*) - 1 <= 300 AS fits FROM e WHERE deny GROUP BY list")
def denied_lists_fit(spark, sf_dir):
    return urls.denied_lists_fit(_policy_lists(spark, sf_dir).where("deny"), 300)


_ESCAPED = "replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, '') || chr(10) || chr(10) || 'a <b> & "c"', '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS blocks FROM documents)
SELECT doc_id, md5('<article><h1>T &amp; t</h1>' || array_to_string(list_transform(blocks, lambda b: '<p>' || replace({_ESCAPED}, chr(10), '<br>') || '</p>'), '') || '</article>') AS digest FROM d""")
def rendered_pages(spark, sf_dir):
    """Documents as pages of the corpus."""
    body = render.payload("benign_page", F.lit("https://x.example/"), F.lit("T & t"), F.concat(F.coalesce("text", F.lit("")), F.lit('\n\na <b> & "c"')))["body_html"]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(body).alias("digest"))


@query("""WITH c AS (SELECT lang, count(*) AS n, round_even(count_if(doc_id % 3 = 0) / count(*)::DOUBLE, 4) AS rate FROM documents GROUP BY lang), l AS (SELECT 2 + row_number() OVER (ORDER BY lang) AS line, '| ' || lang || ' | ' || CAST(n AS VARCHAR) || ' | ' || printf('%.4f', rate) || ' |' AS text FROM c)
SELECT CAST(line AS BIGINT) AS line, text FROM l UNION ALL SELECT 1, '| lang | n | rate |' UNION ALL SELECT 2, '|---|---|---|'""")
def markdown_report(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), (F.count_if(F.col("doc_id") % 3 == 0) / F.count("*")).alias("rate"))
    return render.markdown_table(cells, ["lang", "n", "rate"], ["lang"])
