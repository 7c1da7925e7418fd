"""Queries on URLs, hosts, policies and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import cache
from ..sources.tables import table
from .registry import query

_AUTH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_HOST = f"lower(regexp_extract({_AUTH}, '^([^:]*)', 1))"
#: Pages with a fault planted by id, so that every rule of the chain fires.
_FAULTS = ("", "ftp://x.example/", "http://a b.example/", "http://user@x.example/", "http://x.example:99999/", "http://10.1.2.3/", "http://printer.local/", "http://[fe80::1%25a]/", "http://x_y%zz.example/", "http://1.2.3.400/")
_TOKENS = ("missing", "parse", "raw_chars", "userinfo", "invalid_port", "private_literal", "blocklisted_name", "zone_id", "host_code_point", "host_encoding")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_of_page(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(urls.ascii_host(urls.parts(F.col("url"))["host"]).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE page_id % 20 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOKENS)) + " END AS token FROM pages")
def url_rules(spark, sf_dir):
    url = F.col("url")
    for i, fault in enumerate(_FAULTS):
        url = F.when(F.col("page_id") % 20 == i, F.lit(fault)).otherwise(url)
    return pages(spark, sf_dir).select("page_id", urls.url_rule(url).alias("token"))


@query(f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || lower({_AUTH}) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS canonical FROM pages")
def canonical_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, url || '/%3Cb%3E&' AS once, url || '/<b>&' AS twice FROM pages")
def url_scan_texts(spark, sf_dir):
    from ..operators.forms import url_scan_texts as texts

    t = pages(spark, sf_dir).select("page_id", texts(F.concat("url", F.lit("/%3Cb%3E&amp;"))).alias("t"))
    return t.select("page_id", F.col("t")[0].alias("once"), F.col("t")[1].alias("twice"))


_RANGES = " OR ".join(f"ip BETWEEN {lo} AND {hi}" for lo, hi in urls.v4_ranges())


@query(f"SELECT private, count(*) AS n FROM (SELECT {_RANGES} AS private FROM (SELECT (event_id * 2654435761) % 4294967296 AS ip FROM events)) GROUP BY private")
def cidr_private(spark, sf_dir):
    ip = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))
    quad = F.concat_ws(".", *[F.pmod(F.shiftright(ip, 24 - 8 * k), F.lit(256)).cast("string") for k in range(4)])
    return table(spark, sf_dir, "events").groupBy(urls.is_private_v4(urls.v4_number(quad)).alias("private")).agg(F.count("*").alias("n"))


_POLICY = (("example.net", True, "trusted", 1), ("example.com", True, "verified", 2), ("blog.example.com", False, "blocked", 0), ("www.example.org", False, "blocked", 0))


def policy(spark):
    return spark.createDataFrame(_POLICY, "name string, wildcard boolean, tier string, priority int")


_POLICY_SQL = "policy(name, wildcard, tier, priority) AS (VALUES " + ", ".join(f"('{n}', {w}, '{t}', {p})" for n, w, t, p in _POLICY) + ")"


@query(f"""WITH {_POLICY_SQL}, h AS (SELECT page_id, {_HOST} AS host FROM pages)
SELECT tier, count(*) AS n FROM (SELECT page_id, coalesce(arg_min(tier, priority), 'standard') AS tier FROM h LEFT JOIN policy ON host = name OR (wildcard AND ends_with(host, '.' || name)) GROUP BY page_id) GROUP BY tier""")
def policy_tier(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.ascii_host(urls.parts(F.col("url"))["host"]).alias("host"))
    return urls.trust_tier(rows, policy(spark)).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"""WITH {_POLICY_SQL}, h AS (SELECT DISTINCT {_HOST} AS host FROM pages) SELECT host FROM h WHERE EXISTS (SELECT 1 FROM policy WHERE host = name OR (wildcard AND ends_with(host, '.' || name)))""")
def policy_suffix_semi(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.ascii_host(urls.parts(F.col("url"))["host"]).alias("host"))
    return urls.matched_entries(rows, policy(spark)).select("host").distinct()


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS entry FROM pages), l AS (SELECT entry, substr(md5(entry), 1, 1) AS list FROM h),
r AS (SELECT list, entry, sum(strlen(entry) + 1) OVER (PARTITION BY list ORDER BY entry ROWS UNBOUNDED PRECEDING) - 1 AS bytes FROM l) SELECT list, entry FROM r WHERE bytes <= 120""")
def domain_budget(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.ascii_host(urls.parts(F.col("url"))["host"]).alias("entry")).distinct().withColumn("list", F.substring(F.md5("entry"), 1, 1))
    return urls.within_budget(rows, 120, pos_col="entry").select("list", "entry")


_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_CACHE_SQL = f"""kept AS (SELECT page_id, url, list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT lower(split_part(x, '=', 1)) IN ({', '.join(repr(t) for t in urls.TRACKING)}))) AS q FROM pages),
normal AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || lower({_AUTH}) || CASE WHEN {_PATH} = '/' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM kept)"""


@query(f"WITH {_CACHE_SQL} SELECT page_id, u AS url FROM normal")
def cache_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.cache_url(F.col("url")).alias("url"))


@query(f"WITH {_CACHE_SQL} SELECT page_id, 'ret:' || sha256(u || ':full') AS key FROM normal")
def cache_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", cache.cache_key(urls.cache_url(F.col("url")), F.lit("full")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 30 - 2 <= 0 THEN 0 WHEN event_id % 3 = 0 THEN least(1, event_id % 30 - 2) ELSE event_id % 30 - 2 END AS ttl FROM events")
def effective_ttl(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", cache.effective_ttl(F.col("event_id") % 30 - 2, F.col("event_id") % 3 == 0).alias("ttl"))


@query("""WITH e AS (SELECT user_id AS key, event_id, ts FROM events),
w AS (SELECT key, ts AS wts FROM e WHERE event_id % 3 = 0), q AS (SELECT DISTINCT key, ts AS rts FROM e WHERE event_id % 3 = 1),
m AS (SELECT q.key, rts, max(wts) AS last FROM q LEFT JOIN w ON w.key = q.key AND wts <= rts GROUP BY q.key, rts)
SELECT key, rts, coalesce(date_sub('second', last, rts) < 3600, false) AS hit FROM m""")
def cache_latest_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    found = cache.latest_within(e.where("event_id % 3 = 1").select("key", F.col("ts").alias("rts")).distinct(), e.where("event_id % 3 = 0").select("key", F.col("ts").alias("wts")), 3600)
    return found.select("key", "rts", "hit")


@query("""WITH RECURSIVE o AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT key, event_id, ts, r, ts AS wrote, false AS hit FROM o WHERE r = 1
      UNION ALL SELECT o.key, o.event_id, o.ts, o.r, CASE WHEN date_sub('second', f.wrote, o.ts) < 86400 THEN f.wrote ELSE o.ts END, date_sub('second', f.wrote, o.ts) < 86400 FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1)
SELECT key, count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM f GROUP BY key""")
def cache_ttl_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", F.lit(86400).alias("ttl_seconds"))
    return cache.replay(e).groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("""WITH e AS (SELECT user_id % 20 AS cache, event_id AS key, ts AS used, 100 + event_id % 50 AS size FROM events),
r AS (SELECT cache, key, sum(size) OVER w AS bytes, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY cache ORDER BY used DESC, key ROWS UNBOUNDED PRECEDING)) SELECT cache, key FROM r WHERE bytes <= 2000 AND n <= 12""")
def cache_lru_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("cache"), F.col("event_id").alias("key"), F.col("ts").alias("used"), (100 + F.col("event_id") % 50).alias("size"))
    return cache.kept_by_recency(e, 2000, 12).select("cache", "key")


@query("""SELECT CASE WHEN event_id % 4 = 1 THEN 'unsigned' WHEN event_id % 4 = 2 THEN 'bad_mac' WHEN event_id % 4 = 3 THEN 'malformed' END AS fault, count(*) AS n FROM events GROUP BY 1""")
def cache_envelope(spark, sf_dir):
    wrap, unwrap = cache.envelope(b"k"), cache.unwrap(b"k")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), wrap(F.col("user_id").cast("string"), F.col("event_type")).alias("raw"))
    bad = F.when(F.col("event_id") % 4 == 1, F.lit("plain")).when(F.col("event_id") % 4 == 2, F.concat("raw", F.lit("x"))).when(F.col("event_id") % 4 == 3, F.lit("v1.abc")).otherwise(F.col("raw"))
    return e.select(unwrap(F.col("key"), bad)["fault"].alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT user_id AS key, event_id AS pos, event_id % 5 = 0 AS ok FROM events),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM o),
f AS (SELECT key, pos, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY key, island ORDER BY pos ROWS UNBOUNDED PRECEDING) AS failures FROM i)
SELECT key, pos, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN failures <= 0 THEN 0 ELSE least(30, pow(2, least(failures - 1, 30))) END AS INTEGER) AS wait FROM f""")
def backoff(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("event_id") % 5 == 0).alias("ok"))
    return cache.consecutive_failures(log).select("key", "pos", F.col("failures").cast("bigint").alias("failures"), cache.backoff_seconds(F.col("failures")).alias("wait"))


@query("SELECT page_id, page_id % 3 = 1 AS changed FROM pages")
def redirect_domain_changed(spark, sf_dir):
    chain = F.when(F.col("page_id") % 3 == 0, F.array("url")).when(F.col("page_id") % 3 == 1, F.array(F.col("url"), F.lit("https://other.example/"))).otherwise(F.array("url", "url"))
    return pages(spark, sf_dir).select("page_id", urls.domain_changed(chain).alias("changed"))


@query("""WITH RECURSIVE hops AS (SELECT page_id AS src, page_id + 100 AS dst FROM pages WHERE page_id % 4 <> 0),
walk AS (SELECT page_id AS start, page_id AS place, 0 AS n FROM pages UNION ALL SELECT start, dst, n + 1 FROM walk JOIN hops ON hops.src = walk.place WHERE n < 4) SELECT start, max(n) AS hops FROM walk GROUP BY start""")
def redirect_chain(spark, sf_dir):
    """Hops followed from each page, four at most, as a bounded chain of left joins."""
    p = table(spark, sf_dir, "pages").select("page_id")
    hops = p.where("page_id % 4 <> 0").select(F.col("page_id").alias("at"), (F.col("page_id") + 100).alias("dst"))
    rows = p.select(F.col("page_id").alias("start"), F.col("page_id").alias("at"), F.lit(0).alias("n"))
    for _ in range(4):
        rows = rows.join(hops, "at", "left").select("start", F.col("dst").alias("at"), F.when(F.col("dst").isNotNull(), F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return rows.select("start", F.col("n").alias("hops"))
