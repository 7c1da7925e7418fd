"""Search results: provider payloads, fallback chain, decision ladder, response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METASEARCH = "results array<struct<title:string,url:string,content:string,engine:string,publishedDate:string>>, unresponsive_engines array<string>"
GROUNDING = "grounding struct<generic:array<struct<title:string,url:string,snippets:array<string>>>>, sources map<string,struct<age:array<string>>>"
MOST_CANDIDATES, SNIPPET_CAP = 20, 2000
OMISSIONS = ("invalid_url", "private_ip", "blocked_domain", "structural_block", "injection_detected", "promptguard_unavailable")


def metasearch_rows(bodies: DataFrame, most: int, body_col: str = "body") -> DataFrame:
    """Rows (keys, pos, title, url, content, engine, date) of the first results; a body that isn't JSON of that shape gives none."""
    got = F.from_json(body_col, METASEARCH)["results"]
    rest = [c for c in bodies.columns if c != body_col]
    rows = bodies.select(*rest, F.posexplode(F.slice(F.coalesce(got, F.array().cast("array<struct<title:string,url:string,content:string,engine:string,publishedDate:string>>")), 1, most)).alias("pos", "r"))
    return rows.select(*rest, "pos", "r.title", "r.url", "r.content", "r.engine", F.col("r.publishedDate").alias("date"))


def grounding_rows(bodies: DataFrame, most: int, body_col: str = "body") -> DataFrame:
    """The same of a grounding body: snippets joined by blank lines and cut, the first age that is a day."""
    g = F.from_json(body_col, GROUNDING)
    rest = [c for c in bodies.columns if c != body_col]
    entries = F.coalesce(g["grounding"]["generic"], F.array().cast("array<struct<title:string,url:string,snippets:array<string>>>"))
    rows = bodies.select(*rest, g["sources"].alias("sources"), F.posexplode(F.slice(entries, 1, most)).alias("pos", "r"))
    age = F.filter(F.try_element_at("sources", F.col("r.url"))["age"], lambda a: a.rlike(r"^\d{4}-\d{2}-\d{2}"))
    return rows.select(*rest, "pos", "r.title", "r.url", F.substring(F.array_join(F.filter("r.snippets", lambda s: s.isNotNull()), "\n\n"), 1, SNIPPET_CAP).alias("content"), F.substring(F.get(age, F.lit(0)), 1, 10).alias("date"))


def failure_class(status: Column) -> Column:
    """Class of an HTTP status that isn't success; null for success."""
    return F.when(status.between(200, 299), None).when(status.isin(401, 403), "auth").when(status == 429, "rate_limited").when(status.between(300, 399), "redirect").when(status.between(500, 599), "server_error").when(status.between(400, 499), "client_error").otherwise("unexpected")


def provider_names(raw: Column, default: str) -> Column:
    """Trimmed lower-case names of a comma list, in order, each once; the default if none."""
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def served_chain(attempts: DataFrame, key: str = "request_id") -> DataFrame:
    """attempts (key, pos, provider, ok): the first success, whether it was a fallback, and the failures before it."""
    first = F.min(F.when(F.col("ok"), F.col("pos"))).over(Window.partitionBy(key))
    rows = attempts.withColumn("first", first)
    before = F.col("first").isNull() | (F.col("pos") < F.col("first"))
    errors = F.array_sort(F.collect_list(F.when(before, F.struct("pos", "provider"))))
    served = F.max(F.when(F.col("pos") == F.col("first"), F.col("provider")))
    return rows.groupBy(key).agg(served.alias("provider_used"), (F.coalesce(F.min("first"), F.lit(0)) > 0).alias("fallback_fired"), F.array_join(F.transform(errors, lambda e: e["provider"]), ",").alias("provider_errors"))


def paid_prefix(chain: DataFrame, key: str = "request_id") -> DataFrame:
    """chain (key, pos, provider, paid, named, paid_allowed): free providers stay; paid ones as long as all paid before are named too."""
    run = Window.partitionBy(key, "paid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return chain.withColumn("all_named", F.min(F.col("named").cast("int")).over(run)).where(~F.col("paid") | (F.col("paid_allowed") & (F.col("all_named") == 1))).drop("all_named")


def omission(url_token: Column, url_private: Column, denied: Column, verdict: Column, state: Column, detected: Column) -> Column:
    """Why a result is left out, in the order of the ladder; null if it is kept."""
    return F.coalesce(
        F.when(url_private, "private_ip"), F.when(url_token.isNotNull(), "invalid_url"), F.when(denied, "blocked_domain"), F.when(verdict == "blocked", "structural_block"),
        F.when(state == "unavailable_blocked", "promptguard_unavailable"), F.when(detected, "injection_detected"),
    )


def examined(rows: DataFrame, limit: int, key: str = "query_id", order: str = "pos") -> DataFrame:
    """Rows that are looked at in order until ``limit`` are kept: those with fewer kept before them.  A query has 20 candidates at most."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("kept_before", F.coalesce(F.sum(F.col("omission").isNull().cast("int")).over(before), F.lit(0))).where(F.col("kept_before") < limit)


def omission_counts(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Numbers by reason; unknown reasons count as other."""
    reason = F.when(F.col("omission").isin(*OMISSIONS), F.col("omission")).otherwise("other")
    return rows.where("omission is not null").groupBy(key, reason.alias("reason")).agg(F.count("*").alias("n"))


def response(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """One row a query: kept urls in order, omissions, and their map by reason as text."""
    kept = F.array_sort(F.collect_list(F.when(F.col("omission").isNull(), F.struct("pos", "url"))))
    reasons = F.array_sort(F.collect_list(F.when(F.col("omission").isNotNull(), F.col("omission"))))
    out = rows.groupBy(key).agg(kept.alias("kept"), reasons.alias("reasons"))
    names = F.array_distinct("reasons")
    text = F.array_join(F.transform(names, lambda n: F.concat_ws("=", n, F.size(F.filter("reasons", lambda r: r == n)).cast("string"))), ",")
    return out.select(key, F.array_join(F.transform("kept", lambda k: k["url"]), " ").alias("urls"), F.size("kept").alias("n_results"), F.size("reasons").alias("omitted_results"), text.alias("omitted_by_reason"))


def scored_text(title: Column, url: Column, snippet: Column) -> Column:
    """The three lines that a classifier gets."""
    return F.concat(F.lit("Title: "), title, F.lit("\nURL: "), url, F.lit("\nSnippet: "), snippet)
