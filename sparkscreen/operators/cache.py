"""Freshness-aware caching: keys, lifetimes, envelopes, and replays of request logs."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import kind, struct

NEVER = ("untrusted", "blocked")


def policy_fingerprint(settings: Column) -> Column:
    """First 16 hex digits over a struct's JSON; give its fields in sorted order."""
    return F.substring(F.sha2(F.to_json(settings), 256), 1, 16)


def cache_key(url: Column, mode: Column, policy: Column | None = None) -> Column:
    parts = [url, mode] + ([policy] if policy is not None else [])
    return F.concat(F.lit("ret:"), F.sha2(F.concat_ws(":", *parts), 256))


def effective_ttl(ttl_hours: Column, news: Column) -> Column:
    """Nothing below one hour counts; news is kept an hour at most."""
    return F.when(ttl_hours <= 0, 0).when(news, F.least(F.lit(1), ttl_hours)).otherwise(ttl_hours)


def cacheable(ttl: Column, detected: Column, timed_out: Column, state: Column, loaded: Column, tier: Column) -> Column:
    return (ttl > 0) & ~detected & ~timed_out & ~((state == "unavailable_allowed") & loaded) & ~tier.isin(*NEVER)


def replay(requests: DataFrame, key: str = "key", ts: str = "ts", ttl: str = "ttl_seconds", rid: str = "event_id") -> DataFrame:
    """Hits and misses of a request log with time to live: a request is a hit when
    the last write of its key is younger than the lifetime; a miss writes.

    The chain of writes of one key is a fold over its times in order.
    """
    state = F.struct(F.lit(None).cast("timestamp_ntz").alias("wrote"), F.array().cast("array<struct<id:bigint,hit:boolean>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        hit = F.coalesce(F.timestamp_diff("SECOND", a["wrote"], r["ts"]) < r["ttl"], F.lit(False))
        return F.struct(F.when(hit, a["wrote"]).otherwise(r["ts"]).alias("wrote"), F.concat(a["out"], F.array(F.struct(r["id"].alias("id"), hit.alias("hit")))).alias("out"))

    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(rid).alias("id"), F.col(ttl).alias("ttl"))))
    folded = requests.groupBy(key).agg(F.aggregate(rows, state, step, lambda a: a["out"]).alias("o"))
    return folded.select(key, F.explode("o").alias("o")).select(key, F.col("o.id").alias(rid), F.col("o.hit").alias("hit"))


def latest_within(requests: DataFrame, writes: DataFrame, ttl_seconds: int) -> DataFrame:
    """requests (key, rts) with the latest write (key, wts) up to them that is still fresh: hit and its time.

    One pass over the two logs in order of time, so no request meets all writes of its key.
    """
    both = requests.select("key", F.col("rts").alias("at"), F.lit(None).cast("timestamp_ntz").alias("wts"), F.lit(1).alias("asks"))
    both = both.unionByName(writes.select("key", F.col("wts").alias("at"), F.col("wts").cast("timestamp_ntz").alias("wts"), F.lit(0).alias("asks")))
    run = Window.partitionBy("key").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("last", F.last("wts", ignorenulls=True).over(run)).where("asks = 1").select("key", F.col("at").alias("rts"), "last").distinct()
    return met.withColumn("hit", F.coalesce(F.timestamp_diff("SECOND", F.col("last"), F.col("rts")) < ttl_seconds, F.lit(False)))


def kept_by_recency(entries: DataFrame, most_bytes: int, most_entries: int) -> DataFrame:
    """entries (cache, key, used, size): those that stay when the least recent go; a cache is one bounded store."""
    order = Window.partitionBy("cache").orderBy(F.desc("used"), "key")
    return entries.withColumn("bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order)).where((F.col("bytes") <= most_bytes) & (F.col("n") <= most_entries))


def _mac(secret: bytes, key: str, payload: str) -> str:
    return hmac.new(secret, key.encode() + b"\0" + payload.encode(), hashlib.sha256).hexdigest()


def envelope(secret: bytes):
    """A column function (key, payload) → signed envelope."""

    @F.pandas_udf(kind("string"))
    def wrap(key: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, p in key:
            yield pd.Series([None if b is None else f"v1.{_mac(secret, a or '', b)}.{b}" for a, b in zip(k, p, strict=True)])

    return wrap


def unwrap(secret: bytes, most: int = 1 << 20):
    """A column function (key, raw) → struct<payload, fault>; fault is oversize, unsigned, malformed or bad_mac."""

    @F.pandas_udf(struct("payload string, fault string"))
    def open_(key: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(k, raw):
            if raw is None:
                return None, None
            if len(raw.encode()) > most:
                return None, "oversize"
            parts = raw.split(".", 2)
            if parts[0] != "v1":
                return None, "unsigned"
            if len(parts) != 3:
                return None, "malformed"
            return (parts[2], None) if hmac.compare_digest(parts[1], _mac(secret, k or "", parts[2])) else (None, "bad_mac")

        for k, r in key:
            yield pd.DataFrame([one(a, b) for a, b in zip(k, r, strict=True)], columns=["payload", "fault"])

    return open_


def backoff_seconds(failures: Column, least: int = 1, most: int = 30) -> Column:
    """Doubling from the least to the most with consecutive failures."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(most), (F.lit(least) * F.pow(F.lit(2), F.least(failures - 1, F.lit(30)))).cast("bigint"))).cast("int")


def consecutive_failures(log: DataFrame, key: str = "key", order: str = "pos", ok: str = "ok") -> DataFrame:
    """Adds the run of failures that ends at each row."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("island", F.sum(F.col(ok).cast("int")).over(run)).withColumn("failures", F.sum((~F.col(ok)).cast("int")).over(island)).drop("island")
