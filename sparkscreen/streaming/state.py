"""Counters, freshness and windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_folder


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_counters(events: DataFrame, key: str) -> DataFrame:
    """Monotone counts and a high-water mark by key, for complete or update mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max("value").alias("high_water"))


def windowed_counters(events: DataFrame, ts: str, key: str, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def freshness(events: DataFrame, key: str, ts: str, rid: str, ttl_seconds: int) -> DataFrame:
    """Hit or miss of each request of a key, its last write held as state; a batch is
    taken in order of time.  With a watermark on ``ts``, the state of a key leaves when its
    lifetime has passed; without one it stays."""
    timed = events.isStreaming and bool(_watermarked(events, ts))

    def decide(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wrote = state.get[0] if state.exists else None
        rows = sorted((r for b in batches for r in zip(b[ts], b[rid], strict=True)), key=lambda r: (r[0], r[1]))
        out = []
        for t, i in rows:
            now = t.value // 1000
            hit = wrote is not None and now - wrote < ttl_seconds * 1_000_000
            wrote = wrote if hit else now
            out.append((k[0], i, hit))
        if wrote is not None:
            state.update((wrote,))
            if timed:
                state.setTimeoutTimestamp(max(wrote // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, rid, "hit"])

    kinds = dict(events.dtypes)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return events.select(key, ts, rid).groupBy(key).applyInPandasWithState(decide, f"{key} {kinds[key]}, {rid} {kinds[rid]}, hit boolean", "wrote long", "append", timeout)


def _watermarked(events: DataFrame, ts: str) -> bool:
    """Whether the plan has a watermark on this column."""
    return "EventTimeWatermark" in events._jdf.queryExecution().analyzed().toString() and ts in events.columns


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end.  Its table and its checkpoint are in the shared folder, so nothing
    comes to the driver and any executor may be lost."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/streams/{name}"
    out = f"{at}/table"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(out)
    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def recency(accesses: DataFrame, cache: str, key: str, ts: str, rid: str, size: str, most_bytes: int, most_entries: int) -> DataFrame:
    """Hit or miss of each access of a cache that holds the keys used last, within a bound of bytes and of entries.

    A cache's state is what it holds, so it is bounded by ``most_entries``; an entry larger than the cache is never held.
    """

    def decide(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Keys by last use, the oldest first, and their sizes.
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        used = sum(held.values())
        rows = sorted((r for b in batches for r in zip(b[ts], b[rid], b[key], b[size], strict=True)), key=lambda r: (r[0], r[1]))
        out = []
        for _, i, name, n in rows:
            name, n = str(name), int(n)
            hit = name in held
            used -= held.pop(name, 0)
            if n <= most_bytes:
                held[name] = n
                used += n
            while used > most_bytes or len(held) > most_entries:
                used -= held.pop(next(iter(held)))
            out.append((k[0], i, hit))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=[cache, rid, "hit"])

    kinds = dict(accesses.dtypes)
    return accesses.select(cache, key, ts, rid, size).groupBy(cache).applyInPandasWithState(decide, f"{cache} {kinds[cache]}, {rid} {kinds[rid]}, hit boolean", "keys array<string>, sizes array<bigint>", "append", GroupStateTimeout.NoTimeout)
