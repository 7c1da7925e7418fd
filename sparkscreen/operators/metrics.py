"""Operational counters as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketed(value: Column, known: tuple[str, ...], other: str = "other") -> Column:
    return F.when(value.isin(*known), value).otherwise(other)


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def high_water(events: DataFrame, value: str, target: float, keys: list[str]) -> DataFrame:
    """Greatest whole value and how often a target was exceeded."""
    return events.groupBy(*keys).agg(F.max(F.floor(value)).cast("bigint").alias("high_water"), F.count_if(F.col(value) > target).alias("exceeded"))


def ratio(now: Column, most: Column) -> Column:
    """Null when there is no maximum."""
    return F.try_divide(now, F.nullif(most, F.lit(0)))


def counter_document(events: DataFrame, key: str) -> DataFrame:
    """All counts as one map in one row: as many entries as there are kinds."""
    counted = events.groupBy(key).agg(F.count("*").alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"), F.sum("n").alias("total"))
