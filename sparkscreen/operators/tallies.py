"""Small tallies, allocations and checks of the evaluation suite."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pooling
from ..functions.kinds import kind
from .records import leak_form

# Bytes of an upload at most, and bytes that a character may take.
UPLOAD_BYTES, CHARACTER_BYTES = 2 << 20, 4
# Window length without its ends, windows at most, characters of a token.
WINDOW_BODY, CHARACTERS = 512 - 64, 4


def unmeasured(models: DataFrame, allowed: DataFrame) -> DataFrame:
    """Measured models that aren't allowed."""
    return models.select("model").distinct().join(allowed.select("model"), "model", "left_anti")


def numbered_after(rows: DataFrame, held: DataFrame, prefix: str, order: str, stratum: str = "category", surfaces: tuple[str, ...] = ("search", "page", "text")) -> DataFrame:
    """New records with ids that follow the greatest one held, and a surface each in turn.

    held: (id) like ``ben-0012``.  Ids are given in the order of stratum and ``order``; ranks are
    worked out in each stratum, and the strata, of which there are few, are put one behind the other.
    """
    greatest = held.where(F.col("id").startswith(prefix + "-")).agg(F.coalesce(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("int")), F.lit(0)).alias("greatest"))
    before = rows.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(stratum, "before")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    at = F.col("before") + F.col("rank")
    placed = ranked.join(F.broadcast(before), stratum).crossJoin(F.broadcast(greatest))
    surface = F.element_at(F.array(*map(F.lit, surfaces)), ((at - 1) % len(surfaces) + 1).cast("int"))
    return placed.withColumn("id", F.format_string(prefix + "-%04d", F.col("greatest") + at)).withColumn("surface", surface).drop("before", "greatest", "rank")


def half_caught(rows: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """Of each stratum up to ``n`` rows, half of them caught ones and half missed ones (``caught``), the odd one missed."""
    turn = F.row_number().over(Window.partitionBy(stratum, "caught").orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= F.when(F.col("caught"), n // 2).otherwise(n - n // 2)).drop("turn")


def first_scores(results: DataFrame, configs: tuple[str, ...]) -> DataFrame:
    """results (kind, id, config, scores): by kind, records, those that some configuration scored, and
    those whose scores of the first such configuration fire a rule."""
    place = F.array_position(F.array(*map(F.lit, configs)), F.col("config"))
    reached = F.when(F.size("scores") > 0, F.struct(place.alias("place"), "scores"))
    each = results.groupBy("kind", "id").agg(F.min(reached).alias("first"))
    s = F.col("first.scores")
    there = s.isNotNull()
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count("first").alias("reached"), F.count_if(there & pooling.max_score(pooling.MAX_THRESHOLD)(s)).alias("max_fired"), F.count_if(there & pooling.contiguity(pooling.RUN_LENGTH, pooling.RUN_THRESHOLD)(s)).alias("run_fired"))


def rejections_by_reason(candidates: DataFrame, genres: DataFrame) -> DataFrame:
    """(genre, reason, rejected, examined, rate) of every reason that came up, and a row without a reason for genres where nothing was rejected."""
    examined = candidates.groupBy("genre").agg(F.count("*").alias("examined"))
    reasons = candidates.where("reason is not null").groupBy("genre", "reason").agg(F.count("*").alias("rejected"))
    rows = genres.join(examined, "genre", "left").join(reasons, "genre", "left")
    n, of = F.coalesce("rejected", F.lit(0)), F.coalesce("examined", F.lit(0))
    return rows.select("genre", "reason", n.alias("rejected"), of.alias("examined"), F.round(n / F.nullif(of, F.lit(0)), 6).alias("rate"))


def windows_with_unscanned(scored: DataFrame) -> DataFrame:
    """Numbers of rows by number of windows; rows without scores count as unscanned, at -1."""
    return scored.groupBy(F.coalesce(F.when(F.col("scores").isNotNull(), F.size("scores")), F.lit(-1)).alias("windows")).agg(F.count("*").alias("n"))


def upload_budget(text: Column, chunks: int = 64) -> Column:
    """Whether an upload stays within the characters of its windows and the bytes of those, 2 MiB at most."""
    most = WINDOW_BODY * chunks * CHARACTERS
    return (F.length(text) <= most) & (F.octet_length(text) <= min(UPLOAD_BYTES, CHARACTER_BYTES * most))


def marker_on_wire(strings: Column, marker: Column) -> Column:
    """Whether the marker, normalised and without case, stands in one of the strings of an answer."""
    joined = F.array_join(strings, "\n\x00\n")
    return F.contains(leak_form(joined), leak_form(marker))


def wire_strings(row: dict[str, str], leave_out: tuple[str, ...] = ("injection_spans",)) -> Column:
    """The strings of an answer's columns (name → type as ``dtypes`` has it), their names among them, without the spans that quote the input."""
    names = [c for c in row if c not in leave_out]
    texts = [F.coalesce(F.col(c), F.lit("")) for c in names if row[c] == "string"]
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in names if row[c] == "array<string>"]
    return F.concat(F.array(*map(F.lit, names)), F.array(*texts), *lists)


def memory_rule(parts_mib: Column, limit_mib: Column) -> Column:
    """ok, or how many MiB the sum of the parts passes the limit by; unknown without a limit."""
    total = F.aggregate(parts_mib, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(limit_mib.isNull(), "unknown").when(total <= limit_mib, "ok").otherwise(F.concat(F.lit("over by "), F.ceil(total - limit_mib).cast("string")))


def _leaves(node, path=()) -> Iterator[tuple[str, float]]:
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, (*path, str(k)))
    elif isinstance(node, (int, float)) and not isinstance(node, bool):
        yield "/".join(path), float(node)
    else:
        raise ValueError(f"no number at {'/'.join(path)}")


@F.pandas_udf(kind("map<string,double>"))
def numbers_of(tree: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON tree of numbers as path → number; anything else in it is an error."""
    for batch in tree:
        yield batch.map(lambda t: None if t is None else dict(_leaves(json.loads(t))))


def revision_of(sources: dict[str, bytes], settings: dict[str, object]) -> str:
    """One hash over source files, in order of their names, and settings: what a recorded result depends on."""
    h = hashlib.sha256()
    for name in sorted(sources):
        h.update(f"{name}\0{len(sources[name])}\0".encode() + sources[name])
    h.update(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode())
    return h.hexdigest()
