"""Small transforms around the main ones."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import struct

MEMORY_UNITS = {"b": 1 / 1048576, "k": 1 / 1024, "kib": 1 / 1024, "m": 1.0, "mib": 1.0, "g": 1024.0, "gib": 1024.0}
# Why a document couldn't be read, by public code.
FAILURES = {
    "content_too_large": "Document exceeds the 50 MB extraction limit. Documents between 50 MB and the core upload limit of 100 MB can be uploaded but cannot be extracted.",
    "content_too_large_to_classify": "Document text is too large to classify safely.",
    "pdf_encrypted": "PDF is encrypted and cannot be extracted.",
    "pdf_no_text": "PDF contains no extractable text. OCR is not supported.",
    "unsupported_format": "Document format is unsupported or its content is invalid.",
    "extraction_failed": "Document extraction failed.",
    "busy": "Document extraction is currently busy. Please try again.",
}
# Hosts that are nobody's, and public ends under which a bare name is taken for a host.
RESERVED_NAMES, RESERVED_ENDS = ("example.com", "example.net", "example.org"), ("example", "test", "invalid")
PUBLIC_ENDS = tuple("com net org io co ai info biz xyz me app dev ru cn de uk us fr in site online top ly gl edu gov tv cc eu".split())


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first line that begins with one hash, else the fallback."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?md)^# (.*)$", 1)), F.lit("")), fallback)


def licence_of(text: Column) -> Column:
    """A licence's short name from the first 400 characters of its file."""
    head = F.substring(text, 1, 400)
    return F.when(head.contains("Apache License"), "Apache-2.0").when(head.contains("MIT License") | head.contains("Permission is hereby granted"), "MIT").when(head.contains("BSD"), "BSD-3-Clause").when(head.contains("Mozilla Public License"), "MPL-2.0")


def snapshot_name(path: Column) -> Column:
    """struct<owner, repo, sha> of names like owner__repo@sha."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"([^/]+?)__([^/@]+)@([0-9a-f]+)", k), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("sha"))


def origin(url: Column) -> Column:
    """Scheme, host and port of an endpoint; a bad port leaves the host; anything else is ``invalid``."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([A-Za-z0-9.-]+)", 1))
    port = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?[A-Za-z0-9.-]+:([^/?#]*)", 1)
    good = port.rlike("^[0-9]{1,5}$") & (port.try_cast("int") <= 65535)
    return F.when(host == "", "invalid").otherwise(F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z]+):", 1)), F.lit("://"), host, F.when(good, F.concat(F.lit(":"), port)).otherwise("")))


def usable_key(raw: Column) -> Column:
    """A key without surrounding space if all of it is printable ASCII, else null."""
    key = F.trim(raw)
    return F.when(key.rlike(r"^[!-~]+\z"), key)


def closed_token(value: Column, fallback: str) -> Column:
    return F.when(value.rlike(r"^[a-z][a-z0-9_]{0,63}\z"), value).otherwise(fallback)


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of what was added, removed or changed; manifests are (path, sha, size)."""
    o, n = (d.select("path", F.struct("sha", "size").alias(c)) for d, c in ((old, "o"), (new, "n")))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def exact_set(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, reasons) for every file that isn't exactly as expected."""
    e = expected.select("path", F.col("sha").alias("e_sha"), F.col("size").alias("e_size"))
    both = e.join(found.select("path", "sha", "size"), "path", "full_outer")
    missing, extra = F.col("sha").isNull(), F.col("e_sha").isNull()
    reasons = F.array_compact(F.array(F.when(missing, "missing"), F.when(extra, "extra"), F.when(~missing & ~extra & (F.col("size") != F.col("e_size")), "size"), F.when(~missing & ~extra & (F.col("sha") != F.col("e_sha")), "hash")))
    return both.select("path", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def longest_prefix(costs: DataFrame, key: str, pos: str, a: str, b: str, most_a: float, most_b: float) -> DataFrame:
    """The last position of each key up to which both sums stay within their limits; 0 if none."""
    run = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    sums = costs.withColumn("sa", F.sum(a).over(run)).withColumn("sb", F.sum(b).over(run))
    return sums.groupBy(key).agg(F.coalesce(F.max(F.when((F.col("sa") <= most_a) & (F.col("sb") <= most_b), F.col(pos))), F.lit(0)).alias("prefix"))


def memory_mib(value: Column) -> Column:
    """A size like 512m or 1.5GiB in MiB; null if it can't be read."""
    number = F.regexp_extract(F.lower(F.trim(value)), r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(F.trim(value)), r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 2)
    factor = F.create_map(*[x for k, v in MEMORY_UNITS.items() for x in (F.lit(k), F.lit(v))])
    return number * F.when(unit == "", F.lit(MEMORY_UNITS["b"])).otherwise(F.try_element_at(factor, unit))


def validity_failures(device: Column, wanted: Column, batch: Column, wanted_batch: Column) -> Column:
    return F.array_compact(F.array(F.when(~device.eqNullSafe(wanted), "device"), F.when(~batch.eqNullSafe(wanted_batch), "batch_size")))


def unknown_keys(config: Column, known: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.map_keys(config), F.array(*map(F.lit, known))))


def redacted_errors(locations: Column, allowed: tuple[str, ...], most: int = 100) -> Column:
    """struct<kept, dropped>: allow-listed segments of the first errors, and how many more there were."""
    kept = F.transform(F.slice(locations, 1, most), lambda loc: F.filter(loc, lambda s: s.isin(*allowed)))
    return F.struct(kept.alias("kept"), F.greatest(F.lit(0), F.size(locations) - most).alias("dropped"))


def filler(vocabulary: list[str], n: int, stride: int = 7) -> Column:
    """Words picked from a vocabulary by a stride."""
    vocab = F.array(*map(F.lit, vocabulary))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(vocab, (i * stride) % len(vocabulary))), " ")


def public_reason(code: Column) -> Column:
    """The sentence for a public code; null for what is none."""
    known = F.create_map(*[x for k, v in FAILURES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(known, code)


def nested_outcomes(rows: DataFrame) -> DataFrame:
    """(id, outcomes): route → config → outcome of each id as nested maps."""
    inner = rows.groupBy("id", "route").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", "outcome")))).alias("m"))
    return inner.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", F.to_json("m").alias("j"))))).alias("outcomes"))


def flat_outcomes(nested: DataFrame) -> DataFrame:
    """The inverse."""
    return nested.select("id", F.explode("outcomes").alias("route", "j")).select("id", "route", F.explode(F.from_json("j", "map<string,string>")).alias("config", "outcome"))


def blocking_error(responses: DataFrame, table: DataFrame) -> DataFrame:
    """responses (route, status, error, reason) that a row of the table matches; a null reason there matches any."""
    t = table.select(F.col("route").alias("t_route"), F.col("status").alias("t_status"), F.col("error").alias("t_error"), F.col("reason").alias("t_reason"))
    same = (F.col("route") == F.col("t_route")) & (F.col("status") == F.col("t_status")) & (F.col("error") == F.col("t_error")) & (F.col("t_reason").isNull() | (F.col("t_reason") == F.col("reason")))
    return responses.join(t, same, "left_semi")


def _decided(active: int, depth: int):
    """A function over Arrow batches (key, id, arrive, hold) in order that adds ``what`` and keeps the ends of one gate only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, ends = object(), []  # ends in order; a NaN is the largest, as in Spark
        for batch in batches:
            keys, ids, *times = batch.columns
            out = []
            for key, arrive, hold in zip(keys.to_pylist(), *(c.to_pylist() for c in times), strict=True):
                if key != gate and (key == key or gate == gate):
                    gate, ends = key, []
                now = None if arrive is None else (arrive != arrive, arrive)
                ends = [] if now is None else ends[bisect_right(ends, now) :]
                n = len(ends)
                out.append("served" if n < active else "queued" if n < active + depth else "refused")
                if n < active + depth and hold is not None:
                    begin = arrive if n < active else ends[n - active][1] if active > 0 else None
                    if begin is not None:
                        insort(ends, (begin + hold != begin + hold, begin + hold))
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(out, pa.string())], ["key", "id", "what"])

    return run


def admission(log: DataFrame, key: str = "gate", active: int = 1, depth: int = 4) -> DataFrame:
    """log (gate, id, arrive, hold) of one gate each in order of arrival: served, queued or refused.

    With ``active`` places at work and ``depth`` waiting, what a gate's task holds is the ends of those admitted, however
    long the log is.  Each decision needs the one before, so a gate is one task's; gates go side by side.
    """
    rows = log.select(F.col(key).alias("key"), "id", "arrive", "hold").repartition("key").sortWithinPartitions("key", "arrive", "id", "hold")
    plain = rows.select("key", F.col("id").cast("bigint"), F.col("arrive").cast("double"), F.col("hold").cast("double"))
    schema = T.StructType([plain.schema["key"], plain.schema["id"], T.StructField("what", T.StringType())])
    return plain.mapInArrow(_decided(active, depth), schema).withColumnRenamed("key", key)


def deadline(rows: DataFrame, key: str, pos: str, cost: str, budget: float) -> DataFrame:
    """Adds ``in_time``: whether the costs before a row leave some of the budget."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in_time", F.coalesce(F.sum(cost).over(before), F.lit(0.0)) < budget)


_ADDRESS = re.compile(r"""\b([a-z][a-z0-9+.\-]*://)([^/\s?#'"<>`)\]]+)""", re.I)
_NAME = re.compile(r"\b((?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+(?:" + "|".join(PUBLIC_ENDS) + r"))\b", re.I)
_ODD = re.compile(r"[^a-z0-9\-]+")


def is_reserved(host: str) -> bool:
    labels = host.rstrip(".").lower().split(".")
    return labels[-1] in RESERVED_ENDS or ".".join(labels[-2:]) in RESERVED_NAMES


def reserved_host(host: str) -> str:
    """A host under a reserved end: without www and its own end, junk as hyphens, 48 characters; reserved ones stay."""
    if is_reserved(host):
        return host
    labels = [x for x in host.lower().split(".") if x]
    labels = labels[labels[:1] == ["www"] :]
    return (_ODD.sub("-", "-".join(labels[:-1] or labels)).strip("-") or "host")[:48] + ".example"


def _host_of(authority: str) -> str:
    place = authority.rpartition("@")[2]
    return place[1:].partition("]")[0] if place.startswith("[") else place.partition(":")[0]


def with_reserved_hosts(text: str) -> str:
    """Every host that the text names, in an address or alone, made a reserved one; users and ports go."""
    text = _ADDRESS.sub(lambda m: m[1] + reserved_host(_host_of(m[2])), text)
    return _NAME.sub(lambda m: reserved_host(m[1]), text)


@F.pandas_udf(struct("text string, changed boolean"))
def reserved_urls(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Texts whose hosts are reserved ones only, and whether anything was changed."""
    for batch in text:
        new = [None if t is None else with_reserved_hosts(t) for t in batch]
        yield pd.DataFrame({"text": new, "changed": [a != b for a, b in zip(batch, new, strict=True)]})


def slug_url(genre: Column, title: Column) -> Column:
    """A result URL under a reserved host."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)
    return F.concat(F.lit("https://"), F.lower(genre), F.lit(".example/"), slug)


def rst_prose(text: Column) -> Column:
    """Text of reStructuredText without underline rows and directive blocks."""
    lines = F.split(text, "\n", -1)
    state = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        directive, indented = line.rlike(r"^\.\. "), line.rlike(r"^(\s+\S.*|\s*)$")
        skip = directive | (a["skip"] & indented)
        drop = skip | line.rlike(r"^([=\-~^#*+\"'`])\1{2,}\s*$")
        return F.struct(skip.alias("skip"), F.when(drop, a["out"]).otherwise(F.concat(a["out"], F.array(line))).alias("out"))

    return F.array_join(F.aggregate(lines, state, step, lambda a: a["out"]), "\n")
