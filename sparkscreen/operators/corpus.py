"""The labelled-corpus evaluation suite as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("blocked", "flagged", "neutralised", "leaked")
STAGES = ("url", "structural", "classifier", "marker", "none")


def outcome(blocked: Column, flagged: Column, has_marker: Column, leaked: Column) -> Column:
    """blocked before flagged before clean (no marker) before leaked or neutralised."""
    return F.when(blocked, "blocked").when(flagged, "flagged").when(~has_marker, "clean").when(leaked, "leaked").otherwise("neutralised")


def marker_leaks(strings: Column, marker: Column) -> Column:
    """Whether the normalised marker stands in any of the strings."""
    return F.exists(strings, lambda s: F.contains(F.lower(s), F.lower(marker)))


def marker_of(text: Column, least: int = 12, most: int = 60) -> Column:
    """The longest line, the first of equals, cut at a space before ``most``; null if all are short."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    best = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    head = F.substring(best, 1, most)
    cut = F.when(F.length(best) <= most, best).when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(best) >= least, cut)


def _rate(n: Column, of: Column) -> Column:
    return F.round(n / F.nullif(of, F.lit(0)), 6)


def attack_cells(results: DataFrame, keys: list[str]) -> DataFrame:
    """results (keys, outcome, leaked): numbers of outcomes, blocked but leaked ones, and rates."""
    agg = [F.count("*").alias("n")] + [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES] + [F.count_if((F.col("outcome") == "blocked") & F.col("leaked")).alias("n_blocked_leaked")]
    cells = results.groupBy(*keys).agg(*agg)
    return cells.withColumn("catch_rate", _rate(F.col("n_blocked") + F.col("n_flagged"), F.col("n"))).withColumn("block_rate", _rate(F.col("n_blocked"), F.col("n")))


def benign_cells(results: DataFrame, keys: list[str]) -> DataFrame:
    cells = results.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "blocked").alias("n_blocked"), F.count_if(F.col("outcome") == "flagged").alias("n_flagged"))
    return cells.withColumn("fpr", _rate(F.col("n_blocked") + F.col("n_flagged"), F.col("n")))


def headline(attack: DataFrame, benign: DataFrame, keys: list[str], external: Column) -> DataFrame:
    """Sums over cells; ``external`` says which benign cells count for the outer rate."""
    a = attack.groupBy(*keys).agg(F.sum("n").alias("attacks"), F.sum(F.col("n_blocked") + F.col("n_flagged")).alias("caught"))
    b = benign.groupBy(*keys).agg(F.sum("n").alias("benign"), F.sum(F.when(external, F.col("n"))).alias("external"), F.sum(F.when(external, F.col("n_blocked") + F.col("n_flagged"))).alias("external_hits"))
    return a.join(b, keys, "full_outer").withColumn("catch_all", _rate(F.col("caught"), F.col("attacks"))).withColumn("fpr_external", _rate(F.col("external_hits"), F.col("external")))


def pool_sweep(scored: DataFrame, poolers, groups: Column) -> DataFrame:
    """scored (scores, …): for each setting and group the rows that fire; a row counts in each of its groups.

    All settings are columns of one pass; nothing is multiplied before it is counted.
    """
    fired = scored.select(F.explode(groups).alias("group"), F.size("scores").alias("windows"), *[p(F.col("scores")).alias(f"f{i}") for i, (_, p, _) in enumerate(poolers)])
    counts = fired.groupBy("group").agg(F.count("*").alias("n"), F.max("windows").alias("most_windows"), *[F.count_if(F.col(f"f{i}")).alias(f"f{i}") for i in range(len(poolers))])
    rows = F.array(*[F.struct(F.lit(name).alias("pooler"), F.col(f"f{i}").alias("fired"), (F.col("most_windows") < need).alias("not_applicable")) for i, (name, _, need) in enumerate(poolers)])
    return counts.select("group", "n", F.explode(rows).alias("r")).select("group", "n", "r.*")


def floor_down(rate: Column) -> Column:
    """Down to a twentieth, after four places, with a guard."""
    return F.round(F.floor(F.bround(rate, 4) * 20 + 1e-9) / 20, 2)


def ceil_up(rate: Column) -> Column:
    return F.round(F.ceil(F.bround(rate, 4) * 20 - 1e-9) / 20, 2)


def floors_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """What changed between two sets of floors: added, removed, tightened, loosened or same."""
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") > F.col("old"), "tighten").when(F.col("new") < F.col("old"), "loosen").otherwise("same")
    return o.join(n, key, "full_outer").withColumn("change", change)


def regressed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Caught before and not caught now."""
    caught = F.col("outcome").isin("blocked", "flagged")
    return old.where(caught).select(*keys).join(new.where(caught).select(*keys), keys, "left_anti")


def verdict_changes(live: DataFrame, replay: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose fields differ, null-safe, with the names of those fields."""
    other = replay.select(*keys, *[F.col(f).alias(f"r_{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"r_{f}")), f) for f in fields]))
    return live.join(other, keys).withColumn("changed", names).where(F.size("changed") > 0).select(*keys, F.array_join("changed", ",").alias("changed"))


def score_drift(pairs: DataFrame, a: str = "scores", b: str = "other") -> DataFrame:
    """Greatest difference, nearest-rank 99th percentile, and lists of different lengths."""
    diffs = pairs.select(F.size(a).alias("na"), F.size(b).alias("nb"), F.zip_with(a, b, lambda x, y: F.abs(x - y)).alias("d"), F.abs(F.array_max(a) - F.array_max(b)).alias("page"))
    whole = diffs.agg(F.count_if(F.col("na") != F.col("nb")).alias("count_mismatches"), F.round(F.max("page"), 6).alias("max_page_drift"))
    each = diffs.where("na = nb").select(F.explode("d").alias("d")).agg(F.round(F.max("d"), 6).alias("max_drift"), F.round(F.expr("percentile_disc(0.99) within group (order by d)"), 6).alias("p99_drift"))
    return whole.crossJoin(each)


def nearest_rank(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Percentiles by nearest rank; the 95th only from five samples on."""
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95")).withColumn("p95", F.when(F.col("n") >= 5, F.col("p95")))


def near_threshold(scores: Column, threshold: float = 0.85, within: float = 0.01) -> Column:
    return F.exists(scores, lambda s: F.abs(s - threshold) <= within + 1e-12)


def crossings(a: Column, b: Column, threshold: float) -> Column:
    """Places at which only one of two score lists exceeds the threshold."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > threshold) != (y > threshold)), lambda z: z))


def replayed(texts: DataFrame, cassette: DataFrame, fallback: float | None = None) -> DataFrame:
    """texts (…, text) with recorded scores by the text's SHA-256; a constant list where a recording lacks."""
    keyed = texts.withColumn("sha256", F.sha2("text", 256)).join(cassette.select("sha256", "scores"), "sha256", "left")
    return keyed if fallback is None else keyed.withColumn("scores", F.coalesce("scores", F.array(F.lit(fallback))))


def missing_recordings(texts: DataFrame, cassette: DataFrame) -> DataFrame:
    return texts.withColumn("sha256", F.sha2("text", 256)).join(cassette.select("sha256"), "sha256", "left_anti")


def lint(records: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """(key, rule) for each rule that fails, and for keys that occur twice."""
    broken = records.select(key, F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))).alias("rule"))
    twice = records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("unique_id").alias("rule"))
    return broken.unionByName(twice)


def first_of_equal(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each white-space-collapsed content; as an aggregate, so a text that a third of all rows have is combined before it moves."""
    digest = F.sha2(F.trim(F.regexp_replace(text, r"[ \n\t\r]+", " ")), 256)
    return rows.groupBy(digest.alias("content")).agg(F.min(order).alias(order))


def interleaved(rows: DataFrame, stratum: str, ref: str, seed: str) -> DataFrame:
    """Seeded order in each stratum, then one of each in turn.  Another permutation than a shuffle gives."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(ref).cast("string"), F.lit(seed))))
    return rows.withColumn("turn", F.row_number().over(order))


def quota(rows: DataFrame, stratum: str, ref: str, seed: str, n: int) -> DataFrame:
    return interleaved(rows, stratum, ref, seed).where(F.col("turn") <= n)


def screen_reason(licence: Column, pinned: Column, secret: Column, chars: Column, alpha: Column, least: int) -> Column:
    """The first reason against a candidate."""
    return F.coalesce(F.when(licence.isNull(), "licence"), F.when(~pinned, "unpinned"), F.when(secret, "secret"), F.when(chars < least, "too_short"), F.when(alpha < 0.55, "non_prose"))


def rejections(candidates: DataFrame, genres: DataFrame) -> DataFrame:
    """candidates (genre, reason): examined, rejected and rate for every genre, those without candidates too."""
    counted = candidates.groupBy("genre").agg(F.count("*").alias("examined"), F.count("reason").alias("rejected"))
    return genres.join(counted, "genre", "left").select("genre", F.coalesce("examined", F.lit(0)).alias("examined"), F.coalesce("rejected", F.lit(0)).alias("rejected"), _rate(F.col("rejected"), F.col("examined")).alias("rate"))


def _minimizers(text: str | None, length: int) -> np.ndarray:
    """For each window of ``length`` (32 to 48) characters, the least of the hashes of its 24-character parts; distinct.

    Texts that share a window share its least part, whatever is around it.
    """
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if c.size < length:
        return np.zeros(0, np.int64)
    base, h, parts = 0x9E3779B97F4A7C15, c + np.uint64(1), {}
    for k in (1, 2, 4, 8):
        parts[k] = h
        h = h[:-k] * np.uint64(pow(base, k, 1 << 64)) + h[k:]
    h = h[:-8] * np.uint64(pow(base, 8, 1 << 64)) + parts[8][16:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    wide = length - 23
    k = 1
    while 2 * k <= wide:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    h = np.minimum(h[: h.size - (wide - k)], h[wide - k :])
    return np.unique(h).view(np.int64)


def window_keys(text: Column, length: int) -> Column:
    """Keys of a text's windows: a text that holds a window has the window's key."""

    @F.pandas_udf("array<bigint>")
    def keys(t: pd.Series) -> pd.Series:
        return t.map(lambda x: _minimizers(x, length))

    return keys(text)


def documents_with_markers(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """docs: (doc_id, text), items: (item_id, text).  Pairs whose document holds the first ``length`` characters of the item, in either case.

    Items that are shorter mark nothing.  Candidates meet by keys that no holding
    document lacks, and then the marker is looked for.
    """
    marks = items.where(F.length("text") >= length).select("item_id", F.lower(F.substring("text", 1, length)).alias("marker"))
    # Lower-casing can lengthen a marker, never shorten it.
    keyed = marks.select("marker").distinct().select("marker", F.explode(window_keys(F.substring("marker", 1, length), length)).alias("key"))
    texts = docs.select("doc_id", F.lower("text").alias("t")).withColumn("same", F.xxhash64("t"))
    met = texts.select("same", F.explode(window_keys(F.col("t"), length)).alias("key")).join(keyed, "key").select("same", "marker").distinct()
    return texts.join(met, "same").where(F.contains("t", F.col("marker"))).join(marks, "marker").select("doc_id", "item_id")
