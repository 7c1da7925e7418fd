"""Pooling of window scores: factories of boolean columns over array<double>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pooler = Callable[[Column], Column]
#: Fixed values of the live rule.
MAX_THRESHOLD, RUN_LENGTH, RUN_THRESHOLD = 0.85, 2, 0.5


def max_score(threshold: float) -> Pooler:
    """The greatest score, 0 without any, is above the threshold."""
    return lambda s: F.coalesce(F.array_max(s), F.lit(0.0)) > threshold


def longest_run(s: Column, threshold: float) -> Column:
    """Most consecutive scores of at least the threshold."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(x >= threshold, a["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(s, start, step, lambda a: a["best"])


def contiguity(windows: int, threshold: float) -> Pooler:
    return lambda s: longest_run(s, threshold) >= windows


def run_members(s: Column, windows: int, threshold: float) -> Column:
    """Indices of the scores in every run that is long enough."""
    at = F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    run_at = lambda i, d: F.forall(F.slice(s, i + 1 - d, windows), lambda y: y >= threshold)
    inside = lambda z: F.exists(F.sequence(F.lit(0), F.lit(windows - 1)), lambda d: (z["i"] - d >= 0) & (z["i"] - d + windows <= F.size(s)) & run_at(F.greatest(z["i"], d), d))
    return F.transform(F.filter(at, inside), lambda z: z["i"])


def any_of(*poolers: Pooler) -> Pooler:
    def pool(s: Column) -> Column:
        out = F.lit(False)
        for p in poolers:
            out = out | p(s)
        return out

    return pool


def live() -> Pooler:
    return any_of(max_score(MAX_THRESHOLD), contiguity(RUN_LENGTH, RUN_THRESHOLD))


def k_anywhere(k: int, threshold: float) -> Pooler:
    return lambda s: F.size(F.filter(s, lambda x: x >= threshold)) >= k


def mean_at_least(threshold: float) -> Pooler:
    return lambda s: (F.size(s) > 0) & (F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(s), F.lit(1)) >= threshold)


def smoothed(windows: int, threshold: float) -> Pooler:
    """Some moving average reaches the threshold; a shorter list is averaged whole."""

    def pool(s: Column) -> Column:
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(a), F.lit(1))
        full = F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - windows + 1, F.lit(1))), lambda k: mean(F.slice(s, k, windows)) >= threshold)
        return F.when(F.size(s) == 0, False).when(F.size(s) < windows, mean(s) >= threshold).otherwise(full)

    return pool


def rule_of(s: Column) -> Column:
    """Which part of the live rule fires: both, max_score, contiguity or none."""
    top, run = max_score(MAX_THRESHOLD)(s), contiguity(RUN_LENGTH, RUN_THRESHOLD)(s)
    return F.when(top & run, "both").when(top, "max_score").when(run, "contiguity").otherwise("none")


def flagged_windows(s: Column) -> Column:
    """Indices of windows to report: those of the greatest score when it fires, and those in a run."""
    best = F.array_max(s)
    tops = F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z["x"] == best), lambda z: z["i"])
    none = F.array().cast("array<int>")
    return F.array_sort(F.array_union(F.when(max_score(MAX_THRESHOLD)(s), tops).otherwise(none), F.when(contiguity(RUN_LENGTH, RUN_THRESHOLD)(s), run_members(s, RUN_LENGTH, RUN_THRESHOLD)).otherwise(none)))


# The swept thresholds.
MAX_SWEEP = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
RUN_SWEEP = (0.4, 0.5, 0.6, 0.7)
MEAN_SWEEP = (0.3, 0.4, 0.5, 0.6, 0.7)
SMOOTH_WINDOWS = 2


def sweep() -> list[tuple[str, Pooler, int]]:
    """All 37 settings by name, with the windows that each needs at least to differ from the maximum."""
    single = [(f"max@{t}", max_score(t), 1) for t in MAX_SWEEP]
    runs = [(f"{name}({k},{t})", rule(k, t), k) for name, rule in (("contiguity", contiguity), ("k_anywhere", k_anywhere)) for k in (2, 3) for t in RUN_SWEEP]
    means = [(f"mean@{t}", mean_at_least(t), 2) for t in MEAN_SWEEP]
    smooth = [(f"smoothed({SMOOTH_WINDOWS})@{t}", smoothed(SMOOTH_WINDOWS, t), SMOOTH_WINDOWS) for t in MEAN_SWEEP]
    return [*single, ("live_contiguity", live(), 2), *runs, *means, *smooth]
