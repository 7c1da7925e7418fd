"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``LISTS`` partial scores, one for each slice of the
dimensions; a shard of vectors holds one list of partial scores a slice.  For a block
of queries:

1. Each shard takes the k best of each of its lists.  What it has seen of those
   vectors, and the least entry of a list for what it hasn't, bounds their totals from
   below.  The k-th best bound over all shards is a safe cutoff.
2. The cutoffs go back to the shards.  Over its least entry, a vector of at least the
   cutoff must reach a uniform share of what is left of it in some list; entries
   that reach it are collected.
3. Vectors whose upper bound, from collected entries and the share for lists without
   one, still reaches the cutoff are resolved exactly, and the best are merged.

Components are turned into floor(scale * x) first, so all scores are integers.  Where
a product of two vectors may not fit into a double it is worked out in Python's
integers; a score that 64 bits can't hold is an error, never a wrong number.  The
query set is a stated one: it is written out in blocks of ``QUERY_BLOCK`` vectors, and each
block is sent out, answered in two passes over the shards, written and dropped, so
neither memory nor the plan grows with it.

Defined results: null vectors and vectors with a null or non-finite component, and
null ids, take no part; vectors of another length than the query aren't its
candidates; a query's candidates are all rows but its own, so other rows of its id
are among them, and each query row has a list of its own; fewer candidates than
k give fewer rows; ties go to the smaller id, equal rows of one id come one after the other; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_staged, released, staging_path

K, SCALE, LISTS = 5, 256.0, 4
#: Queries of one pass, and vectors that a task scores at a time: their product times LISTS is what an array holds.
QUERY_BLOCK, SHARD_ROWS = 4096, 128
#: Doubles hold all integers up to this.
EXACT = float(1 << 53)

BOUNDS = "query int, bound double"
ENTRIES = "query int, query_id bigint, vec_id bigint, score bigint, own boolean"


def vectors_of(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors as doubles) of usable rows, by vector length."""
    ids, lists = batch.column(0), batch.column(1)
    flat = lists.flatten().cast(pa.float64())
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64()))
    values = np.where(np.asarray(flat.is_null()), np.nan, np.asarray(pc.fill_null(flat, 0.0)))
    at = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()) & (size > 0) & (bad[at[1:]] == bad[at[:-1]])
    own = np.asarray(pc.fill_null(ids, 0), np.int64)
    for n in np.unique(size[fine]):
        rows = np.flatnonzero(fine & (size == n))
        yield own[rows], np.floor(scale * values[at[rows][:, None] + np.arange(n)])


def _slices(n: int) -> list[slice]:
    edge = np.linspace(0, n, min(LISTS, n) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _shards(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, SHARD_ROWS):
            yield from vectors_of(batch.slice(k, SHARD_ROWS), scale)


def _fits(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of x whose products with every query are exact in doubles."""
    return np.abs(x).max(1) * np.abs(q).max(initial=1.0) * x.shape[1] < EXACT


def _partials(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[lists, queries, vectors]; doubles hold these integers exactly."""
    return np.stack([q[:, s] @ x[:, s].T for s in _slices(x.shape[1])])


def _own(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which rows may be the query's own: those with its id and its vector."""
    out = q_ids[:, None] == ids[None, :]
    for i, j in zip(*np.nonzero(out), strict=True):
        out[i, j] = bool((q[i] == x[j]).all())
    return out


@released
def _gather(batches: Iterator[pa.RecordBatch], block, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Phase 1 in a task: for each query the k best lower bounds of the task's vectors."""
    held: dict[int, list[np.ndarray]] = {}
    for ids, x in _shards(batches, scale):
        for n, (places, q_ids, q) in block.value.items():
            if n != x.shape[1]:
                continue
            # A bound is safe if it leaves vectors out, as it does with the very large ones.
            fits = _fits(x, q)
            ids_n, x_n = ids[fits], x[fits]
            if not len(x_n):
                continue
            part = _partials(x_n, q)
            own = _own(ids_n, x_n, q_ids, q)
            part[:, own] = -np.inf
            least = np.where(np.isinf(part), np.inf, part).min(2)
            top = min(k, x_n.shape[0])
            seen = np.zeros(part.shape[1:], bool)
            total = np.zeros(part.shape[1:])
            for m in range(len(part)):
                best = np.argpartition(-part[m], top - 1, axis=1)[:, :top]
                mine = np.zeros_like(seen)
                np.put_along_axis(mine, best, True, axis=1)
                total += np.where(mine, part[m], least[m][:, None])
                seen |= mine
            bound = np.where(seen & ~own, total, -np.inf)
            rows = -np.partition(-bound, min(k, bound.shape[1]) - 1, axis=1)[:, :k] if bound.shape[1] > k else bound
            before = held.get(n)
            both = rows if before is None else np.concatenate([before, rows], axis=1)
            held[n] = -np.sort(-both, axis=1)[:, :k]
    for n, both in held.items():
        keep = np.isfinite(both)
        query = np.broadcast_to(block.value[n][0][:, None], both.shape)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(both[keep])], names=["query", "bound"])


def _entries(x: np.ndarray, q: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of pairs that reach the cutoffs, by the lists of partial scores."""
    part = _partials(x, q)
    least = part.min(2)
    share = (cut - least.sum(0)) / len(part)
    sent = part - least[:, :, None] >= share[None, :, None]
    upper = np.where(sent, part, np.minimum(part.max(2), least + share[None, :])[:, :, None]).sum(0)
    rows, cols = np.nonzero(sent.any(0) & (upper >= cut[:, None]))
    exact = np.einsum("ij,ij->i", q[rows], x[cols]) if len(rows) else np.zeros(0)
    good = exact >= cut[rows]
    return rows[good], cols[good], exact[good].astype(np.int64)


def _large(x: np.ndarray, q: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for vectors whose products doubles can't hold, in Python's integers."""
    whole = lambda a: [[int(v) for v in row] for row in a.tolist()]
    out = []
    for j, v in enumerate(whole(x)):
        for i, u in enumerate(whole(q)):
            score = sum(a * b for a, b in zip(u, v, strict=True))
            if not -(1 << 63) <= score < 1 << 63:
                raise ValueError("a score is beyond 64 bits")
            if score >= cut[i]:
                out.append((i, j, score))
    return tuple(np.array([o[k] for o in out], np.int64) for k in range(3))


def _best(p: np.ndarray, *rest: np.ndarray, k: int) -> list[np.ndarray]:
    """Entries (query, own, vec_id, score), k a query at most beside those that may be its own row."""
    own, vec, score = rest
    order = np.lexsort((vec, -score, own, p))
    p, own, vec, score = (a[order] for a in (p, own, vec, score))
    begin = np.r_[True, (p[1:] != p[:-1]) | (own[1:] != own[:-1])] if len(p) else np.zeros(0, bool)
    rank = np.arange(len(p)) - np.maximum.accumulate(np.where(begin, np.arange(len(p)), 0))
    keep = rank <= k
    return [a[keep] for a in (p, own, vec, score)]


@released
def _resolve(batches: Iterator[pa.RecordBatch], block, cutoffs, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3 in a task: its best entries that reach the cutoff, k a query and one more at most."""
    best: dict[int, list[np.ndarray]] = {}
    for ids, x in _shards(batches, scale):
        for n, (places, q_ids, q) in block.value.items():
            if n != x.shape[1]:
                continue
            cut, fits = cutoffs.value[places], _fits(x, q)
            for work, at in ((_entries, np.flatnonzero(fits)), (_large, np.flatnonzero(~fits))):
                if not len(at):
                    continue
                i, j, score = work(x[at], q, cut)
                j = at[j]
                own = (q_ids[i] == ids[j]) & (q[i] == x[j]).all(1)
                new = [i, own, ids[j], score]
                best[n] = _best(*(np.concatenate(c) for c in zip(best[n], new, strict=True)), k=k) if n in best else _best(*new, k=k)
    for n, (i, own, vec, score) in best.items():
        places, q_ids, _ = block.value[n]
        yield pa.RecordBatch.from_arrays([pa.array(places[i], pa.int32()), pa.array(q_ids[i]), pa.array(vec), pa.array(score), pa.array(own.astype(bool))], names=["query", "query_id", "vec_id", "score", "own"])


def _block(part: DataFrame, scale: float) -> tuple[dict[int, tuple], list[tuple[int, int]]]:
    """A block of queries: by vector length (places, ids, vectors); and places of query rows that are there more than once, with their numbers."""
    found: dict[int, list] = {}
    for batch in part.toArrow().to_batches():
        for ids, x in vectors_of(batch, scale):
            found.setdefault(x.shape[1], []).append((ids, x))
    block, again, at = {}, [], 0
    for size, parts in found.items():
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        # Equal rows ask the same: one asks for all.
        keys = np.concatenate([ids[:, None].view(np.uint8).reshape(len(ids), -1), np.ascontiguousarray(x).view(np.uint8).reshape(len(ids), -1)], 1)
        _, first, number = np.unique(keys, axis=0, return_index=True, return_counts=True)
        block[size] = (np.arange(at, at + len(first)), ids[first], x[first])
        again += [(at + int(k), int(number[k])) for k in np.flatnonzero(number > 1)]
        at += len(first)
    return block, again


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other rows.

    ``is_query`` is a condition on ``vectors``.  The result is written in the shared folder, block by block.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    both = vectors.withColumn("__q", F.expr(is_query) if isinstance(is_query, str) else is_query)
    rows = both.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    asked = both.where("__q").select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    n = -(-asked.count() // query_block)
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    queries_at, out = staging_path(spark, "queries"), staging_path(spark, "top-k")
    asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n))).write.partitionBy("block").parquet(queries_at)
    queries = spark.read.parquet(queries_at)
    spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint").write.parquet(out)
    for b in range(n):
        block, again = _block(queries.where(F.col("block") == b).select("id", "v"), scale)
        if not block:
            continue
        held = sc.broadcast(block)
        gathered = rows.mapInArrow(partial(_gather, block=held, k=k, scale=scale), BOUNDS)
        order = Window.partitionBy("query").orderBy(F.desc("bound"))
        # k values a query and task arrive here; the k-th best is the cutoff, and without one every candidate counts.
        kth = gathered.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", "bound").collect()
        cut = np.full(sum(len(places) for places, _, _ in block.values()), -np.inf)
        for r in kth:
            cut[r["query"]] = r["bound"]
        cutoffs = sc.broadcast(cut)
        found = rows.mapInArrow(partial(_resolve, block=held, cutoffs=cutoffs, k=k, scale=scale), ENTRIES)
        # Of the rows that equal the query, one is the query itself.
        kin = Window.partitionBy("query", "own").orderBy("vec_id")
        others = found.withColumn("kin", F.row_number().over(kin)).where("not own or kin > 1")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = others.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if again:
            ranked = ranked.join(F.broadcast(spark.createDataFrame(again, "query int, number int")), "query", "left").withColumn("number", F.explode(F.sequence(F.lit(1), F.coalesce("number", F.lit(1)))))
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        held.destroy()
        cutoffs.destroy()
    drop_staged(spark, queries_at)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(out)
