"""Scores of texts by a gated recurrent language model over words.

Words are lower-cased runs without white space, and every text ends with an end token.
All words of all training texts are counted.  The ``KNOWN`` most frequent ones, the end and a stand-in
for any other word are the model's own tokens; another word's probability is that of
the stand-in times its share of such words, add-one smoothed from the counts, with
one share left for words never seen.

The model is a gated recurrent unit in numpy.  Its output is factored: first the
class of the next token, then the token in its class, both from the state.  Output
biases start at the corpus counts.  Training is truncated back-propagation: windows
of ``WINDOW`` steps, the state carried from one to the next and cleared where a text
ends.  A bounded sample of ``START_DOCUMENTS`` texts gives all shards one starting
point; then each shard goes once over all its texts, and the shards' weights
are averaged by their tokens.  A text's shard, and its place there, follow from a hash of
the text and its id, and the number of shards from that of all tokens
(``SHARD_TOKENS``), so the weights don't depend on how rows are partitioned.  Scoring
runs whole texts in lanes and carries the state over windows, so a text's score is
the log-probability of all of it.

Counts of words that aren't among the most frequent ones, ``FREQUENT`` of them at most by a
histogram of counts, are joined: each text sends its other words with their
numbers, so no table of all words is sent to every task.

Defined results: null and empty texts have the end token only; without training
texts all counts are 0 and the model is uniform over its tokens; rows with a null
doc_id are trained on; repeated rows are scored each, and counted each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACED_WORDS, blocks, text_buffers, words
from .shared import Scratch, released

KNOWN, CLASSES = 1022, 32
FREQUENT = 1 << 18
SIZE = 16
WINDOW, TRAIN_LANES, LANES = 8, 512, 512
START_DOCUMENTS = 1200
RATE = 0.06
#: Tokens of a shard, about; and tasks that shards are dealt out to at most.
SHARD_TOKENS, TRAIN_TASKS = 1 << 20, 4096
#: Tokens that training and scoring hold at once.
BUFFER = 1 << 20
#: Entries of a task's word counts before they are sent.
COUNTS_HELD = 3_000_000
#: Logits that can't reach this are put into exp() as they are, without the largest of each row being taken off; float32 ends at 88.
EXPONENT = 80.0
#: Weights are summed as integers of this unit, so that the order of a sum changes nothing.
UNIT = float(1 << 24)
END_HASH = np.uint64(0x9D5C1E6A7B3F2481)


@dataclass
class Vocabulary:
    """hashes: ascending; token: each one's number in the model, the last two numbers being stand-in and end."""

    hashes: np.ndarray
    token: np.ndarray
    counts: np.ndarray  # of the model's tokens
    total: int
    distinct: int
    frequent: np.ndarray  # ascending hashes
    frequent_counts: np.ndarray

    @property
    def other(self) -> int:
        return len(self.counts) - 2

    @property
    def end(self) -> int:
        return len(self.counts) - 1

    def tokens(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.other, np.int32)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, self.token[k], self.other).astype(np.int32)


class Model:
    """Weights in one flat float32 array; ``w`` gives views by name."""

    def __init__(self, counts: np.ndarray, size: int = SIZE, classes: int = CLASSES):
        self.n, self.size = len(counts), size
        self.classes = min(classes, self.n)
        self.width = -(-self.n // self.classes)
        # Tokens by count go to classes in turns of ``width``, the frequent ones into the first.
        order = np.argsort(-counts, kind="stable")
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        # Numbers of 16 bits are sorted by counting.
        self.class_of, self.in_class = (place // self.width).astype(np.int16 if self.classes < 1 << 15 else np.int64), place % self.width
        h, c, k = size, self.classes, self.width
        self.shapes = {"emb": (self.n, h), "wx": (h, 3 * h), "b": (3 * h,), "wh": (h, 3 * h), "cw": (h, c), "cb": (c,), "tw": (c, h, k), "tb": (c, k)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), np.float32)
        self.w = self.views(self.flat)
        rng = np.random.default_rng(7)
        for name in ("emb", "wx", "wh"):
            self.w[name][:] = rng.normal(0, 0.4, self.shapes[name])
        self.w["cw"][:] = rng.normal(0, 0.05, self.shapes["cw"])
        mass = np.zeros((c, k))
        mass[self.class_of, self.in_class] = counts + 1.0
        self.there = mass > 0
        share = mass.sum(1)
        self.w["cb"][:] = np.log(share / share.sum())
        self.w["tb"][:] = np.where(self.there, np.log(np.maximum(mass, 1e-9) / share[:, None]), -30.0)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def step(self, table: tuple[np.ndarray, np.ndarray], x: np.ndarray, h: np.ndarray):
        """One step for lanes: new state and what going back needs."""
        gates, wh = table
        gx, gh = gates.take(x, 1), np.matmul(h, wh)
        zr = gx[:2]
        zr += gh[:2]
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r, gn = zr[0], zr[1], gh[2]
        n = r * gn
        n += gx[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, gn

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """What a token and what the state add to the gates, gate by gate; those of the first two come halved, as ``step`` needs them."""
        s = self.size
        table = (self.w["emb"] @ self.w["wx"] + self.w["b"]).astype(np.float32)
        gates, wh = (np.ascontiguousarray(t.reshape(-1, 3, s).transpose(1, 0, 2)) for t in (table, self.w["wh"]))
        for t in (gates, wh):
            t[:2] *= np.float32(0.5)
        return gates, wh

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, scale: float | np.ndarray = 1.0):
        """Natural log-probability of targets; with ``grads``, adds gradients of the loss, each target's
        times its ``scale``, and returns that of h too."""
        rows, s = np.arange(len(y)), self.size
        cls = self.class_of[y]
        # Rows by class, so that each class has a slice; a last column of ones takes the biases along.
        order = np.argsort(cls, kind="stable")
        cls, k = cls[order], self.in_class[y[order]]
        edge = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        slices = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
        hs = np.ones((len(y), s + 1), np.float32)
        hs[:, :s] = h[order]
        cw, tw = np.concatenate([self.w["cw"], self.w["cb"][None]]), np.concatenate([self.w["tw"], self.w["tb"][:, None]], 1)
        a, e = hs @ cw, np.empty((len(y), self.width), np.float32)
        for c, at in slices:
            np.matmul(hs[at], tw[c], out=e[at])
        most = max(1.0, float(np.abs(h).max(initial=0))) * max(float(np.abs(w).sum(-2).max()) for w in (cw, tw))
        out, totals = np.zeros(len(y), np.float32), []
        for v, own in ((a, cls), (e, k)):
            if not most < EXPONENT:
                v -= v.max(1, keepdims=True)
            out += v[rows, own]
            np.exp(v, out=v)
            totals.append(v @ np.ones(v.shape[1], np.float32))
            out -= np.log(totals[-1])
        given = np.empty_like(out)
        given[order] = out
        if grads is None:
            return given
        scale = np.broadcast_to(np.float32(scale), (len(y),))[order]
        for v, own, total in zip((a, e), (cls, k), totals, strict=True):
            v *= (scale / total)[:, None]
            v[rows, own] -= scale
        d = hs.T @ a
        grads["cw"] += d[:s]
        grads["cb"] += d[s]
        back = a @ self.w["cw"].T
        for c, at in slices:
            d = hs[at].T @ e[at]
            grads["tw"][c] += d[:s]
            grads["tb"][c] += d[s]
            back[at] += e[at] @ self.w["tw"][c].T
        dh = np.empty_like(back)
        dh[order] = back
        return given, dh

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, grads: dict, end: int, counts: np.ndarray | None = None):
        """Truncated back-propagation over x, y [steps, lanes]; adds gradients, gives the last state and the loss.
        Targets where ``counts`` is false are padding."""
        t, lanes = x.shape
        table, s = self.inputs(), self.size
        kept = []
        before, states = (np.empty((t, lanes, s), np.float32) for _ in range(2))
        for k in range(t):
            before[k] = h
            before[k][x[k] == end] = 0
            h, *rest = self.step(table, x[k], before[k])
            states[k] = h
            kept.append(rest)
        real = np.ones(t * lanes, np.float32) if counts is None else counts.reshape(-1).astype(np.float32)
        scale = real / max(1.0, float(real.sum()))
        logp, dh_out = self.log_probs(states.reshape(-1, s), y.reshape(-1), grads, scale)
        dh_out = dh_out.reshape(t, lanes, s)
        came, back = (np.empty((t, lanes, 3 * s), np.float32) for _ in range(2))
        carry = np.zeros((lanes, s), np.float32)
        wh = np.ascontiguousarray(self.w["wh"].T)
        for k in range(t - 1, -1, -1):
            z, r, n, gn = kept[k]
            d = dh_out[k] + carry
            dz = d * (1 - z)
            dn = dz * (1 - n * n)
            dz *= before[k] - n
            dz *= z
            came[k, :, :s], came[k, :, 2 * s :] = dz, dn
            came[k, :, s : 2 * s] = dn * gn * r * (1 - r)
            back[k], back[k, :, 2 * s :] = came[k], dn * r
            carry = back[k] @ wh
            carry += d * z
            carry[x[k] == end] = 0
        grads["wh"] += before.reshape(-1, s).T @ back.reshape(-1, 3 * s)
        flat = x.reshape(-1)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        dtable = np.zeros((self.n, 3 * s), np.float32)
        dtable[flat[order[first]]] = np.add.reduceat(came.reshape(-1, 3 * s)[order], first, axis=0)
        grads["wx"] += self.w["emb"].T @ dtable
        grads["b"] += dtable.sum(0)
        grads["emb"] += dtable @ self.w["wx"].T
        return h, -float(logp @ scale)

    def train(self, stream: np.ndarray, end: int, square: np.ndarray, lanes: int = TRAIN_LANES, rate: float = RATE) -> float:
        """One pass over a stream of tokens that begins behind an end; ``square`` is kept between calls.
        The last lane is filled up with ends that don't count."""
        lanes = max(1, min(lanes, len(stream) // WINDOW))
        steps = -(-len(stream) // lanes)
        pad = np.full(lanes * steps - len(stream), end, np.int32)
        x = np.concatenate([[end], stream[:-1], pad]).astype(np.int32)
        real = np.arange(lanes * steps) < len(stream)
        xs, ys, counts = (v.reshape(lanes, steps).T for v in (x, np.concatenate([stream, pad]), real))
        h, loss, n = np.zeros((lanes, self.size), np.float32), 0.0, 0
        grad = np.zeros_like(self.flat)
        views = self.views(grad)
        for k in range(0, steps, WINDOW):
            grad[:] = 0
            h, one = self.window(np.ascontiguousarray(xs[k : k + WINDOW]), np.ascontiguousarray(ys[k : k + WINDOW]), h, views, end, np.ascontiguousarray(counts[k : k + WINDOW]) if len(pad) else None)
            views["tb"][~self.there] = 0
            norm = float(np.sqrt((grad * grad).sum()))
            if norm > 1:
                grad /= norm
            square *= np.float32(0.99)
            square += np.float32(0.01) * grad * grad
            self.flat -= np.float32(rate) * grad / (np.sqrt(square) + np.float32(1e-3))
            loss, n = loss + one, n + 1
        return loss / max(n, 1)

    def score(self, texts: list[np.ndarray], end: int, lanes: int = LANES) -> np.ndarray:
        """Natural log-probability of each whole text (its tokens with the end)."""
        size = np.array([len(t) for t in texts])
        out = np.zeros(len(texts))
        if not len(texts):
            return out
        # Whole texts to lanes, longest first, each to the lane that is shortest so far.
        import heapq

        lanes = min(lanes, len(texts))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-size, kind="stable").tolist():
            n, k = heapq.heappop(heap)
            held[k].append(d)
            heapq.heappush(heap, (n + int(size[d]), k))
        held.sort(key=lambda ds: -int(size[ds].sum()))
        length = np.array([int(size[ds].sum()) for ds in held])
        steps = int(length.max())
        y, doc = np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), np.int32)
        for k, ds in enumerate(held):
            y[: length[k], k] = np.concatenate([texts[d] for d in ds])
            doc[: length[k], k] = np.repeat(ds, size[ds])
        x = np.concatenate([np.full((1, lanes), end, np.int32), y[:-1]])
        active = np.searchsorted(-length, -np.arange(steps), "left")
        h, table = np.zeros((lanes, self.size), np.float32), self.inputs()
        states, targets, owners, waiting = [], [], [], 0
        for k in range(steps):
            n = int(active[k])
            now, begun = h[:n], np.flatnonzero(x[k, :n] == end)
            if len(begun):
                now = now.copy()
                now[begun] = 0
            h = self.step(table, x[k, :n], now)[0]
            states.append(h)
            targets.append(y[k, :n])
            owners.append(doc[k, :n])
            waiting += n
            if waiting >= 1 << 13 or k == steps - 1:
                logp = self.log_probs(np.concatenate(states), np.concatenate(targets))
                out += np.bincount(np.concatenate(owners), weights=logp, minlength=len(texts))
                states, targets, owners, waiting = [], [], [], 0
        return out


@released
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the training texts with their numbers, summed in the task as far as memory allows."""
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held, ends = 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(c) for c in zip(*pending, strict=True))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n, first) if len(h) else n

    def sent(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        raw, offs = text_buffers(batch.column(0))
        ends += batch.num_rows
        for i, j in blocks(offs):
            h, n = np.unique(words(raw, offs[i : j + 1], SPACED_WORDS).hashes, return_counts=True)
            pending.append((h, n))
            held += len(h)
            if held > COUNTS_HELD:
                h, n = merged()
                pending, held = [(h, n)], len(h)
                if held > COUNTS_HELD // 2:
                    yield sent(h, n)
                    pending, held = [], 0
    if ends:
        pending.append((np.array([END_HASH]), np.array([ends])))
        yield sent(*merged())


def word_counts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n): the numbers of all words, by hash, and of ends; written to the shared folder."""
    return scratch.stage(texts.select("text").mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals and the most frequent words; a histogram of counts and FREQUENT rows at most come to the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(END_HASH.view(np.int64))
    ends = counts.where(F.col("word") == end).first()
    # Counts below 1024 are steps of their own, larger ones a 64th of a doubling.
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64)).cast("bigint")
    others = counts.where(F.col("word") != end).select("word", "n", step.alias("step"))
    held, least = 0, None
    for r in others.groupBy("step").count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["step"]
    top = others.where(F.col("step") >= (1 << 62 if least is None else least)).select("word", "n").toPandas()
    h, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.lexsort((h.view(np.int64), -n))
    h, n = h[order], n[order]
    known, order = min(KNOWN, len(h)), np.argsort(h)
    first = np.argsort(h[:known])
    own = np.concatenate([n[:known], [0, ends["n"] if ends else 0]])
    own[-2] = total - own.sum()
    return Vocabulary(h[:known][first], first.astype(np.int32), own, int(total), int(distinct), h[order], n[order])


def _streams(batches: Iterator[pa.RecordBatch], v: Vocabulary, column: int = 0) -> Iterator[np.ndarray]:
    """The tokens of all texts, each followed by the end, in pieces of about BUFFER."""
    held, size = [], 0
    for batch in batches:
        raw, offs = text_buffers(batch.column(column))
        for i, j in blocks(offs):
            w = words(raw, offs[i : j + 1], SPACED_WORDS)
            t = np.insert(v.tokens(w.hashes), w.first[1:], v.end)
            held.append(t)
            size += len(t)
            if size >= BUFFER:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


@released
def _train(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: one pass over each shard's texts from the common start; the sum over a task's shards of weights times tokens, in units."""
    v, start = held.value
    total = np.zeros(len(start) + 1, np.int64)
    model = Model(v.counts)

    def by_shard() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shard = batch.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield int(shard[a]), batch.slice(a, b - a)

    for _, group in groupby(by_shard(), key=lambda x: x[0]):
        model.flat[:] = start
        square, n = np.full_like(model.flat, 1e-4), 0
        for stream in _streams((b for _, b in group), v):
            model.train(stream, v.end, square)
            n += len(stream)
        total += np.rint(np.concatenate([model.flat.astype(float), [1.0]]) * (n * (UNIT / 1024))).astype(np.int64)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "value"])


def train_model(texts: DataFrame, v: Vocabulary) -> Model:
    """The common start from a bounded sample, then one averaged pass over all texts."""
    sc = texts.sparkSession.sparkContext
    model = Model(v.counts)
    keyed = texts.select("text", F.xxhash64("doc_id", "text").alias("h"))
    # Texts are as many as ends.  A hash leaves four times the sample over, so that no task has to send a sample of its own.
    share = min(1.0, 4 * START_DOCUMENTS / max(1, int(v.counts[v.end])))
    few = keyed.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else keyed
    sample = few.orderBy("h", "text").limit(START_DOCUMENTS).select("text").toArrow().to_batches()
    square = np.full_like(model.flat, 1e-4)
    for _ in range(2):
        for stream in _streams(iter(sample), v):
            model.train(stream, v.end, square)
    held = sc.broadcast((v, model.flat))
    shards = max(1, -(-v.total // SHARD_TOKENS))
    dealt = keyed.withColumn("shard", F.pmod("h", F.lit(shards))).repartition(min(shards, TRAIN_TASKS), "shard").sortWithinPartitions("shard", "h", "text")
    summed = dealt.select("text", "shard").mapInArrow(partial(_train, held=held), "at int, value bigint").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    if summed:
        value = np.zeros(len(model.flat) + 1)
        for r in summed:
            value[r["at"]] = float(r["value"])
        model.flat[:] = value[:-1] / value[-1]
    return model


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, lm double, word bigint, n bigint"


@released
def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """For each text its totals over frequent words and its own tokens; and its other words."""
    v, flat = held.value
    model = Model(v.counts)
    model.flat[:] = flat
    names = [c.split()[0] for c in SCORED.split(", ")]
    trained = v.total > 0
    log_frequent = np.log10(v.frequent_counts + 1.0)
    share = np.log10(max(v.counts[v.other], 0) + max(v.distinct - len(v.hashes) - (1 if trained else 0), 0) + 1.0)
    base = np.log10(v.total + v.distinct + 1.0)
    end_log = np.log10(v.counts[v.end] + 1.0)

    def scored(ids, outs, texts, parts):
        lm = model.score(texts, v.end) / np.log(10)
        n_tokens, known, log_all, log_other, n_other = (np.concatenate(c) for c in zip(*parts, strict=True))
        n = len(lm)
        none = pa.nulls(n, pa.int64())
        rows, docs = (pa.concat_arrays([x[k] for x in ids]) for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [rows, docs, pa.concat_arrays(outs), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(log_all - n_tokens * base), pa.array(lm + log_other - n_other * share), none, none], names=names
        )

    ids, outs, texts, parts, size = [], [], [], [], 0
    for batch in batches:
        raw, offs = text_buffers(batch.column(3))
        for i, j in blocks(offs):
            d = j - i
            w = words(raw, offs[i : j + 1], SPACED_WORDS)
            h = w.hashes
            doc = np.repeat(np.arange(d), np.diff(w.first))
            if len(v.frequent):
                k = np.minimum(np.searchsorted(v.frequent, h), len(v.frequent) - 1)
                common = v.frequent[k] == h
            else:
                k, common = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            t = v.tokens(h)
            logs = np.where(common, log_frequent[k] if len(log_frequent) else 0.0, 0.0)
            total = lambda x, doc=doc, d=d: np.bincount(doc, weights=x, minlength=d)
            n_words = np.diff(w.first)
            parts.append((n_words + 1, total(common).astype(np.int64) + int(trained), total(logs) + end_log, total(np.where(t == v.other, logs, 0.0)), total(t == v.other)))
            stream = np.insert(t, w.first[1:], v.end)
            texts += np.split(stream, np.cumsum(n_words + 1)[:-1])
            ids.append((batch.column(0).slice(i, d), batch.column(1).slice(i, d)))
            outs.append(batch.column(2).slice(i, d))
            size += len(stream)
            if len(rest := np.flatnonzero(~common)):
                # Other words of each text, each with its number.
                order = rest[np.lexsort((h[rest], doc[rest]))]
                hd, dd = h[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (hd[1:] != hd[:-1]) | (dd[1:] != dd[:-1])]))
                n = np.diff(np.concatenate([first, [len(hd)]]))
                rows = batch.column(0).slice(i, d).take(pa.array(dd[first]))
                m = len(first)
                yield pa.RecordBatch.from_arrays([rows, *(pa.nulls(m, x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(hd[first].view(np.int64)), pa.array(n, pa.int64())], names=names)
            if size >= BUFFER:
                yield scored(ids, outs, texts, parts)
                ids, outs, texts, parts, size = [], [], [], [], 0
    if ids:
        yield scored(ids, outs, texts, parts)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from all rows that aren't held out, score all rows.

    doc_id, held_out, n_tokens, n_known (tokens that training has), train_tokens,
    base_score (log10, add-one unigrams) and score (log10, the model).
    """
    sc, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = own.where("not held_out")
    counts = word_counts(training, scratch)
    v = vocabulary(counts)
    model = train_model(training, v)
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = scratch.stage(rows.mapInArrow(partial(_score, held=sc.broadcast((v, model.flat))), SCORED), "scored")
    others = scored.where("word is not null").select("row", "word", "n")
    # A word that training lacks has the count 0, whose logarithm with one added is 0.
    met = others.join(counts.withColumnRenamed("n", "c"), "word")
    more = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log"), F.sum("n").alias("known"))
    texts = scored.where("word is null").drop("word", "n")
    log = F.coalesce("log", F.lit(0.0))
    out = texts.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("lm") + log).alias("score")
    )
    out = scratch.stage(out, "texts")
    scratch.drop("word-counts", "scored")
    return out
