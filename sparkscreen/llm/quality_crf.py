"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is one place of a chain with the labels bad and good.  Its
features tell its own make-up and that of the lines beside it; two lines next to
each other also weigh their pair of labels.  The field is trained by gradient ascent
on the likelihood of labelled documents, all of whose lines carry the document's label.
Forward and backward sums give each line's probability of being good, and a
document's score is the mean of those, weighted by the lines' lengths in bytes.

Only the text goes into a score.  Training takes a bounded sample of labelled rows:
``TRAIN_DOCUMENTS`` of them by a hash of their id, with all their lines.  Scoring takes
every line of every text; ``line_labels`` gives what it says about each line.

Defined results: null and empty texts are one empty line and get that line's
score; without labels, or with one kind only, every score is the share of good labels
(0.5 without any); rows with a null doc_id are scored and count as not held out;
repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import BLOCK_BYTES, SPACED_WORDS, blocks, text_buffers
from .bytetext import words as words_of
from .shared import released

TRAIN_DOCUMENTS = 3000
ROUNDS, RATE, RIDGE = 120, 0.1, 1e-4
#: A label is predicted from this score on.
LIMIT = 0.3
SCHEMA = "doc_id bigint, score double"

_KINDS = 9
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _BANG, _BAR, _HIGH = range(_KINDS)


def _kinds() -> np.ndarray:
    t = np.full(256, _MARK, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            t[b] = _HIGH
        elif c.islower():
            t[b] = _LOWER
        elif c.isupper():
            t[b] = _UPPER
        elif c.isdigit():
            t[b] = _DIGIT
        elif c.isspace():
            t[b] = _SPACE
        elif c in ".,;:'\"()-?":
            t[b] = _STOP
        elif c == "!":
            t[b] = _BANG
        elif c == "|":
            t[b] = _BAR
    return t


_KIND = _kinds()
OWN = 24
FEATURES = 3 * OWN + 3


@dataclass
class Lines:
    """Lines of a run of documents: own features, bytes, and the first line of each document."""

    own: np.ndarray
    size: np.ndarray
    first: np.ndarray


def lines_of(raw: np.ndarray, offs: np.ndarray) -> Lines:
    """Every document has one line more than it has line feeds."""
    lo, hi = int(offs[0]), int(offs[-1])
    b = raw[lo:hi]
    edge = (offs - lo).astype(np.int64)
    feeds = np.flatnonzero(b == 10)
    # A line begins at each document's edge and behind each line feed.
    of_feed = np.searchsorted(edge, feeds, "right") - 1
    n_lines = np.bincount(of_feed, minlength=len(edge) - 1) + 1
    first = np.concatenate([[0], np.cumsum(n_lines)])
    doc = np.repeat(np.arange(len(edge) - 1), n_lines)
    # Edges of documents and lines behind a feed at a document's end share a place: order by document.
    start = np.empty(len(doc), np.int64)
    start[first[:-1]] = edge[:-1]
    rest = np.ones(len(doc), bool)
    rest[first[:-1]] = False
    start[rest] = feeds + 1
    end = np.empty(len(doc), np.int64)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = edge[1:]
    size = end - start
    kind = _KIND[b]
    counts = np.empty((len(doc), _KINDS))
    for k in range(_KINDS):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts[:, k] = run[end] - run[start]
    w = words_of(raw, offs, SPACED_WORDS)
    line = np.searchsorted(start, w.start, "right") - 1
    words = np.bincount(line, minlength=len(doc))
    echo = np.bincount(line[1:], weights=(line[1:] == line[:-1]) & (w.hashes[1:] == w.hashes[:-1]), minlength=len(doc)) if len(line) else np.zeros(len(doc))
    same = np.zeros(len(b), bool)
    same[1:] = b[1:] == b[:-1]
    run = np.concatenate([[0], np.cumsum(same, dtype=np.int64)])
    twice = np.maximum(run[end] - run[np.minimum(start + 1, end)], 0)
    with np.errstate(over="ignore"):
        mix = (b.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix * (mix >> np.uint64(7)), dtype=np.uint64)])
        name = (total[end] - total[start]) ^ (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (doc.astype(np.uint64) << np.uint64(40))
    order = np.argsort(name, kind="stable")
    again = np.zeros(len(doc), bool)
    again[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again &= size > 0
    n = np.maximum(size, 1)[:, None]
    share = counts / n
    letters = np.maximum(counts[:, _LOWER] + counts[:, _UPPER], 1)
    upper = counts[:, _UPPER] / letters
    mean_word = (size - counts[:, _SPACE]) / np.maximum(words, 1)
    last = np.where(size > 0, b[np.maximum(end - 1, 0)] if len(b) else 0, 0)
    own = np.column_stack([
        np.minimum(share * 4, 2.0),
        np.log1p(size) / 6, np.log1p(words) / 4, upper > 0.4, upper > 0.8, np.minimum(mean_word / 8, 3), share[:, _MARK] + share[:, _BANG] + share[:, _BAR] > 0.04,
        share[:, _DIGIT] > 0.3, again, size == 0, words == 1, last == ord("."), np.minimum(twice / n[:, 0] * 8, 3), np.minimum(counts[:, _STOP] / np.maximum(words, 1) * 2, 3),
        echo / np.maximum(words, 1) * 2, echo > 0.3 * words,
    ]).astype(np.float32)
    return Lines(own, size, first)


def with_neighbours(x: Lines) -> np.ndarray:
    """Own features, those of the lines before and behind, and whether there are such."""
    n = len(x.own)
    before, behind = np.zeros_like(x.own), np.zeros_like(x.own)
    before[1:], behind[:-1] = x.own[:-1], x.own[1:]
    begins, ends = np.zeros(n, np.float32), np.zeros(n, np.float32)
    begins[x.first[:-1]] = 1
    ends[x.first[1:] - 1] = 1
    before[begins > 0] = 0
    behind[ends > 0] = 0
    return np.column_stack([x.own, before, behind, begins, ends, np.ones(n, np.float32)])


@dataclass
class Field:
    """weights: score of good against bad for a line's features; pairs[a, b]: score of label b behind a."""

    weights: np.ndarray
    pairs: np.ndarray
    constant: float | None = None


def _padded(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[documents, most lines] of per-line values, and which places are lines."""
    n = np.diff(first)
    there = np.arange(int(n.max()))[None, :] < n[:, None]
    out = np.zeros(there.shape)
    out[there] = values
    return out, there


def forward_backward(unary: np.ndarray, there: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unary: score of good against bad [documents, lines].  Probability of good at
    each line, expected pairs [2, 2], and log normaliser of each document."""
    d, t = unary.shape
    e = np.exp(pairs)
    top = np.maximum(unary, 0)
    u = np.stack([np.exp(-top), np.exp(unary - top)], -1)
    a, scale = np.empty((t, d, 2)), np.ones((t, d))
    for k in range(t):
        x = u[:, k] if not k else (a[k - 1] @ e) * u[:, k]
        on = there[:, k, None]
        s = x.sum(1, keepdims=True)
        a[k] = np.where(on, x / s, a[k - 1] if k else x / s)
        scale[k] = np.where(there[:, k], s[:, 0], 1)
    b = np.ones((t, d, 2))
    expected = np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        x = u[:, k + 1] * b[k + 1]
        on = there[:, k + 1, None]
        b[k] = np.where(on, (x @ e.T) / scale[k + 1][:, None], 1)
        weight = np.where(on, x / scale[k + 1][:, None], 0)
        expected += e * (a[k].T @ weight)
    good = np.moveaxis(a * b, 0, 1)
    good = good[..., 1] / np.maximum(good.sum(-1), 1e-300)
    return good, expected, (np.log(scale).sum(0) + np.where(there, top, 0).sum(1))


def train_field(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Full-batch ascent (Adam steps) on the mean log-likelihood per document."""
    if not len(label) or label.min() == label.max():
        return Field(np.zeros(x.shape[1]), np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
    order = np.argsort(np.diff(first), kind="stable")
    n = np.diff(first)
    groups = []
    for part in np.array_split(order, max(1, len(order) // 256)):
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in part])
        edge = np.concatenate([[0], np.cumsum(n[part])])
        y = label[part].astype(float)
        there = np.arange(int(n[part].max()))[None, :] < n[part][:, None]
        inner = (n[part] - 1).astype(float)
        groups.append((x[rows].astype(float), edge, np.repeat(y, n[part]), there, np.array([[(inner * (1 - y)).sum(), 0], [0, (inner * y).sum()]])))
    w, p = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(p)], [np.zeros_like(w), np.zeros_like(p)]
    for k in range(1, rounds + 1):
        gw, gp = -RIDGE * len(label) * w, -RIDGE * len(label) * p * 10
        for rows, edge, y, there, seen in groups:
            unary, _ = _padded(edge, rows @ w)
            good, expected, _ = forward_backward(unary, there, p)
            gw = gw + rows.T @ (y - good[there])
            gp = gp + seen - expected
        for i, g in enumerate((gw / len(label), gp / len(label))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            step = RATE * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
            if i:
                p = p + step
            else:
                w = w + step
    return Field(w, p)


def line_marginals(x: Lines, field: Field) -> np.ndarray:
    """The probability of good of each line of a run."""
    n = np.diff(x.first)
    if field.constant is not None:
        return np.full(len(x.own), field.constant)
    value = with_neighbours(x) @ field.weights
    out = np.empty(len(x.own))
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        # Documents of like numbers of lines, so that little is padding.
        stop = int(np.searchsorted(n[order], max(8, 2 * n[order[at]]), "right"))
        stop = max(at + 1, min(stop, at + max(1, 400_000 // int(n[order[min(stop, len(order)) - 1]]))))
        part = order[at:stop]
        rows = np.concatenate([np.arange(x.first[d], x.first[d + 1]) for d in part])
        edge = np.concatenate([[0], np.cumsum(n[part])])
        unary, there = _padded(edge, value[rows])
        out[rows] = forward_backward(unary, there, field.pairs)[0][there]
        at = stop
    return out


def score_lines(x: Lines, field: Field) -> np.ndarray:
    """Score of each document of a run: the mean of its lines' probabilities by their lengths."""
    weight = np.maximum(x.size, 1).astype(float)
    sums = lambda v: np.add.reduceat(v, x.first[:-1]) if len(x.first) > 1 else v
    return np.clip(sums(line_marginals(x, field) * weight) / sums(weight), 0.0, 1.0)


@released
def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = text_buffers(batch.column(1))
        feats = []
        for i, j in blocks(offs):
            x = lines_of(raw, offs[i : j + 1])
            full = with_neighbours(x)
            feats += [full[a:b].astype(np.float32).tobytes() for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.binary())], names=["doc_id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", use: Column | None = None, documents: int = TRAIN_DOCUMENTS) -> Field:
    """Train on at most ``documents`` labelled rows; ``use`` says which rows of ``labels`` may be learned from.  Labels are 0 and 1; others are left out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    if use is not None:
        own = own.where(use)
    own = own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(documents)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")
    # ``documents`` rows at most, repeated ids or not.
    got = rows.mapInArrow(_training_rows, "doc_id bigint, label int, features binary").orderBy("doc_id", "label", F.xxhash64("features")).limit(documents).collect()
    x = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in got]
    first = np.cumsum([0] + [len(f) for f in x])
    return train_field(np.concatenate(x) if x else np.zeros((0, FEATURES), np.float32), first, np.array([r["label"] for r in got]))


@released
def _scores(batches: Iterator[pa.RecordBatch], field) -> Iterator[pa.RecordBatch]:
    own = field.value
    for batch in batches:
        raw, offs = text_buffers(batch.column(1))
        out = [score_lines(lines_of(raw, offs[i : j + 1]), own) for i, j in blocks(offs, BLOCK_BYTES)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])


def held_out(fold: int, of: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == fold, F.lit(False))


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) for every row; a narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(partial(_scores, field=held), SCHEMA)


@released
def _lines(batches: Iterator[pa.RecordBatch], field) -> Iterator[pa.RecordBatch]:
    own = field.value
    kind = pa.list_(pa.struct([("good", pa.bool_()), ("probability", pa.float64()), ("bytes", pa.int64())]))
    for batch in batches:
        raw, offs = text_buffers(batch.column(1))
        for i, j in blocks(offs, BLOCK_BYTES):
            x = lines_of(raw, offs[i : j + 1])
            p = line_marginals(x, own)
            rows = [[{"good": bool(p[k] >= 0.5), "probability": float(p[k]), "bytes": int(x.size[k])} for k in range(a, b)] for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, kind)], names=["doc_id", "lines"])


def line_labels(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, lines) for every row: of each line its label, the probability of good, and its bytes."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(partial(_lines, field=held), "doc_id bigint, lines array<struct<good:boolean,probability:double,bytes:bigint>>")


@released
def _kept(batches: Iterator[pa.RecordBatch], field, at: int, limit: float) -> Iterator[pa.RecordBatch]:
    own = field.value
    for batch in batches:
        raw, offs = text_buffers(batch.column(at))
        out = [score_lines(lines_of(raw, offs[i : j + 1]), own) for i, j in blocks(offs, BLOCK_BYTES)]
        if out:
            yield batch.filter(pa.array(np.concatenate(out) >= limit))


def keep_good(docs: DataFrame, field: Field, limit: float = LIMIT) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    return docs.mapInArrow(partial(_kept, field=held, at=docs.columns.index("text"), limit=limit), docs.schema)
