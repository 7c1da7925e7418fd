"""Benchmark decontamination on a positional inverted index.

``build_index`` stores the training texts as a document-partitioned positional
index: each row holds one block of whole documents, its term dictionary and, for
every term, the ascending positions of its tokens in the block.  Between two
documents one position stays empty, so no phrase can cross them.

``search`` takes test phrases against every block: a phrase's posting lists are
taken from its rarest term in the block on, each list is shifted by the term's
offset in the phrase, and the lists are intersected; what is left are exact
matches.  ``proximity`` finds the places where all terms of a phrase lie within a
span of so many words, in any order, again from the rarest term on.

The index never shuffles a text.  Test items are cut into windows on the executors, and
equal windows are one.  They are written out in blocks of about ``BLOCK_WINDOWS``; the
driver takes one block at a time, sends it out, has its hits written, and drops it,
so no memory grows with the benchmark.  Then each document's hits of all blocks are
joined to it; only documents with hits move.  The index is dropped at the end.

Defined results: null and empty texts have no words and are never contaminated;
items without words have no window; rows that share a doc_id stay rows of their
own; a null doc_id stays null; null item_ids are left out; items that share an
item_id are one item with several texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM_WORDS, blocks, hash_words, spread, text_buffers, words
from .shared import Scratch, released

WINDOW = 13
#: Text bytes of one index row, a longer document being a row of its own.
INDEX_BLOCK_BYTES = 8 << 20
#: Windows, or phrases, that are searched for in one pass, about.
BLOCK_WINDOWS = 1 << 16

INDEX_SCHEMA = "doc_ids array<bigint>, contents array<bigint>, starts array<bigint>, n_words array<bigint>, terms binary, offsets binary, positions binary"
HIT_SCHEMA = "block bigint, place bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"
NEAR_SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint"
WINDOW_SCHEMA = "size int, terms binary, item string"


@released
def _index_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = text_buffers(batch.column(1))
        ids = batch.column(0)
        for i, j in blocks(offs, most):
            hashes, starts, counts, at = [], [], [], 0
            places = []
            for a, b in blocks(offs[i : j + 1]):
                w = words(raw, offs[i + a : i + b + 1], ALNUM_WORDS)
                n = np.diff(w.first)
                hashes.append(w.hashes)
                begin = at + np.cumsum(n + 1) - (n + 1)
                starts.append(begin)
                counts.append(n)
                places.append(np.repeat(begin, n) + spread(n))
                at += int(n.sum()) + len(n)
            h, pos = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column(2).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.concatenate(starts)], pa.list_(pa.int64())),
                    pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
                    pa.array([h[new].tobytes()], pa.binary()),
                    pa.array([np.r_[new, len(h)].astype(np.int64).tobytes()], pa.binary()),
                    pa.array([pos[order].astype(np.uint32).tobytes()], pa.binary()),
                ],
                names=["doc_ids", "contents", "starts", "n_words", "terms", "offsets", "positions"],
            )


def content_key(text: Column) -> Column:
    """What tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))).alias("content")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = INDEX_BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Write the positional index of every whole text to the shared folder; one row a block of documents, ``block`` being its number."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), content_key(text))
    made = rows.mapInArrow(partial(_index_rows, most=block_bytes), INDEX_SCHEMA).withColumn("block", F.monotonically_increasing_id())
    return (scratch or Scratch(docs.sparkSession)).stage(made, "positional-index")


class Block:
    """One index row, with posting lists as numpy views."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)
        self.starts = np.asarray(row["starts"], np.int64)
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.doc_ids, self.contents = row["doc_ids"], row["contents"]

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's place in the dictionary (-1: none) and the length of its list."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64), np.zeros(terms.shape, np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        k = np.where(self.terms[k] == terms, k, -1)
        return k, np.where(k >= 0, self.offsets[k + 1] - self.offsets[k], 0)

    def postings(self, k: int) -> np.ndarray:
        return self.positions[self.offsets[k] : self.offsets[k + 1]]

    def phrase(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Positions where the phrase begins; ``places`` and ``lengths`` as ``lists`` gives them."""
        order = np.argsort(lengths, kind="stable")
        found = self.postings(places[order[0]]).astype(np.int64) - order[0]
        for o in order[1:]:
            if not len(found):
                break
            other = self.postings(places[o])
            want = found + o
            at = np.minimum(np.searchsorted(other, want), len(other) - 1)
            found = found[other[at] == want]
        return found

    def near(self, places: np.ndarray, lengths: np.ndarray, within: int) -> np.ndarray:
        """(begin, end) of the shortest spans, one from each place of the rarest
        term, that hold all terms and are at most ``within`` words."""
        order = np.argsort(lengths, kind="stable")
        rare = self.postings(places[order[0]]).astype(np.int64)
        if len(order) == 1:
            return np.stack([rare, rare + 1], 1)
        docs = np.searchsorted(self.starts, rare, "right") - 1
        low, high = self.starts[docs], self.starts[docs] + self.n_words[docs]
        found = []
        # The span begins at a token of some term, no more than within - 1 before the rare one.
        for back in range(within):
            begin = rare - back
            end = rare + 1
            ok = begin >= low
            for o in order[1:]:
                p = self.postings(places[o])
                at = np.searchsorted(p, begin)
                nxt = np.where(at < len(p), p[np.minimum(at, len(p) - 1)], np.iinfo(np.int64).max - 1).astype(np.int64)
                end = np.maximum(end, nxt + 1)
            ok &= (end - begin <= within) & (end <= high)
            found.append(np.stack([np.where(ok, begin, -1), np.where(ok, end, -1), rare], 1)[ok])
        every = np.concatenate(found)
        every = every[np.lexsort((every[:, 0], every[:, 1] - every[:, 0], every[:, 2]))]
        first = np.unique(every[:, 2], return_index=True)[1]
        return every[first, :2]


def _phrases_in(block: Block, phrases: list[tuple[np.ndarray, list[int]]], match) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the group, matches): phrases grouped by length, terms as arrays."""
    for g, (terms, _) in enumerate(phrases):
        places, lengths = block.lists(terms)
        for r in np.flatnonzero((places >= 0).all(1)):
            if len(found := match(block, places[r], lengths[r])):
                yield g, r, found


@released
def _cut(batches: Iterator[pa.RecordBatch], width: int | None) -> Iterator[pa.RecordBatch]:
    """The windows of each item, or with no width its distinct terms, as rows."""
    for batch in batches:
        size, terms, items = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = hash_words(text or "", ALNUM_WORDS)
            h = np.unique(h) if width is None else h
            k = min(width or len(h), len(h))
            own = {h[i : i + k].tobytes() for i in range(len(h) - k + 1)} if k else set()
            size += [k] * len(own)
            terms += own
            items += [str(item)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(terms, pa.binary()), pa.array(items, pa.string())], names=["size", "terms", "item"])


def blocks_of_windows(items: DataFrame, width: int | None, scratch: Scratch, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_WINDOWS) -> Iterator[list[tuple[np.ndarray, list[list[str]]]]]:
    """The distinct windows of the items in blocks: grouped by length, (terms [n, length], the items of each)."""
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    cut = own.mapInArrow(partial(_cut, width=width), WINDOW_SCHEMA).groupBy("size", "terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = scratch.stage(cut, "windows")
    n = -(-windows.count() // most)
    for k in range(n):
        groups: dict[int, tuple[list, list]] = {}
        part = windows if n == 1 else windows.where(F.pmod(F.xxhash64("terms"), F.lit(n)) == k)
        for r in part.orderBy("size", "terms").toLocalIterator():
            terms, names = groups.setdefault(r["size"], ([], []))
            terms.append(bytes(r["terms"]))
            names.append(r["items"])
        yield [(np.frombuffer(b"".join(terms), np.uint64).reshape(-1, size), names) for size, (terms, names) in groups.items()]
    scratch.forget("windows")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}


@released
def _search(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """For each document with hits: the runs of words inside them, and the items."""
    for row in _rows(batches):
        block, groups = Block(row), held.value
        runs: dict[int, list[np.ndarray]] = {}
        items: dict[int, set[str]] = {}
        for g, r, found in _phrases_in(block, groups, Block.phrase):
            of = np.searchsorted(block.starts, found, "right") - 1
            for d in np.unique(of).tolist():
                begin = found[of == d] - block.starts[d]
                runs.setdefault(d, []).append(np.stack([begin, begin + groups[g][0].shape[1]], 1))
                items.setdefault(d, set()).update(groups[g][1][r])
        docs = sorted(runs)
        spans = [[{"start": int(a), "end": int(b)} for a, b in joined_runs(np.concatenate(runs[d]))] for d in docs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["block"]] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(items[d]) for d in docs], pa.list_(pa.string()))],
            names=["block", "place", "spans", "item_ids"],
        )


def joined_runs(runs: np.ndarray) -> np.ndarray:
    """Runs [begin, end) with those that touch or overlap made one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    far = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.r_[True, runs[1:, 0] > far[:-1]])
    return np.stack([runs[first, 0], far[np.r_[first[1:] - 1, len(runs) - 1]]], 1)


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, share: int = 20, scratch: Scratch | None = None, most: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per indexed document: its words, the words inside any occurrence of
    a test window, the items found, the hit spans (word numbers), and
    ``contaminated``: some word is hit and ``share * n_hit >= n_words``."""
    spark = index.sparkSession
    scratch = scratch or Scratch(spark)
    hits = spark.createDataFrame([], HIT_SCHEMA)
    for k, groups in enumerate(blocks_of_windows(items, width, scratch, id_col, text_col, most)):
        held = spark.sparkContext.broadcast(groups)
        # Few index rows at a time: each is the text of many documents.
        found = scratch.stage(index.mapInArrow(partial(_search, held=held), HIT_SCHEMA), f"hits-{k}", 1)
        hits = hits.unionByName(found)
        held.destroy()
    # Runs of several blocks are joined in order of their begin.
    merged = hits.groupBy("block", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda out: F.element_at(out, -1)
    grown = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end"))))
    runs = F.aggregate("spans", none, lambda out, s: F.when((F.size(out) > 0) & (F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1)) >= s["start"]), grown(out, s)).otherwise(F.concat(out, F.array(s))))
    merged = scratch.stage(merged.select("block", "place", runs.alias("spans"), "item_ids"), "hits")
    docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "contents", "n_words")).alias("place", "d"))
    docs = docs.select("block", F.col("place").cast("bigint").alias("place"), F.col("d.doc_ids").alias("doc_id"), F.col("d.contents").alias("content"), F.col("d.n_words").alias("n_words"))
    joined = docs.join(merged, ["block", "place"], "left").withColumn("spans", F.coalesce("spans", none)).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    counted = joined.select("doc_id", "content", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "item_ids", "spans")
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


@released
def _near_rows(batches: Iterator[pa.RecordBatch], held, within: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        block = Block(row)
        out = []
        for g, r, found in _phrases_in(block, held.value, lambda b, p, n: b.near(p, n, within)):
            docs = np.searchsorted(block.starts, found[:, 0], "right") - 1
            for item in held.value[g][1][r]:
                out += [(block.doc_ids[d], int(item), int(a - block.starts[d]), int(b - block.starts[d])) for d, (a, b) in zip(docs.tolist(), found.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "start", "end"])


def proximity(index: DataFrame, phrases: DataFrame, within: int, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_WINDOWS) -> DataFrame:
    """Places where all distinct words of a phrase lie within ``within`` words, in
    any order: the shortest span from each place of the rarest word.  Phrases have integer
    ids and are taken in blocks, one pass each."""
    spark = index.sparkSession
    scratch, out = Scratch(spark), spark.createDataFrame([], NEAR_SCHEMA)
    for k, groups in enumerate(blocks_of_windows(phrases, None, scratch, id_col, text_col, most)):
        held = spark.sparkContext.broadcast(groups)
        out = out.unionByName(scratch.stage(index.mapInArrow(partial(_near_rows, held=held, within=within), NEAR_SCHEMA), f"near-{k}", 1))
        held.destroy()
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index the documents, search them for the windows of the items, and write the result to the shared folder."""
    scratch = Scratch(docs.sparkSession)
    out = scratch.stage(search(build_index(docs, scratch=scratch), items, scratch=scratch), "contamination")
    scratch.drop(*[name for name in scratch.paths if name != "contamination"])
    return out


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with all their columns; a null text, which has no words, stays."""
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("own")
    bad = contamination(docs, items).where("contaminated").select(own, "content").distinct()
    keyed = docs.withColumn("__own", own).withColumn("__content", content_key(F.col("text").cast("string")))
    kept = keyed.join(bad, (keyed["__own"] == bad["own"]) & (keyed["__content"] == bad["content"]), "left_anti")
    return kept.select(*docs.columns)
