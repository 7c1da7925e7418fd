"""Token ids in a content-addressed store.

Every text is encoded as the ``tokenizers`` library does; the ids and an end id are cut into chunks where a rolling
hash of the last ids meets a mask, so equal passages of different documents give
equal chunks.  A chunk is named by the hash of its content and stored once.  The
store has three tables, Parquet files under one path:

* ``chunks``: name, n_ids and the ids as little-endian unsigned 16-bit integers (32-bit for larger vocabularies);
* ``recipes``: in ascending doc_id order, each document's chunk names in order, the Merkle root
  over them, and ``start``, the number of ids of all documents before it;
* ``manifest``: a Merkle tree over the documents' roots in their order.  A node of level 1 has the roots of ``FAN``
  documents, one of level k + 1 those of ``FAN`` nodes of level k, each with its numbers of documents and ids, up to the one root of the store.

Reading back takes every chunk from its file, checks it against its name, and
checks the recipes' roots and every node of the manifest.  The CRC-32 of a document is combined from those of
its chunks, so a chunk that a third of all documents share is read and checked once
and no payload is sent around; ``reconstruct`` joins the payloads themselves.

Defined results: null and empty texts hold the end id only; equal doc_ids are rows
of their own, ordered by their roots; null doc_ids come first; other columns are
not read; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, drop_staged, released, small_parts, staging_path

#: Ids in a chunk: at least, at most; a cut comes once in CHUNK_MASK + 1 places.
CHUNK_LEAST, CHUNK_MOST, CHUNK_MASK = 128, 4096, 511
ROLLED = 8
NAME_BYTES = 16
#: Children of a node of the manifest.
FAN = 1024
#: Texts of each task, and characters of each, that both engines encode for comparison.
COMPARED, COMPARED_CHARACTERS = 8, 2000
#: Chunk names that a task remembers having sent; all is right without them, they only save bytes.
NAMES_KEPT = 200_000

CODED = "doc_id bigint, n_tokens bigint, names binary, root binary, name binary, n_ids bigint, payload binary"
DIGESTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean"


#: Splits a text into words before byte-level BPE; public, and fixed by the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the two engines must agree on when an encoder is made.
PROBES = ("", "Hello  world\n\n it's 12\u00b2 na\u00efve\t\u6f22\u5b57 \U0001f600 end ", "\x1c\x85\u00a0 \u3000 don't'll  x", "a<|endoftext|>b <|endoftext|>")


class Encoder:
    """The ids that the ``tokenizers`` library gives, as bytes.

    The library reads the file and says what the ids are.  Where it is plain byte-level
    BPE whose merges come in the order of their ids, the library's vocabulary is handed to
    ``tiktoken``, which gives the same ids in a fifth of the time; texts with
    special tokens agree too.  Any other file is encoded by the library itself.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.kind = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            self.fast = self._tables(json.load(f))
        if self.fast and any(self.fast(t) != self.exact([t])[0] for t in PROBES):
            raise ValueError("the engines disagree about this tokenizer file")

    def _tables(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("end_of_word_suffix")
        if not plain:
            return None
        import tiktoken

        from .bpe_automaton import byte_letters

        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            return None
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        engine, kind = tiktoken.Encoding("store", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special), self.kind
        return lambda text: engine.encode_to_numpy(text, allowed_special="all").astype(kind).tobytes()

    def exact(self, texts: list[str]) -> list[bytes]:
        """By the library itself."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def compare(self, texts: list[str]) -> None:
        """Raises if the engines disagree about one of these texts."""
        if self.fast and [self.fast(t) for t in texts] != self.exact(texts):
            raise ValueError("the engines disagree about a text")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return list(map(self.fast, texts)) if self.fast else self.exact(texts)


def encoder(path: str) -> Encoder:
    """One for each task: a worker that waits for its next task holds none."""
    return Encoder(path)


def cuts(ids: np.ndarray) -> np.ndarray:
    """Places 0 < c < len(ids) after which a rolling hash of the last ids meets the mask."""
    if len(ids) < ROLLED:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        h = np.zeros(len(ids) - ROLLED + 1, np.uint32)
        for k in range(ROLLED):
            h = h * np.uint32(0x85EBCA6B) + x[k : k + len(h)]
        h ^= h >> np.uint32(16)
    return np.flatnonzero((h & np.uint32(CHUNK_MASK)) == 0) + ROLLED


def chunk_ends(found: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of ids[begin:end]; ``found``: ascending places from ``cuts``."""
    out, at = [], begin
    for c in found.tolist():
        while c - at > CHUNK_MOST:
            at += CHUNK_MOST
            out.append(at)
        if c - at >= CHUNK_LEAST and c < end:
            out.append(c)
            at = c
    while end - at > CHUNK_MOST:
        at += CHUNK_MOST
        out.append(at)
    out.append(end)
    return out


def name_of(payload: bytes) -> bytes:
    return blake2b(payload, digest_size=NAME_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; leaves and inner nodes are told apart."""
    level = [blake2b(b"\0" + x, digest_size=NAME_BYTES).digest() for x in leaves] or [bytes(NAME_BYTES)]
    while len(level) > 1:
        up = [blake2b(b"\1" + level[i] + level[i + 1], digest_size=NAME_BYTES).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) & ~1 :]
    return level[0]


@released
def _code(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    last = np.array([end_id], own.kind).tobytes()
    size = own.kind.itemsize
    sent: set[bytes] = set()
    compared = False
    for part in small_parts(batches, 1):
        if part.num_rows:
            texts = [t or "" for t in part.column(1).to_pylist()]
            if not compared:
                own.compare([t[:COMPARED_CHARACTERS] for t in texts[:: max(1, len(texts) // COMPARED)]])
                compared = True
            coded = [x + last for x in own.encode(texts)]
            joined = b"".join(coded)
            edge = np.cumsum([0] + [len(x) // size for x in coded])
            found = cuts(np.frombuffer(joined, own.kind))
            names, roots, fresh = [], [], []
            for d in range(len(coded)):
                a, b = int(edge[d]), int(edge[d + 1])
                lo, hi = np.searchsorted(found, [a + CHUNK_LEAST, b])
                own_names, at = [], a
                for c in chunk_ends(found[lo:hi], a, b):
                    payload = joined[at * size : c * size]
                    own_names.append(name := name_of(payload))
                    if name not in sent:
                        if len(sent) >= NAMES_KEPT:
                            sent.clear()
                        sent.add(name)
                        fresh.append((name, c - at, payload))
                    at = c
                names.append(b"".join(own_names))
                roots.append(merkle(own_names))
            none = pa.nulls(len(coded), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edge)), *(pa.array(x, pa.binary()) for x in (names, roots)), none, pa.nulls(len(coded), pa.int64()), none], names=[x.split()[0] for x in CODED.split(", ")])
            if fresh:
                n = len(fresh)
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), none, none, pa.array([x[0] for x in fresh], pa.binary()), pa.array([x[1] for x in fresh], pa.int64()), pa.array([x[2] for x in fresh], pa.binary())],
                    names=[x.split()[0] for x in CODED.split(", ")],
                )


def _nodes(children: DataFrame) -> DataFrame:
    """One level up from (at, root, documents, n_tokens); a node's hash is over its children's in order."""
    rows = F.array_sort(F.collect_list(F.struct("at", F.hex("root").alias("root"))))
    joined = F.array_join(F.transform(rows, lambda x: x["root"]), ",")
    return children.groupBy(F.floor(F.col("at") / FAN).cast("bigint").alias("node")).agg(F.unhex(F.sha2(joined, 256)).alias("root"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")).withColumnRenamed("node", "at")


def manifest_of(recipes: DataFrame, scratch: Scratch) -> DataFrame:
    """All levels of the tree over the recipes: (level, at, root, documents, n_tokens)."""
    below, level, out = recipes.select(F.col("rank").alias("at"), "root", F.lit(1).cast("bigint").alias("documents"), "n_tokens"), 0, None
    while out is None or below.take(2)[1:]:
        level += 1
        below = scratch.stage(_nodes(below), f"level-{level}")
        own = below.select(F.lit(level).alias("level"), "at", "root", "documents", "n_tokens")
        out = own if out is None else out.unionByName(own)
    return out


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, chunk and store all documents under ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded_at = f"{path}/coded"
    rows.mapInArrow(partial(_code, path=tokenizer, end_id=end_id), CODED).write.option("compression", "zstd").parquet(coded_at)
    coded = spark.read.schema(CODED).parquet(coded_at)
    coded.where("name is not null").select("name", "n_ids", "payload").dropDuplicates(["name"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    ordered_at = f"{path}/ordered"
    recipes = coded.where("root is not null").select("doc_id", "n_tokens", "names", "root")
    recipes.repartitionByRange(F.asc_nulls_first("doc_id"), "root").withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(ordered_at)
    drop_staged(spark, coded_at)
    ordered = spark.read.parquet(ordered_at)
    # One row a shard, as many as there are write tasks.
    totals = sorted((r["shard"], r["n"], r["rows"]) for r in ordered.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect())
    before, rank, base = 0, 0, []
    for shard, n, rows_there in totals:
        base.append((shard, before, rank))
        before, rank = before + n, rank + rows_there
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base bigint, base_rank bigint"))
    run = Window.partitionBy("shard").orderBy(F.asc_nulls_first("doc_id"), "root")
    placed = ordered.join(bases, "shard").withColumn("start", F.col("base") + F.sum("n_tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).withColumn("rank", F.col("base_rank") + F.row_number().over(run) - 1)
    placed.select("rank", "start", "doc_id", "n_tokens", "names", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_staged(spark, ordered_at)
    scratch = Scratch(spark)
    manifest_of(spark.read.parquet(f"{path}/recipes"), scratch).write.parquet(f"{path}/manifest")
    scratch.drop(*list(scratch.paths))


@released
def _checked(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Each stored chunk: its name again from its content, and the CRC-32 of its ids as 32-bit integers."""
    for batch in batches:
        names, payloads = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        crc = [zlib.crc32(np.frombuffer(p, kind).astype("<u4").tobytes()) for p in payloads]
        whole = [name_of(p) == n and len(p) == k * np.dtype(kind).itemsize for n, p, k in zip(names, payloads, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(whole, pa.bool_())], names=["name", "n", "crc", "whole"])


_CRC = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo that of CRC-32."""
    out, b = np.zeros(np.broadcast(a, b).shape, np.uint32), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _CRC, b >> np.uint32(1))
    return out


def _shifts(most: int) -> np.ndarray:
    """x to the power 32 n for n from 0 to ``most``: what n more ids multiply a CRC by."""
    out = np.array([1 << 31], np.uint32)
    step = np.array([1 << 30], np.uint32)
    for _ in range(5):
        step = _times(step, step)  # x ** 32
    while len(out) <= most:
        out = np.concatenate([out, _times(out, np.broadcast_to(step, out.shape))])
        step = _times(step, step)
    return out[: most + 1]


def combined_crcs(crcs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of the joined chunks of each document from those of its chunks."""
    shift = _shifts(max((int(n.max()) for n in lengths if len(n)), default=1))
    out = np.zeros(len(crcs), np.uint32)
    size = np.array([len(c) for c in crcs])
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[on] = _times(shift[[lengths[d][k] for d in on]], out[on]) ^ np.array([crcs[d][k] for d in on], np.uint32)
    return out


@released
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        crcs, lengths, fine = [], [], []
        for parts, root, n in zip(cols["parts"], cols["root"], cols["n_tokens"], strict=True):
            crcs.append(np.array([p["crc"] or 0 for p in parts], np.uint32))
            lengths.append(np.array([p["n"] or 0 for p in parts], np.int64))
            fine.append(all(p["whole"] for p in parts) and merkle([p["name"] for p in parts]) == root and int(lengths[-1].sum()) == n)
        if not all(fine):
            raise ValueError("a document of the token store can't be verified")
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(combined_crcs(crcs, lengths).astype(np.int64)), pa.array(fine, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])


def _references(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of each document.  ``start`` tells documents apart, as each has an id at least."""
    n = F.expr(f"transform(sequence(0, cast(octet_length(names) / {NAME_BYTES} as int) - 1), k -> struct(k as seq, substring(names, k * {NAME_BYTES} + 1, {NAME_BYTES}) as name))")
    return recipes.select("start", "doc_id", "n_tokens", "root", F.explode(n).alias("c")).select("start", "doc_id", "n_tokens", "root", "c.*")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the manifest that the recipes don't give again, or give otherwise; none if all is well."""
    key = ["level", "at"]
    now = manifest_of(spark.read.parquet(f"{path}/recipes"), Scratch(spark)).select(*key, F.struct("root", "documents", "n_tokens").alias("now"))
    held = spark.read.parquet(f"{path}/manifest").select(*key, F.struct("root", "documents", "n_tokens").alias("held"))
    return held.join(now, key, "full_outer").where("now is distinct from held")


def read_digests(spark: SparkSession, path: str, kind: str = "<u2") -> DataFrame:
    """From the files: each document's start, number of ids and CRC-32, all verified; a fault raises."""
    chunks = spark.read.parquet(f"{path}/chunks").select("name", "n_ids", "payload").mapInArrow(partial(_checked, kind=kind), "name binary, n bigint, crc bigint, whole boolean")
    refs = _references(spark.read.parquet(f"{path}/recipes")).join(chunks, "name", "left")
    docs = refs.groupBy("start", "doc_id", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "n", "crc", "whole"))).alias("parts"))
    return docs.mapInArrow(_digest, DIGESTS)


@released
def _ids(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b"".join(p["payload"] for p in parts), kind).astype(np.int64) for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])


def reconstruct(spark: SparkSession, path: str, kind: str = "<u2") -> DataFrame:
    """The id stream of every document, from recipes and chunk payloads."""
    chunks = spark.read.parquet(f"{path}/chunks").select("name", "payload")
    refs = _references(spark.read.parquet(f"{path}/recipes")).join(chunks, "name")
    docs = refs.groupBy("start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    return docs.mapInArrow(partial(_ids, kind=kind), "doc_id bigint, start bigint, ids array<bigint>")


def stored_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a store in the shared folder and read them back."""
    spark = docs.sparkSession
    path = staging_path(spark, "token-store")
    write_store(docs, tokenizer, path, end_id)
    kind = encoder(tokenizer).kind.str
    if bad := verify_manifest(spark, path).take(1):
        raise ValueError(f"the manifest of the token store doesn't hold: {bad}")
    out = Scratch(spark).stage(read_digests(spark, path, kind), "digests")
    drop_staged(spark, path)
    return out
