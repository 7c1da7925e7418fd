"""Exact Jaccard join of documents on word n-grams, in size-banded tiles.

A document's set holds the hashes of its distinct n-grams.  Two sets are linked when
their overlap is at least ``percent`` of their union.  Every link is found:

1. Equal sets are one class, named by a digest of the set.
2. n-grams come in one order for all sets: those that several sets have last.  Which
   ones are late is counted over the whole table and held as a bit table of fixed
   size; it decides the work, never the links, as long as all sets use the same one.
3. Classes that share one of their least hashes are first compared with one leader each;
   what is linked with its leader needs no further comparison inside its component.
4. Of two linked sets, the first n-grams of both (``probe_length`` of the larger,
   ``index_length`` of the smaller) have one in common, so others need no look.
5. Groups that still join different components are dealt out in tiles: by size band, as
   linked sets differ in size by a quarter at most, and by blocks of ``TILE_ROWS``, so
   a large group is many tasks.  In a tile, places in the order and bit counts of hashed
   parity bitmaps bound the overlap from above, and only pairs that may reach it are kept.
6. Kept pairs are decided by intersecting the sorted arrays themselves.

No text is stored: sets are made again from the texts of those documents that a pair
names, which a Bloom filter tells before anything is shuffled.

n-grams and words are 64-bit hashes, and classes 128-bit digests of the hashes.

Defined results: null and empty texts and texts without words have an empty set, no
links, and are their own component; rows with a null doc_id have a null component;
rows that share a doc_id are documents of their own, so they can be in different
components; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACED_WORDS, blocks, mixed, rolling, sequence_hash, text_buffers, words
from .graph import Steps, components
from .shared import Scratch, released

WIDTH, PERCENT = 5, 80
#: Bits of the smallest parity bitmap; larger sets have wider ones.
BITMAP_BITS = 1024
#: Share of a set, its first n-grams by hash, that is counted to find late ones: more than a prefix, which late ones leave.
COUNTED_PERCENT = 30
#: Bits of a table of n-grams, a power of two, and how many n-grams it takes.
TABLE_BITS, TABLE_MOST = 1 << 26, 1 << 22
#: Rounds, at most, in which each class has one candidate pair decided, before all others are.
CLOSEST_ROUNDS = 5
#: Bytes of bitmaps that are compared at once.
PAIR_BYTES = 4 << 20
#: Least hashes of a set, by which it meets its leader.
LOW = 4
#: n-grams that a task holds before it sends their counts.
COUNTS_HELD = 1 << 20
TILE_ROWS = 1024
#: A Bloom filter has 16 bits for each member, up to so many bits in all.  Past that it lets more rows through, which exact joins settle.
BLOOM_MOST_BITS = 1 << 27

FEATURES = "row bigint, doc_id bigint, content bigint, n bigint, name binary, key bigint, low array<bigint>, prefix array<bigint>, bitmap binary"


def sets_of(raw: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of a column."""
    for i, j in blocks(offs):
        w = words(raw, offs[i : j + 1], SPACED_WORDS)
        grams = rolling(w.hashes, width)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(grams[a : b - width + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            elif b > a:
                yield np.array([sequence_hash(w.hashes[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def probe_length(n, percent: int):
    """So many first n-grams of a set meet the index of any smaller linked set: n less the least overlap, and one."""
    return n - -(-n * percent // 100) + 1


def index_length(n, percent: int):
    """The same where the other set is as large at least, so that the overlap must be larger."""
    return n - -(-2 * n * percent // (100 + percent)) + 1


def name_of(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


# --- which n-grams go last ---------------------------------------------------


def _place(grams: np.ndarray) -> np.ndarray:
    """Spreads n-grams over 64 bits anew: a set's first ones by hash are small numbers."""
    return mixed(grams ^ np.uint64(0x5851F42D4C957F2D))


def _packed(grams: np.ndarray, indexed: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """n-grams with their numbers, one row a part of their range; the high bit of a number says that some set has the n-gram in its index."""
    m = _place(grams)
    order = np.argsort(m, kind="stable")
    m = m[order]
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    n = np.minimum(np.diff(np.r_[first, len(m)]), 127).astype(np.uint8)
    if indexed is not None:
        n |= np.maximum.reduceat(indexed[order].astype(np.uint8), first) << np.uint8(7)
    m, of_part = m[first], parts.bit_length() - 1
    part = (m >> np.uint64(64 - of_part)).astype(np.int64) if of_part else np.zeros(len(m), np.int64)
    low = ((m << np.uint64(of_part)) >> np.uint64(32)).astype("<u4")
    edge = np.searchsorted(part, np.arange(parts + 1))
    own = np.flatnonzero(edge[1:] > edge[:-1])
    cut = lambda x: pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in own], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), cut(low), cut(n)], names=["part", "grams", "counts"])


@released
def _of_texts(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The first n-grams by hash of a task's different sets."""
    seen: set[bytes] = set()
    pending, held = [], 0
    for batch in batches:
        raw, offs = text_buffers(batch.column(0))
        for s in sets_of(raw, offs, width):
            if len(s) and (name := blake2b(s.tobytes(), digest_size=8).digest()) not in seen:
                seen.add(name)
                pending.append(s[: 1 + len(s) * COUNTED_PERCENT // 100])
                held += len(pending[-1])
                if held >= COUNTS_HELD:
                    yield _packed(np.concatenate(pending), None, parts)
                    pending, held = [], 0
    if pending:
        yield _packed(np.concatenate(pending), None, parts)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of a list column: values, the row of each, and its place in the row."""
    size = np.asarray(lists.value_lengths(), np.int64)
    values = lists.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    return values, row, np.arange(len(row)) - (np.cumsum(size) - size)[row]


@released
def _of_prefixes(batches: Iterator[pa.RecordBatch], percent: int, parts: int) -> Iterator[pa.RecordBatch]:
    pending, held = [], 0
    for batch in batches:
        grams, row, pos = _flat(batch.column(1))
        pending.append((grams, pos < index_length(batch.column(0).to_numpy()[row], percent)))
        held += len(grams)
        if held >= COUNTS_HELD:
            yield _packed(*map(np.concatenate, zip(*pending, strict=True)), parts)
            pending, held = [], 0
    if held:
        yield _packed(*map(np.concatenate, zip(*pending, strict=True)), parts)


@released
def _several(batches: Iterator[pa.RecordBatch], indexed: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the n-grams of a part that come twice or more, with their numbers; ``indexed``: only those in some index."""

    def merged(part: int, grams: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        g, c = np.frombuffer(b"".join(grams), "<u4"), np.frombuffer(b"".join(counts), np.uint8)
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        n = np.add.reduceat((c & 127).astype(np.int64), first)
        keep = n > 1
        if indexed:
            keep &= np.maximum.reduceat(c, first) > 127
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([g[first][keep].tobytes()], pa.binary()), pa.array([np.minimum(n[keep], (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())], names=["part", "grams", "counts"])

    now, grams, counts = None, [], []
    for batch in batches:
        for part, g, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if part != now and grams:
                yield merged(now, grams, counts)
                grams, counts = [], []
            now = part
            grams.append(g)
            counts.append(c)
    if grams:
        yield merged(now, grams, counts)


#: Numbers of sets from which on an n-gram may be called late.
_FLOORS = np.array([2, 3, 4, 6, 8, *(2**k for k in range(4, 32))], np.int64)


@released
def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each floor, how many n-grams reach it."""
    n = np.zeros(len(_FLOORS), np.int64)
    for batch in batches:
        for c in batch.column(0).to_pylist():
            n += len(c) // 4 - np.searchsorted(np.sort(np.frombuffer(c, "<u4")), _FLOORS)
    yield pa.RecordBatch.from_arrays([pa.array(_FLOORS), pa.array(n)], names=["least", "n"])


@released
def _places(batches: Iterator[pa.RecordBatch], least: int, parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Places in the table of the n-grams that reach the floor, packed."""
    of_part, size = parts.bit_length() - 1, bits.bit_length() - 1
    for batch in batches:
        found = []
        for part, g, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = np.frombuffer(g, "<u4")[np.frombuffer(c, "<u4") >= least].astype(np.uint64)
            m = (np.uint64(part) << np.uint64(64 - of_part) if of_part else np.uint64(0)) | (own << np.uint64(32 - of_part))
            found.append(np.unique(m >> np.uint64(64 - size)).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["at"])


def gram_table(sent: DataFrame, indexed: bool, parts: int, scratch: Scratch, bits: int, most: int) -> tuple[np.ndarray, bool]:
    """A table of ``bits`` bits from packed n-grams: those of n-grams that several sets have, the most shared ones if they
    are more than ``most``; and whether it has all of them.  The driver gets four bytes for each of them."""
    kind = "part bigint, grams binary, counts binary"
    several = scratch.stage(sent.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_several, indexed=indexed), kind), "several")
    reach = several.select("counts").mapInArrow(_floors, "least bigint, n bigint").groupBy("least").agg(F.sum("n").alias("n")).collect()
    least = min((r["least"] for r in reach if r["n"] <= most), default=1 << 32)
    table = np.zeros(bits >> 3, np.uint8)
    for r in several.mapInArrow(partial(_places, least=least, parts=parts, bits=bits), "at binary").collect():
        at = np.frombuffer(r["at"], "<u4")
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    scratch.drop("several")
    return table, not reach or least == _FLOORS[0]


def _parts(df: DataFrame) -> int:
    """Parts of the range of n-grams: in proportion to the splits of the input, so each stays small."""
    return 1 << min(20, max(0, (8 * df.rdd.getNumPartitions() - 1).bit_length()))


def late_grams(docs: DataFrame, width: int, scratch: Scratch, bits: int = TABLE_BITS, most: int = TABLE_MOST) -> np.ndarray:
    """The table of n-grams that go last in the order, by counts over every text."""
    parts = _parts(docs)
    sent = docs.select("text").mapInArrow(partial(_of_texts, width=width, parts=parts), "part bigint, grams binary, counts binary")
    return gram_table(sent, False, parts, scratch, bits, most)[0]


def met_grams(classes: DataFrame, percent: int, scratch: Scratch, bits: int = TABLE_BITS, most: int = TABLE_MOST) -> np.ndarray | None:
    """The table of n-grams that begin two classes at least and index one of them; None, which lets all pass, if they are more than ``most``."""
    parts = _parts(classes)
    sent = classes.select("n", "prefix").mapInArrow(partial(_of_prefixes, percent=percent, parts=parts), "part bigint, grams binary, counts binary")
    table, whole = gram_table(sent, True, parts, scratch, bits, most)
    return table if whole else None


def in_table(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = (_place(grams) >> np.uint64(64 - (8 * len(table)).bit_length() + 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# --- features ----------------------------------------------------------------


def parity_bitmap(s: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    """A bit is set when an odd number of members hash to it; two bitmaps differ in no
    more bits than the sets in members.  ``bits`` is a power of two; the halves of a
    bitmap, joined by exclusive or, are the bitmap of half as many bits."""
    k = (mixed(s ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(8)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(k.astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def bitmap_bits(n: int) -> int:
    """At least half as many as the set has members, or unrelated long documents would look near."""
    return max(BITMAP_BITS, 1 << ((n - 1) // 2).bit_length())


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as a matrix, the wider ones folded to ``size`` bytes."""
    out = np.empty((len(rows), size >> 3), np.uint64)
    for k, x in enumerate(rows):
        a = np.frombuffer(x, np.uint64)
        while len(a) > size >> 3:
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        out[k] = a
    return out


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the wider one folded to the other's width."""
    a, b = folded([x, y], min(len(x), len(y)))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    edge = np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


@released
def _features(batches: Iterator[pa.RecordBatch], late, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    table = late.value
    for batch in batches:
        raw, offs = text_buffers(batch.column(3))
        n, names, keys, lows, prefixes, bitmaps = [], [], [], [], [], []
        for s in sets_of(raw, offs, width):
            n.append(len(s))
            lows.append(s[:LOW].view(np.int64))
            if not len(s):
                names.append(None)
                keys.append(None)
                prefixes.append(s.view(np.int64))
                bitmaps.append(b"")
                continue
            names.append(name_of(s))
            keys.append(int.from_bytes(names[-1][:8], "little", signed=True))
            last = in_table(table, s)
            ordered = np.concatenate([s[~last], s[last]]) if last.any() else s
            prefixes.append(ordered[: probe_length(len(s), percent)].view(np.int64))
            bitmaps.append(parity_bitmap(s, bitmap_bits(len(s))))
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.int64()), _lists(lows), _lists(prefixes), pa.array(bitmaps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FEATURES.split(", ")])


# --- Bloom filters -----------------------------------------------------------


def bloom_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over one column of well-spread bigints, built on the executors."""
    x = F.col(keys.columns[0])
    n = keys.count()
    bits = min(BLOOM_MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    mask = F.lit(bits - 1)
    places = keys.select(F.explode(F.array(x.bitwiseAND(mask), F.shiftrightunsigned(x, 32).bitwiseAND(mask))).alias("bit"))
    rows = places.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bloom(bloom: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether each key may be a member; null isn't."""
    x = np.asarray(keys.fill_null(0), np.int64).view(np.uint64)
    out = np.asarray(keys.is_valid())
    for bit in (x, x >> np.uint64(32)):
        bit = bit & np.uint64(64 * len(bloom) - 1)
        out = out & ((bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1)
    return out


@released
def _filtered(batches: Iterator[pa.RecordBatch], bloom, at: int, member: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(in_bloom(bloom.value, batch.column(at)) == member))


def may_be_in(df: DataFrame, column: str, bloom, member: bool = True) -> DataFrame:
    """Rows whose key may be in the broadcast filter, or with ``member`` false the rows whose key surely isn't."""
    return df.mapInArrow(partial(_filtered, bloom=bloom, at=df.columns.index(column), member=member), df.schema)


@released
def _postings(batches: Iterator[pa.RecordBatch], met) -> Iterator[pa.RecordBatch]:
    """Those n-grams of prefixes that may meet another class, with their places."""
    for batch in batches:
        grams, row, pos = _flat(batch.column(2))
        at = np.flatnonzero(in_table(met.value, grams)) if met.value is not None else np.arange(len(grams))
        cid, n = (batch.column(k).to_numpy()[row[at]] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(cid), pa.array(n), pa.array(pos[at], pa.int32())], names=["gram", "cid", "n", "pos"])


# --- deciding pairs ----------------------------------------------------------


@released
def _sets(batches: Iterator[pa.RecordBatch], bloom, width: int) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # equal sets of a task are sent once
    for batch in batches:
        batch = batch.filter(pa.array(in_bloom(bloom.value, batch.column(0))))
        raw, offs = text_buffers(batch.column(1))
        names, members, size = [], [], 0
        for s in sets_of(raw, offs, width):
            if len(s) and (name := name_of(s)) not in seen:
                seen.add(name)
                names.append(name)
                members.append(s.tobytes())
                size += len(members[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(members, pa.binary())], names=["name", "members"])
                    names, members, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(members, pa.binary())], names=["name", "members"])


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    """Common members of two sorted arrays."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return 0
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


@released
def _decide(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        for k in range(batch.num_rows):
            s, t = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
            both = overlap(s, t)
            yes.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
        yield batch.filter(pa.array(yes, pa.bool_())).select([0, 1])


def named_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (a, b, …) of classes with the names of their sets and a document of each."""
    end = lambda c: names.select(F.col("cid").alias(c), F.col("name").alias(f"name_{c}"), F.col("doc_id").alias(f"doc_{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b")


def sets_for(named: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(name, members) of the sets that the pairs name, and of some more, from the documents' texts."""
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(named.select(F.explode(F.array(F.xxhash64("doc_a"), F.xxhash64("doc_b"))).alias("h"))))
    rows = docs.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "text")
    made = scratch.stage(rows.mapInArrow(partial(_sets, bloom=bloom, width=width), "name binary, members binary"), "made")
    # Equal sets of several tasks, which are rare, must not multiply.
    if made.groupBy("name").count().where("count > 1").take(1):
        once = scratch.stage(made.dropDuplicates(["name"]), "once")
        scratch.forget("made")
        scratch.paths["made"], made = scratch.paths.pop("once"), once
    return made


def decided(named: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are linked, by exact intersection."""
    left = named.join(made.select(F.col("name").alias("name_a"), F.col("members").alias("x")), "name_a")
    both = left.join(made.select(F.col("name").alias("name_b"), F.col("members").alias("y")), "name_b")
    return both.select("a", "b", "x", "y").mapInArrow(partial(_decide, percent=percent), "a bigint, b bigint")


def closest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, like, …) the most promising one of each class."""
    order = F.struct("like", -F.col("a"), -F.col("b"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), "a", "b", "like")
    best = ends.groupBy("c").agg(F.max_by(F.struct("a", "b"), order).alias("p")).select("p.*").distinct()
    return pairs.join(best, ["a", "b"], "left_semi")


@released
def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows whose sizes and bitmaps leave a link possible; the last four columns are n and bitmap of both."""
    for batch in batches:
        k = batch.num_columns - 4
        n, m = (batch.column(i).to_numpy() for i in (k, k + 2))
        apart = np.array([bits_apart(x, y) for x, y in zip(batch.column(k + 1).to_pylist(), batch.column(k + 3).to_pylist(), strict=True)], np.int64)
        most = np.minimum((n + m - apart) // 2, np.minimum(n, m))
        yield batch.filter(pa.array(100 * most >= percent * (n + m - most), pa.bool_())).select(list(range(k)))


def possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, …) of classes that sizes and bitmaps don't rule out."""
    end = lambda c: sizes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bitmap_{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").select(*pairs.columns, "n_a", "bitmap_a", "n_b", "bitmap_b")
    return both.mapInArrow(partial(_possible, percent=percent), pairs.schema)


# --- tiles -------------------------------------------------------------------


@released
def _tile(batches: Iterator[pa.RecordBatch], percent: int, closest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: pairs of a tile whose bitmaps leave the overlap possible."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column(0).to_numpy()
        if not len(tile):
            continue
        # Whole tiles are worked on: what is held, and the batch up to where its last tile begins.
        cut = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if tile[0] != tile[-1] else 0
        if cut or (held and held[-1].column(0)[-1].as_py() != tile[0]):
            yield from _pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]), percent, closest)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _pairs(pa.Table.from_batches(held), percent, closest)


def _sent(a: np.ndarray, b: np.ndarray, like: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), like], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], names=["a", "b", "like"])


def _pairs(rows: pa.Table, percent: int, closest: bool) -> Iterator[pa.RecordBatch]:
    tile, cid, n, pos, comp, side = (rows.column(c).to_numpy() for c in ("tile", "cid", "n", "pos", "component", "side"))
    if not len(tile):
        return
    bitmaps = rows.column("bitmap").to_pylist()
    begin = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    # Bands keep the widths of a tile within a factor of two or so: the narrowest counts.
    width = np.minimum.reduceat(np.fromiter(map(len, bitmaps), np.int64, len(bitmaps)), begin)
    width = np.repeat(width, np.diff(np.r_[begin, len(tile)]))
    for size in np.unique(width):
        own = np.flatnonzero(width == size)
        bits = folded([bitmaps[k] for k in own], int(size))
        t, c, m, p, o, s = tile[own], cid[own], n[own], pos[own], comp[own], side[own]
        best, partner = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
        found, waiting = [], 0
        first = np.arange(len(own))
        for lag in range(1, len(own)):
            first = first[first + lag < len(own)]
            first = first[t[first] == t[first + lag]]
            if not len(first):
                break
            # Pieces of the tile at a time, so that what is compared stays small.
            for piece in np.array_split(first, -(-len(first) * int(size) // PAIR_BYTES)):
                i, j = piece, piece + lag
                both = m[i] + m[j]
                need = -(-percent * both // (100 + percent))
                # Linked sets have their first common n-gram where enough of both is left.
                may = (o[i] != o[j]) & ((s[i] != s[j]) | (s[i] == 2)) & (p[i] <= m[i] - need) & (p[j] <= m[j] - need)
                i, j, both, need = i[may], j[may], both[may], need[may]
                if not len(i):
                    continue
                # overlap <= (|x| + |y| - bits apart) / 2
                most = (both - np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)) // 2
                ok = most >= need
                i, j, like = i[ok], j[ok], 1000 * most[ok] // both[ok]
                if closest:
                    for x, y in ((i, j), (j, i)):
                        more = like > best[x]
                        best[x[more]], partner[x[more]] = like[more], y[more]
                else:
                    found.append((c[i], c[j], like))
                    waiting += len(i)
                    if waiting > 1 << 16:
                        yield _sent(*map(np.concatenate, zip(*found, strict=True)))
                        found, waiting = [], 0
        if closest and len(at := np.flatnonzero(best >= 0)):
            yield _sent(c[at], c[partner[at]], best[at])
        elif found:
            yield _sent(*map(np.concatenate, zip(*found, strict=True)))


def tiled_pairs(postings: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch, closest: bool) -> DataFrame:
    """Candidate pairs between components with a bound of their likeness, from postings (gram, cid, n, pos, component).
    ``closest``: of each row of a tile only the most promising pair."""
    # ``side``: 0 the lower band of a tile, 1 the upper one, 2 for pairs inside the band.
    step = float(np.log(100 / percent))
    band = F.floor(F.log(F.col("n")) / F.lit(step))
    rows = postings.withColumn("band", band)
    in_tile = rows.select("*", F.explode(F.array(F.struct(F.col("band").alias("tile_band"), F.lit(2).alias("side")), F.struct((F.col("band") + 1).alias("tile_band"), F.lit(0).alias("side")), F.struct(F.col("band").alias("tile_band"), F.lit(1).alias("side")))).alias("t")).select("gram", "cid", "n", "pos", "component", "t.*")
    in_tile = in_tile.withColumn("inside", F.col("side") == 2)
    counted = in_tile.groupBy("gram", "tile_band", "inside").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("side").alias("low_side"), F.max("side").alias("high_side"))
    # A tile with one component, or with one band only where two are needed, has no pair to look for.
    tiles = scratch.stage(counted.where("rows > 1 and lo <> hi and (inside or low_side <> high_side)").select("gram", "tile_band", "inside", F.ceil(F.col("rows") / F.lit(TILE_ROWS)).cast("int").alias("parts")), "tiles")
    rows = in_tile.join(tiles, ["gram", "tile_band", "inside"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # Inside a band, blocks meet as unordered pairs; across bands, lower blocks are rows and upper blocks columns.
    blocks_of = F.when(F.col("inside"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.when(F.col("side") == 0, F.col("own")).otherwise(k).alias("i"), F.when(F.col("side") == 0, k).otherwise(F.col("own")).alias("j")))
    )
    dealt = rows.select("cid", "n", "pos", "component", "side", F.explode(blocks_of).alias("block"), "gram", "tile_band", "inside").withColumn("tile", F.xxhash64("gram", "tile_band", "inside", "block.i", "block.j"))
    dealt = dealt.join(sizes.select("cid", "bitmap"), "cid").select("tile", "cid", "n", "pos", "component", "side", "bitmap")
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(partial(_tile, percent=percent, closest=closest), "a bigint, b bigint, like bigint").distinct()


# --- the join ----------------------------------------------------------------


def _classes(features: DataFrame, names: DataFrame) -> DataFrame:
    """One row of features for each class, its first; only classes of several rows are joined for it."""
    sc = features.sparkSession.sparkContext
    several = names.where("copies > 1")
    bloom = sc.broadcast(bloom_of(several.select("key")))
    wide = features.where("key is not null").select("row", "n", "key", "low", "prefix", "bitmap")
    alone = may_be_in(wide, "key", bloom, False).select(F.col("row").alias("cid"), "n", "low", "prefix", "bitmap")
    first = may_be_in(wide, "key", bloom).join(names.select(F.col("cid").alias("row")), "row", "left_semi").select(F.col("row").alias("cid"), "n", "low", "prefix", "bitmap")
    return alone.unionByName(first)


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("content"), text.alias("text"))


def text_key(text) -> F.Column:
    """What tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit(""))), text.isNull())


def linked_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, in the shared folder: doc_id, content, n, ``component``, the number of its component of
    linked classes, and ``rows``, how many rows that has, both null for empty sets and null doc_ids, and ``least``, its smallest doc_id."""
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark)
    docs = _rows_of(docs, id_col, text_col)
    late = sc.broadcast(late_grams(docs, width, scratch))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "content", "text")
    features = scratch.stage(numbered.mapInArrow(partial(_features, late=late, width=width, percent=percent), FEATURES), "features")

    # 1. Classes of equal sets.
    real = features.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row")).alias("first")
    names = scratch.stage(real.groupBy("name").agg(first, F.first("key").alias("key"), F.count("*").alias("copies")).select("name", "key", F.col("first.row").alias("cid"), F.col("first.doc_id").alias("doc_id"), "copies"), "names")
    classes = scratch.stage(_classes(real, names), "classes")
    rows = scratch.stage(features.select("doc_id", "content", "n", F.when(F.col("doc_id").isNotNull(), F.col("name")).alias("name")), "rows")
    scratch.drop("features")

    # 2. Each class with the possible leader that it shares most of its least hashes with.
    sizes = scratch.stage(classes.select("cid", "n", "bitmap"), "sizes")
    low = classes.select("cid", F.explode("low").alias("gram"))
    leaders = scratch.stage(low.groupBy("gram").agg(F.min("cid").alias("leader"), F.max("cid").alias("last")).where("leader < last").select("gram", "leader"), "leaders")
    votes = low.join(leaders, "gram").where("cid <> leader").groupBy(F.col("cid").alias("b"), F.col("leader").alias("a")).count()
    likely = possible(votes.select("a", "b", "count"), sizes, percent)
    star = scratch.stage(likely.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"), "star")
    named = scratch.stage(named_pairs(star, names), "named-pairs")
    links = scratch.stage(decided(named, sets_for(named, docs, width, scratch), percent), "star-links")
    scratch.drop("made", "star", "leaders", "named-pairs")
    steps = Steps(scratch)
    near = components(links, steps)

    # 3. n-grams that begin two classes at least and index one of them.
    met = sc.broadcast(met_grams(classes, percent, scratch))
    postings = scratch.stage(classes.select("cid", "n", "prefix").mapInArrow(partial(_postings, met=met), "gram bigint, cid bigint, n bigint, pos int"), "postings")
    scratch.drop("classes")

    # 4. As far as they still join different components: first the most promising pair of each class, as what those join
    # needs no more pairs, again until most of them aren't links; then all that is left.
    found, last = near, False
    for k in range(CLOSEST_ROUNDS + 1):
        last = last or k == CLOSEST_ROUNDS
        owned = postings.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("gram", "cid", "n", "pos", F.coalesce("component", "cid").alias("component"))
        owned = scratch.stage(owned, "owned")
        live = scratch.stage(owned.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram"), "live")
        pairs = scratch.stage(tiled_pairs(owned.join(live, "gram"), sizes, percent, scratch, not last), "pairs")
        candidates = scratch.stage(named_pairs(pairs if last else closest(pairs), names), "candidates")
        more = scratch.stage(decided(candidates, sets_for(candidates, docs, width, scratch), percent), f"links-of-{k}")
        links = links.unionByName(more)
        asked, linked = candidates.count(), more.count()
        if linked:
            found = components(links, steps)
        scratch.drop("owned", "live", "tiles", "pairs", "candidates", "made")
        if last:
            break
        last = 4 * linked <= asked
    scratch.drop("postings", "sizes")
    grouped = scratch.stage(names.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("name", "doc_id", "copies", F.coalesce("component", "cid").alias("component")), "grouped")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("least"), F.sum("copies").alias("rows")).where("rows > 1")
    of_names = grouped.join(least, "component", "left").select("name", "component", F.coalesce("least", "doc_id").alias("least"), F.coalesce("rows", F.lit(1).cast("bigint")).alias("rows"))
    # Rows without a name have no partner, and aren't sent to one task for it.
    some = rows.where("name is not null").join(scratch.stage(of_names, "of-names"), "name").select("doc_id", "content", "n", "component", "least", "rows")
    none = F.lit(None).cast("bigint")
    alone = rows.where("name is null").select("doc_id", "content", "n", none.alias("component"), F.col("doc_id").alias("least"), none.alias("rows"))
    out = scratch.stage(some.unionByName(alone), "linked")
    scratch.drop(*[name for name in scratch.paths if name != "linked"])
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its set's size, and the smallest doc_id reachable by links."""
    return linked_rows(docs, width, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, and of rows that share it the one whose text has the
    smallest key; of rows with one doc_id and text, one.  Rows with a null doc_id and rows without words have no duplicates and stay.

    Only rows that may have to go are shuffled.
    """
    spark = docs.sparkSession
    # Rows of components of several rows; whatever else has such a key by chance is told apart by the exact join.
    rows = linked_rows(docs, width, percent).where("rows > 1")
    scratch = Scratch(spark)
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "content")).alias("first"))
    keep = scratch.stage(first.select("first.*", F.lit(True).alias("stays")), "keep")
    marks = scratch.stage(rows.select("doc_id", "content").distinct().join(keep, ["doc_id", "content"], "left").withColumn("stays", F.coalesce("stays", F.lit(False))), "marks")
    bloom = spark.sparkContext.broadcast(bloom_of(marks.select(F.xxhash64("doc_id", "content").alias("h"))))
    scratch.forget("keep")
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("bigint")).withColumn("__content", text_key(text)).withColumn("__key", F.when(F.col("__id").isNotNull(), F.xxhash64("__id", "__content")))
    sure = may_be_in(keyed, "__key", bloom, False).select(*docs.columns)
    said = marks.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), "stays")
    asked = may_be_in(keyed, "__key", bloom).join(said.withColumnRenamed("stays", "__stays"), ["__id", "__content"], "left").where("coalesce(__stays, true)")
    chance = asked.where("__stays is null").select(*docs.columns)
    return sure.unionByName(chance).unionByName(asked.where("__stays").dropDuplicates(["__id", "__content"]).select(*docs.columns))
