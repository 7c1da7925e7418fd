"""Vectorised word work on the UTF-8 buffers of Arrow string columns.

No Python string is made for a word: a byte table marks word bytes, prefix sums
of a polynomial over the bytes give a 64-bit hash for any slice, and everything
after that is numpy on whole blocks of documents.  A polynomial modulo 2**64 has
long words that collide by construction, so words of more than ``LONGEST_SUMMED``
bytes get a BLAKE2b digest of their bytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of the longest word whose hash is a sum; longer ones are digested.
LONGEST_SUMMED = 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_table(word_byte) -> np.ndarray:
    """256 bytes: 0 for a separator, else the byte with A-Z lower-cased."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 0x41 <= b <= 0x5A else b
        if word_byte(c):
            t[b] = c
    return t


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z, all beyond ASCII.
ALNUM_WORDS = byte_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
#: ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
SPACED_WORDS = byte_table(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D or c == 0))
#: A zero byte is a word byte there, and 0 marks separators in the table: 0xFF, which UTF-8 never has, stands for it.
SPACED_WORDS[0] = 0xFF


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if offsets is not None else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of about ``most`` bytes, each of one document at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(33))
        h = h * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


@dataclass
class Words:
    """Words of a run of documents: hashes, byte spans in the run, and ``first[d]`` the first word of document d."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """offs: the run's own offsets (n + 1), ascending, into ``raw``."""
    lo, hi = int(offs[0]), int(offs[-1])
    b = table[raw[lo:hi]]
    n = len(b)
    edge = (offs - lo).astype(np.int64)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e.astype(np.uint64), e, e, np.zeros(len(offs), np.int64))
    inside = b != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = edge[(edge > 0) & (edge < n)]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    ws, we = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _grown(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[b] * power[:n], out=total[1:])
        h = mixed((total[we] - total[ws]) * inverse[ws])
    for k in np.flatnonzero(we - ws > LONGEST_SUMMED).tolist():
        h[k] = int.from_bytes(blake2b(b[ws[k] : we[k]].tobytes(), digest_size=8).digest(), "little")
    return Words(h, ws, we, np.searchsorted(ws, edge))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, by the first one's place."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(width):
            out = out * _U(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return mixed(out)


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole short sequence; its length counts."""
    out = len(hashes) * 0x2545F4914F6CDD1D & (1 << 64) - 1
    for x in hashes.tolist():
        out = (out * 0xD6E8FEB86659FD93 + x) & (1 << 64) - 1
    return int(mixed(np.array([out], np.uint64))[0])


def hash_words(text: str, table: np.ndarray) -> np.ndarray:
    """Word hashes of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words(raw, np.array([0, len(raw)], np.int64), table).hashes


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.large_binary()).cast(pa.binary())
