"""BPE as a deterministic automaton over tokens, built merge by merge.

The automaton starts with one state and an arc for every base symbol.  Merge
number k of (a, b) applies one gadget: for every state with an a-arc into a state
t that has a b-arc into r, a copy of t without the b-arc becomes the target of all
a-arcs, and the state gets an ab-arc into r.  After all merges exactly the
correct tokenizations are accepted.

All arcs with one label share their target, so a gadget is kept as what it changes:
the state that it copies, the arc that it drops, and its number.  Whether a
state has an arc follows from the gadgets back to the last one that touched either
side; each answer is filled into the transition table and then only looked up.
Encoding a pre-split word follows the table: place i of the word has exactly one
label by which it can be reached.  Words are followed side by side: a trie over the
bytes of the vocabulary gives the labels that end at each place, and place i of all
of them is settled at once; a word of more than ``LONGEST_ABREAST`` bytes goes alone.
Decoding emits the labels of the arcs.

Texts are normalised (NFC, white space, lower case) and split as the tokenizer file
says, whole; a task works out each word once, as far as its memo reaches.

Defined results: null and empty texts have no ids, decode to the empty text;
repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_parts
from .units import UnitMemo

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
ENCODED_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
#: Arcs kept in the transition table of words that go alone; a full table is begun anew.
ARCS_KEPT = 400_000
#: Places of the transition table of words side by side, a power of 2; an arc takes the place of an older one.
ARC_PLACES = 1 << 19
#: Bytes of the longest word that is followed beside others, and bytes of words that are followed at once.
LONGEST_ABREAST, ABREAST_BYTES = 64, 1 << 18
#: Estimated bytes of a generation of a task's words.
WORD_BYTES_KEPT = 64 << 20


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + extra)
        extra += b not in plain
    return out


class MergeAutomaton:
    """states and arcs are token ids: a state is named by the label that leads to it."""

    def __init__(self, merges: list[tuple[int, int, int]], n_tokens: int):
        self.born = [0] * n_tokens
        self.left, self.right = [-1] * n_tokens, [-1] * n_tokens
        self.dropped: dict[int, int] = {}
        self.n = n_tokens
        self.arcs: dict[int, bool] = {}
        for k, (a, b, ab) in enumerate(merges, 1):
            if self.born[ab] or (a * n_tokens + b) in self.dropped:
                raise ValueError(f"merge {k} makes a token or uses a pair for the second time")
            self.gadget(k, a, b, ab)
        # The same as arrays, for many arcs at once.
        self.gadgets = np.array([self.born, self.left, self.right], np.int64).reshape(3, -1)
        pairs = np.fromiter(self.dropped.keys(), np.int64, len(self.dropped))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.int64(-1))
        self.pair_numbers = np.append(np.fromiter(self.dropped.values(), np.int64, len(self.dropped))[order], np.int64(0))
        self.places = np.full(ARC_PLACES, -1, np.int64)

    def gadget(self, k: int, a: int, b: int, ab: int) -> None:
        self.dropped[a * self.n + b] = k
        self.born[ab], self.left[ab], self.right[ab] = k, a, b

    def has_arc(self, state: int, label: int) -> bool:
        key = state * self.n + label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[key] = self._follow(state, label)
        return known

    def _follow(self, x: int, y: int) -> bool:
        """Back through the gadgets, from after the last one."""
        n, born, dropped = self.n, self.born, self.dropped
        k = 1 << 60
        while True:
            if dropped.get(x * n + y, k + 1) <= k:
                return False
            i, j = born[x], born[y]
            if not i and not j:
                return True
            if i >= j:
                # The state that x leads to is the one its right part led to, just before the gadget.
                k = i - 1
                if i == j:
                    x, y = self.right[x], self.left[y]
                else:
                    x = self.right[x]
            else:
                # An arc labelled y was added where an arc of its left part was.
                a, b = self.left[y], self.right[y]
                if x == a == b:
                    return False
                k, y = j - 1, a

    def _follow_all(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_follow`` of many arcs, each step of all of them at once."""
        born, left, right = self.gadgets
        found = np.zeros(len(x), bool)
        rest, k = np.arange(len(x)), np.full(len(x), 1 << 60)
        while len(rest):
            pair = x * self.n + y
            at = np.searchsorted(self.pairs[:-1], pair)
            i, j = born[x], born[y]
            base = (i == 0) & (j == 0)
            back = i >= j
            a = left[y]
            gone = (self.pairs[at] == pair) & (self.pair_numbers[at] <= k)
            gone |= ~back & (x == a) & (a == right[y])
            found[rest[base & ~gone]] = True
            k = np.where(back, i, j) - 1
            x, y = np.where(back, right[x], x), np.where(back & (i != j), y, a)
            on = ~(base | gone)
            rest, k, x, y = rest[on], k[on], x[on], y[on]
        return found

    def have_arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """``has_arc`` of many: a place of the table holds an arc's pair times two, and whether it is there."""
        key = states * self.n + labels
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).view(np.int64) & ARC_PLACES - 1
        held = self.places[at]
        new = held >> 1 != key
        if new.any():
            pairs, back = np.unique(key[new], return_inverse=True)
            held[new] = (pairs * 2 + self._follow_all(pairs // self.n, pairs % self.n))[back]
            self.places[at[new]] = held[new]
        return (held & 1).astype(bool)

    def encode_abreast(self, words: list[bytes], trie: ByteTrie) -> tuple[np.ndarray, np.ndarray]:
        """The accepted paths of words that aren't empty, joined, and the number of labels of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        last = np.cumsum(size)
        first = last - size
        begin, stop = np.repeat(first, size), np.repeat(last, size)
        # Labels from each byte on, longer and longer: where they start, the place where they end, and the label.
        at, node, found = np.arange(len(data)), np.zeros(len(data), np.int32), []
        for n in range(1, trie.longest + 1):
            node = trie.next[node, data[at + n - 1]]
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            label = np.where(at + n == stop[at], trie.ended[node], trie.plain[node])
            got = np.flatnonzero(label >= 0)
            found.append((at[got], at[got] + n, label[got]))
            on = (at + n < stop[at]) & trie.inner[node]
            at, node = at[on], node[on]
        start, end, label = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        # By the number of bytes up to a label's end: all of one number are settled together, from those of smaller ones.
        depth = end - begin[start]
        order = np.argsort(depth, kind="stable")
        start, end, label = start[order], end[order], label[order].astype(np.int64)
        edge = np.searchsorted(depth[order], np.arange(1, int(size.max(initial=0)) + 2))
        reached, back = np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64)
        leads = start == begin[start]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            s, e, y = start[a:b], end[a:b], label[a:b]
            ok = leads[a:b].copy()
            # The place before byte s of a word is that of end s; a place of one word is never looked up from the next.
            inside = np.flatnonzero(~ok & (reached[s] >= 0))
            ok[inside] = self.have_arcs(reached[s[inside]], y[inside])
            ok = np.flatnonzero(ok)
            reached[e[ok]], back[e[ok]] = y[ok], s[ok]
        if (reached[1:] < 0).any():
            raise ValueError("a symbol outside the vocabulary")
        on_path = np.zeros(len(data) + 1, bool)
        now, lead = last, first
        while len(now):
            on_path[now] = True
            now = back[now]
            more = now > lead
            now, lead = now[more], lead[more]
        path = np.flatnonzero(on_path)
        return reached[path], np.diff(np.searchsorted(path, np.append(first, len(data)), "right"))

    def encode(self, words: list[str], vocab: dict[str, int], end: str, longest: int) -> list[list[int]]:
        """The one accepted path of each word, one base symbol a character, the
        last with the word end.  In sorted order, words share the way through
        the prefix that they have in common."""
        get, arcs, size, paths = vocab.get, self.arcs, self.n, {}
        labels, backs, before = [-1], [0], ""
        for word in sorted(words):
            n, same = len(word), 0
            for x, y in zip(word, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            same = min(same, len(labels) - 1, n - 1)
            del labels[same + 1 :], backs[same + 1 :]
            for i in range(same + 1, n + 1):
                ended = word + end if i == n else word
                upto = len(ended) if i == n else i
                for j in range(i - longest if i > longest else 0, i):
                    label = get(ended[j:upto])
                    if label is None:
                        continue
                    if j:
                        known = arcs.get(labels[j] * size + label)
                        if not (self.has_arc(labels[j], label) if known is None else known):
                            continue
                    break
                else:
                    raise ValueError("a symbol outside the vocabulary")
                if i < n:
                    labels.append(label)
                    backs.append(j)
            path = [label]
            while j:
                path.append(labels[j])
                j = backs[j]
            paths[word] = path[::-1]
            before = word
        return [paths[w] for w in words]


class ByteTrie:
    """The labels of a vocabulary by their bytes; node 0 is the root, and where nothing leads on."""

    def __init__(self, labels: list[tuple[bytes, bool, int]]):
        """labels: (bytes, whether the word ends with it, id)."""
        nodes: dict[bytes, int] = {b"": 0}
        own = sorted(labels)
        for label, _, _ in own:
            n = len(label)
            while n and label[:n] not in nodes:
                n -= 1
            for k in range(n + 1, len(label) + 1):
                nodes[label[:k]] = len(nodes)
        # Nodes with others below them have rows of their own.
        self.next = np.zeros((len(nodes), 256), np.int32)
        up = [nodes[x[:-1]] for x in nodes if x]
        self.next[up, [x[-1] for x in nodes if x]] = np.arange(1, len(nodes))
        self.inner = np.zeros(len(nodes), bool)
        self.inner[up] = True
        self.plain, self.ended = (np.full(len(nodes), -1, np.int32) for _ in range(2))
        for label, ends, i in own:
            (self.ended if ends else self.plain)[nodes[label]] = i
        self.longest = max([len(x) for x in nodes])


class WordBpe:
    """The word-end BPE tokenizer of a ``tokenizers`` JSON file, by its automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        special = sorted(((x["content"], x["id"]) for x in spec["added_tokens"]), key=lambda x: -len(x[0]))
        self.special = dict(special)
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in special}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s, _ in special) + ")").split if special else None
        self.letters = byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], max(self.names) + 1)
        self.longest = max(len(s.removesuffix(self.end)) for s in self.vocab)
        byte = {c: b for b, c in enumerate(self.letters)}
        labels = [(t.removesuffix(self.end), t.endswith(self.end), i) for t, i in self.vocab.items() if i not in self.special.values()]
        self.trie = ByteTrie([(bytes([byte[c] for c in t]), ends, i) for t, ends, i in labels])
        self.decimal = [str(i) for i in range(max(self.names) + 1)]
        self.known_words = UnitMemo(self.encode_words, WORD_BYTES_KEPT)

    def encode_words(self, words: list[str]) -> list[tuple[str, str]]:
        """(ids, labels) of words, each joined by spaces."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(raw) if len(w) <= LONGEST_ABREAST]
        step = ABREAST_BYTES // LONGEST_ABREAST
        for a in range(0, len(short), step):
            some = short[a : a + step]
            ids, n = self.automaton.encode_abreast([raw[k] for k in some], self.trie)
            flat = ids.tolist()
            decimal, names = [self.decimal[i] for i in flat], [self.names[i] for i in flat]
            end = 0
            for k, size in zip(some, n.tolist(), strict=True):
                at, end = end, end + size
                out[k] = (decimal[at], names[at]) if size == 1 else (" ".join(decimal[at:end]), " ".join(names[at:end]))
        for k, w in enumerate(raw):
            if len(w) > LONGEST_ABREAST:
                ids = self.automaton.encode(["".join([self.letters[b] for b in w])], self.vocab, self.end, self.longest)[0]
                out[k] = (" ".join(map(str, ids)), self.decode(ids))
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised.  A character is put in lower case by itself."""
        return self.words((text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower())

    def _parts(self, text: str) -> list[str]:
        return self.cut_special(text) if self.cut_special and "<|" in text else [text]

    def encode_joined(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(count, ids, decoded text) of each text, ids joined by spaces."""
        split = []
        every: set[str] = set()
        for text in texts:
            parts = self._parts(text)
            # No word has a space: a special token with one before it is told apart from words.
            words = self.split(text) if len(parts) == 1 else [w for p in parts for w in ([" " + p] if p in self.special else self.split(p))]
            split.append(words)
            every.update(words)
        special = {" " + s: (str(i), s) for s, i in self.special.items()}
        known = self.known_words.ready(every.difference(special))
        if not every.isdisjoint(special):
            known = known | special
        out = []
        for words in split:
            got = [known[w] for w in words]
            ids = " ".join([g[0] for g in got])
            out.append((ids.count(" ") + 1 if got else 0, ids, " ".join([g[1] for g in got])))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs in turn; the file names no decoder, so they are joined by spaces."""
        return " ".join([self.names[i] for i in ids])


def encoder(path: str) -> WordBpe:
    """One for each task: a worker that waits for its next task holds none."""
    return WordBpe(path)


@released
def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for part in small_parts(batches, 1):
        got = own.encode_joined([x or "" for x in part.column(1).to_pylist()])
        sha = [[hashlib.sha256(g[k].encode("utf-8", "surrogatepass")).hexdigest() for g in got] for k in (1, 2)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of ids, SHA-256 of the ids and of the decoded text; a narrow pass."""
    return _rows(docs, id_col, text_col).mapInArrow(partial(_digests, path=path), SCHEMA)


@released
def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for part in small_parts(batches, 1):
        got = own.encode_joined([x or "" for x in part.column(1).to_pylist()])
        ids = np.fromstring(" ".join([g[1] for g in got]), np.int32, sep=" ")
        edge = np.cumsum([0] + [g[0] for g in got]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids[: edge[-1]]))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), lists, pa.array([g[2] for g in got], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its ids and the text that they decode to."""
    return _rows(docs, id_col, text_col).mapInArrow(partial(_encoded, path=path), ENCODED_SCHEMA)
