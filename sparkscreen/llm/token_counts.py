"""Token counts by prefix dynamic programming.

For every prefix of a text the exact number of tokens of that prefix is stored,
so "how many tokens has it", "where must it be cut to fit a budget" and "how many
tokens have its first n characters" are lookups, never a new encoding.

The table holds ``count[i] = count[j] + 1``: the encoding of the first i characters
is the encoding of the first j and one more token t, namely the only t whose
pair with the last token of prefix j is stable, i.e. encodes to these two again.
That holds for every tokenizer that merges the best adjacent pair first.  Pieces
never hold a space behind another character, nor a line feed, so the table
of a text is joined from those of its space-led units, each worked out once.

Characters outside the vocabulary count one token for each UTF-8 byte, as the
library's byte fallback gives them; a space that the library puts before the
text joins its first unit.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
stay; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_parts
from .units import UnitMemo

SPACE = "▁"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Pairs of pieces whose stability is kept.
PAIRS_KEPT = 200_000


def unit_pattern(pieces) -> re.Pattern:
    """Cuts a text at borders that no piece crosses: before a space that follows
    another character, around a line feed, and between letters and other
    characters, as far as the vocabulary allows it."""
    inner = [p for p in pieces if p.strip(SPACE) and SPACE in p.lstrip(SPACE) or "\n" in p]
    if inner:
        raise ValueError(f"pieces cross the borders of units: {inner[:3]}")
    odd = ""
    while True:
        letter = f"[^\\W\\d_{odd}]"
        mixed = re.compile(f"({letter})(?!{letter}).|(?!{letter}|{SPACE}).({letter})")
        found = {m[1] or m[2] for p in pieces for m in mixed.finditer(p)}
        if not found:
            break
        odd += "".join(sorted(found))
        if len(odd) > 64:
            return re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
    other = f"[\\W\\d_{odd}]"
    return re.compile(f"\n|{SPACE}*{letter}+|{SPACE}*(?:(?![{SPACE}\n]){other})+|{SPACE}+")


def _piece_kinds(proto: bytes) -> Iterator[int]:
    """The kind of each piece in a serialized model: field 1 of the model holds a piece, field 3 of a piece its kind, 1 if it is left out."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = proto[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(field, first byte or value, end)"""
        while at < end:
            tag, at = number(at)
            if tag & 7 == 2:
                size, at = number(at)
                yield tag >> 3, at, at + size
                at += size
            elif tag & 7 == 0:
                value, at = number(at)
                yield tag >> 3, value, at
            else:
                yield tag >> 3, at, at
                at += {1: 8, 5: 4}[tag & 7]

    for field, a, b in fields(0, len(proto)):
        if field == 1:
            yield next((value for f, value, _ in fields(a, b) if f == 3), 1)


class PrefixCounter:
    """Exact counts for all prefixes with a byte-fallback BPE piece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._expect(library)
        normal = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in normal}
        self.cut = unit_pattern(self.score).findall
        self.longest = max(map(len, self.score))
        self.stable: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.tables = UnitMemo(self.unit_tables)
        self.sums = UnitMemo(lambda units: [t[-1] for t in self.unit_tables(units)])

    @staticmethod
    def _expect(library) -> None:
        """Raises where the library's settings or pieces differ from what the table is made for."""
        ids = range(library.get_piece_size())
        if not any(library.is_byte(i) for i in ids):
            raise ValueError("the model has no byte fallback")
        # A space before the text, spaces kept as they are, no character changed, no piece taken whole whatever stands beside it.
        for text, want in (("a", " a"), ("  a  b ", "   a  b "), ("\u2460\uff21e\u0301", " \u2460\uff21e\u0301")):
            if library.normalize(text).replace(SPACE, " ") != want:
                raise ValueError(f"the model's normaliser turns {text!r} into {library.normalize(text)!r}")
        spec = getattr(library, "serialized_model_proto", None)
        if spec is not None and any(kind == 4 for kind in _piece_kinds(spec())):
            raise ValueError("the model has pieces of the user's")

    def merged(self, text: str) -> list[str]:
        """Best pair first, the leftmost of equals: the rule itself, for two pieces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def unit_tables(self, units: list[str]) -> list[tuple[int, ...]]:
        """Tokens of each prefix of each unit, by its length from 1 on.  In sorted
        order, units share the rows of the prefix they have in common."""
        score, longest = self.score, self.longest
        tables: dict[str, tuple[int, ...]] = {}
        count, last, before = [0], [""], ""
        for unit in sorted(units):
            same = 0
            for x, y in zip(unit, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            for i in range(same + 1, len(unit) + 1):
                for j in range(i - longest if i > longest else 0, i):
                    piece = unit[j:i]
                    if piece not in score and i - j > 1:
                        continue
                    if j:
                        row = self.stable.get(left := last[j])
                        known = row.get(piece) if row else None
                        if known is None:
                            known = self._decide(left, piece)
                        if not known:
                            continue
                    count.append(count[j] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass"))))
                    last.append(piece)
                    break
                else:
                    raise AssertionError(f"no last piece for a prefix of {unit!r}")
            tables[unit] = tuple(count[1:])
            before = unit
        return [tables[u] for u in units]

    def _decide(self, left: str, right: str) -> bool:
        """Whether the two pieces, side by side, encode to themselves."""
        if self.pairs >= PAIRS_KEPT:
            self.stable.clear()
            self.pairs = 0
        self.pairs += 1
        known = self.stable.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
        return known

    def units(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text: the last entry of its table."""
        units = [self.units(text) for text in texts]
        every: set[str] = set()
        for one in units:
            every.update(one)
        get = self.sums.ready(every).__getitem__
        return [sum(map(get, one)) for one in units]

    def table(self, text: str) -> list[int]:
        """count[i]: tokens of ``text[:i]``, for i from 0 to its length."""
        units = self.units(text)
        known, out, before = self.tables.ready(set(units)), [], 0
        for u in units:
            out += [before + c for c in known[u]]
            before += known[u][-1]
        return [0, *out[1:]] if text else [0]

    def cut_for(self, text: str, budget: int) -> int:
        """Length of the longest prefix with ``budget`` tokens at most.  Counts may
        fall as a prefix grows, so the last place is taken, not the first."""
        return max(i for i, c in enumerate(self.table(text)) if c <= budget)


def counter(model_file: str) -> PrefixCounter:
    """One for each task: a worker that waits for its next task holds none."""
    return PrefixCounter(model_file)


@released
def _count(batches: Iterator[pa.RecordBatch], model: str, limit: int) -> Iterator[pa.RecordBatch]:
    own = counter(model)
    for part in small_parts(batches, 1):
        texts = [x or "" for x in part.column(1).to_pylist()]
        n = own.totals(texts)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with bytes, tokens, and whether they are more than ``limit``; a narrow pass."""
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(partial(_count, model=model_file, limit=limit), SCHEMA)


@released
def _tables(batches: Iterator[pa.RecordBatch], model: str, budgets: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    own = counter(model)
    for part in small_parts(batches, 1):
        # Stored as steps: a count is within a few of the one before it.
        steps, cuts = [], []
        for text in part.column(1).to_pylist():
            table = own.table(text or "")
            cuts.append([max(i for i, c in enumerate(table) if c <= b) for b in budgets])
            steps.append([b - a for a, b in zip(table, table[1:], strict=False)])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(steps, pa.list_(pa.int16())), pa.array(cuts, pa.list_(pa.int64()))], names=["doc_id", "steps", "cuts"])


def prefix_tables(docs: DataFrame, model_file: str, budgets: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored tables themselves: ``steps[i]`` is count[i + 1] - count[i], and ``cuts`` answers each budget."""
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(partial(_tables, model=model_file, budgets=budgets), "doc_id bigint, steps array<smallint>, cuts array<bigint>")


def count_at(steps: list[int], length: int) -> int:
    """Tokens of the first ``length`` characters from a stored table."""
    return next(iter(list(accumulate(steps[:length], initial=0))[-1:]), 0)
