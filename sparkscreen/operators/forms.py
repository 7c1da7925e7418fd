"""Forms of a text that are scanned besides the text itself: decoded and folded."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import kind, struct
from .html import normalize_text, parse, raw_text, unescape

# Characters that compatibility composition would turn into something else than they look like.
BEFORE = {
    "\u00b4": "'", "\u00b8": ",", "\u02dc": "~", "\u02dd": "''", "\u0384": "'", "\u03f2": "c", "\u03f9": "C", "\u1dba": "^", "\u1fbd": "'", "\u1fbf": "'", "\u1fc0": "~", "\u1ffe": "'", "\ufe31": "l", "\ufe3f": "^", "\ufe58": "-",
}
# Letters read as Latin ones where Unicode's own table names no Latin letter; they win over that table.
REVIEWED = {
    "к": "k", "т": "t", "п": "n", "П": "n", "м": "m", "и": "n", "И": "n", "н": "h", "д": "g", "Д": "g", "л": "n", "Л": "n",
    "κ": "k", "τ": "t", "η": "n", "μ": "u", "ε": "e", "β": "b", "π": "n", "Π": "n", "χ": "x",
}
#: Look-alikes that compatibility composition leaves: Greek and Cyrillic letters by the Latin ones they look like.
#: A short list; ``sources.tables.fold_table`` reads a full one from Unicode's file, and ``with_table`` takes it.
LOOKALIKES = {
    **dict(zip("АВЕКМНОРСТХІЈЅаеорсухіјѕһԁԛԝ", "ABEKMHOPCTXIJSaeopcyxijshdqw", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp", strict=True)),
    **REVIEWED, "ı": "i", "ɡ": "g", "ⅼ": "l", "∕": "/", "‐": "-", "‑": "-", "–": "-", "❬": "<", "❭": ">", "‹": "<", "›": ">", "ǀ": "l", "Ӏ": "l", "ӏ": "l", "І": "l", "Ι": "l", "∣": "l",
}
#: Sources that may stand for a capital i as well as for a small l: by the rule that the table reads them as l.
AMBIGUOUS_TARGET = "l"


def strip_controls(text: str) -> str:
    return "".join(c for c in text if not (c < "\t" or "\x0b" <= c <= "\x1f" or "\x7f" <= c <= "\x9f"))


def decode(text: str, levels: int) -> str:
    return normalize_text(strip_controls(unescape(text, levels)))


class Fold:
    """Reads look-alikes as Latin letters: ``BEFORE``, composition, then the table, whose entries for ``l`` may also mean ``i``."""

    def __init__(self, table: dict[str, str] = LOOKALIKES):
        self.before = str.maketrans(BEFORE)
        self.as_l = str.maketrans({k: v for k, v in table.items() if not k.isascii()})
        self.ambiguous = {k for k, v in table.items() if v == AMBIGUOUS_TARGET and not k.isascii()}
        self.as_i = self.as_l | dict.fromkeys(map(ord, self.ambiguous), "i")

    def __call__(self, text: str) -> tuple[list[str], bool]:
        """Folded forms that differ from the text, and whether a form grew too long."""
        if text.isascii():
            return [], False
        most = max(2 * len(text), len(text) + 256)
        wide = unicodedata.normalize("NFKC", text.translate(self.before))
        if len(wide) > most:
            return [], True
        read = [wide.translate(self.as_l)]
        if not self.ambiguous.isdisjoint(wide):
            read.append(wide.translate(self.as_i))
        if len(read[0]) > most:
            return [], True
        forms = []
        for got in map(normalize_text, read):
            if got != text and got not in forms:
                forms.append(got)
        return forms, False


fold = Fold()


def scan_forms(text: str, parsed: bool, folded: Fold = fold) -> tuple[list[str], bool]:
    """As it is, decoded once (twice if the text wasn't parsed as HTML), and folded."""
    forms = [text]
    plain = decode(text, 1 if parsed else 2)
    if plain != text:
        forms.append(plain)
    more, refused = folded(plain)
    return forms + [f for f in more if f not in forms], refused


def with_table(table: DataFrame | None, parsed: bool):
    """A column function text → struct<forms, refused> with the look-alikes of a table (source, target).

    The table has a row a code point at most, which bounds what the driver holds.
    """
    own = Fold({**{r["source"]: r["target"] for r in table.select("source", "target").limit(MOST_SOURCES).collect()}, **REVIEWED}) if table is not None else fold

    @F.pandas_udf(struct("forms array<string>, refused boolean"))
    def forms_of(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in text:
            got = [scan_forms(t or "", parsed, own) for t in batch]
            yield pd.DataFrame({"forms": [g[0] for g in got], "refused": [g[1] for g in got]})

    return forms_of


#: Code points there are.
MOST_SOURCES = 0x110000

@F.pandas_udf(struct("forms array<string>, refused boolean"))
def text_forms(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Forms of a text that was not parsed as HTML."""
    for batch in text:
        got = [scan_forms(t or "", False) for t in batch]
        yield pd.DataFrame({"forms": [g[0] for g in got], "refused": [g[1] for g in got]})


@F.pandas_udf(struct("forms array<string>, refused boolean"))
def page_forms(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Forms of a text that an HTML parser has decoded once already."""
    for batch in text:
        got = [scan_forms(t or "", True) for t in batch]
        yield pd.DataFrame({"forms": [g[0] for g in got], "refused": [g[1] for g in got]})


def search_forms(value: str | None, most: int) -> dict:
    """Wire, scan and inline form of a field that may hold markup."""
    from .html import inline_text

    value = value if isinstance(value, str) else ""
    cut = strip_controls(unicodedata.normalize("NFC", value))[: 4 * most]
    root = parse(f"<div>{cut}</div>")
    scan = decode(raw_text(root), 1)[:most]
    return {"wire": " ".join(scan.split()), "scan": scan, "inline": decode(inline_text(root), 1)[:most]}


def _search(most: int):
    @F.pandas_udf(struct("wire string, scan string, inline string"))
    def udf(value: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in value:
            yield pd.DataFrame([search_forms(v, most) for v in batch], columns=["wire", "scan", "inline"])

    return udf


search_title, search_snippet = _search(512), _search(2000)


@F.pandas_udf(kind("array<string>"))
def url_scan_texts(url: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A URL with entities decoded, and that percent-decoded once."""
    for batch in url:
        once = batch.map(lambda u: unescape((u or "").strip(), 1))
        yield once.map(lambda u: [u, unquote(u)])
