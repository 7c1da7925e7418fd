"""Text columns: normalisation, control stripping, paragraphs, windows, gates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import kind

# White space other than the line feed, as one class for every engine.
SPACES = r"\t\x0b-\r \x1c-\x1f\x85\xa0  -     　"
# Code points that normalisation deletes.
INVISIBLE = "​‌‍‎‏‮﻿⁠­"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
#: Window length, step, and characters that a window stands for.
WINDOW_TOKENS, WINDOW_STEP, CHARS_PER_TOKEN = 512, 448, 4


@F.pandas_udf(kind("string"))
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which there is no built-in."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def collapse(text: Column) -> Column:
    """Everything of ``normalize`` but the composition, in its order: invisible code
    points, white-space runs, newline runs, line ends, text ends."""
    t = F.translate(text, INVISIBLE, "")
    t = F.regexp_replace(t, f"[{SPACES}]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def normalize(text: Column) -> Column:
    return collapse(nfc(text))


def strip_controls(text: Column) -> Column:
    """Control characters go, and so does the carriage return; tab and line feed stay."""
    return F.regexp_replace(text, CONTROLS, "")


def search_field(text: Column, most: int) -> Column:
    """A plain field of a search result: controls dropped, white space collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(strip_controls(nfc(F.coalesce(text, F.lit("")))), f"[{SPACES}\n]+", " ")), 1, most)


def word_count(text: Column) -> Column:
    """Words of normalised text, in which white space is the space and the line feed."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), "[ \n]+")))


def paragraphs(text: Column) -> Column:
    """Split at blank lines, at single line feeds if that gives one part only."""
    cut = lambda p: F.filter(F.transform(F.split(text, p, -1), lambda x: F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")), lambda x: x != "")
    blank = cut("\n\n+")
    return F.when((F.size(blank) <= 1) & text.contains("\n"), cut("\n")).otherwise(blank)


def window_count(tokens: Column) -> Column:
    """Windows of 512 in steps of 448 that a number of tokens takes."""
    return F.when(tokens <= 0, 0).when(tokens <= WINDOW_TOKENS, 1).otherwise(F.ceil((tokens - WINDOW_TOKENS) / F.lit(WINDOW_STEP)) + 1).cast("int")


def token_windows(text: Column) -> Column:
    """array<struct<start, n>> over white-space tokens."""
    n = F.size(F.filter(F.split(text, r"[ \n]+"), lambda x: x != ""))
    windows = window_count(n)
    starts = F.when(windows > 0, F.transform(F.sequence(F.lit(0), F.greatest(windows - 1, F.lit(0))), lambda k: k * WINDOW_STEP)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(WINDOW_TOKENS), n - s).alias("n")))


def windows_estimate(chars: Column) -> Column:
    """From characters, at 4.5 a token, between 1 and 8."""
    t = F.ceil(chars / 4.5)
    return F.least(F.lit(8), F.greatest(F.lit(1), F.when(t <= 512, 1).otherwise(F.ceil((t - 512) / F.lit(448)) + 1))).cast("int")


def upload_refusal(text: Column) -> Column:
    """Why a text upload is refused: nul, empty, controls; null if it isn't."""
    visible = F.length(F.regexp_replace(text, f"[{SPACES}\n]|{CONTROLS}", ""))
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""))
    return F.when(F.instr(text, "\0") > 0, "nul").when(visible == 0, "empty").when(controls * 20 > F.length(text), "controls")


def upload_bytes_refusal(body: Column) -> Column:
    """The same for bytes, which must be UTF-8."""
    return F.when(~F.is_valid_utf8(body.cast("string")), "encoding").otherwise(upload_refusal(body.cast("string")))


def content_type(header: Column, body: Column) -> Column:
    """PDF by header or magic, else HTML."""
    return F.when(F.lower(F.coalesce(header, F.lit(""))).contains("application/pdf") | F.startswith(body, F.lit("%PDF-")), "pdf").otherwise("html")


def too_long(text: Column, windows: int = 64) -> Column:
    """Whether a text exceeds the characters that so many windows stand for."""
    return F.length(text) > WINDOW_STEP * windows * CHARS_PER_TOKEN


def excerpt(text: Column, cap: int) -> Column:
    """Whole paragraphs from the start up to ``cap`` characters; a first one that is longer is cut.

    Paragraphs stand between lines that are empty or white.
    """
    white = F.lit("".join(c for c in map(chr, range(0x3001)) if c.isspace()))
    blocks = F.filter(F.transform(F.split(text, f"\n[{SPACES}\n]*\n", -1), lambda x: F.btrim(x, white)), lambda x: x != "")
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"), F.lit(0).alias("n"))

    def add(a: Column, p: Column) -> Column:
        size = F.length(a["out"]) + F.when(a["n"] > 0, 2).otherwise(0) + F.length(p)
        first_cut = (a["n"] == 0) & (size > cap)
        out = F.when(a["done"], a["out"]).when(first_cut, F.substring(p, 1, cap)).when(size > cap, a["out"]).when(a["n"] == 0, p).otherwise(F.concat(a["out"], F.lit("\n\n"), p))
        return F.struct(out.alias("out"), (a["done"] | (size > cap)).alias("done"), (a["n"] + 1).alias("n"))

    return F.aggregate(blocks, state, add, lambda a: a["out"])


def alpha_share(text: Column) -> Column:
    """Letters among characters that aren't white space."""
    dense = F.regexp_replace(text, f"[{SPACES}\n]+", "")
    return F.when(F.length(dense) > 0, F.length(F.regexp_replace(dense, r"[^\p{L}]", "")) / F.length(dense)).otherwise(0.0)


#: Common words by which a language is voted for; my own short lists.
COMMON_WORDS = {
    "en": ["the", "and", "of", "to", "in", "that", "with", "for"],
    "fr": ["le", "la", "les", "des", "et", "une", "dans", "pour"],
    "de": ["der", "die", "das", "und", "ein", "mit", "von", "zu"],
    "es": ["el", "los", "las", "que", "del", "por", "con", "una"],
}


def language_votes(text: Column) -> list[Column]:
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    return [F.size(F.array_intersect(words, F.array(*map(F.lit, w)))).alias(k) for k, w in COMMON_WORDS.items()]


def language(votes: dict[str, Column], least: int = 2) -> Column:
    """The first language with most votes, if they are enough; else und."""
    top = F.greatest(*votes.values())
    out = F.when(top < least, "und")
    for name, v in votes.items():
        out = out.when(v == top, name)
    return out


def upload_name(name: Column) -> Column:
    """Base name of an uploaded file: controls dropped, either slash, 255 characters."""
    return F.substring(F.substring_index(F.regexp_replace(strip_controls(name), r"\\", "/"), "/", -1), 1, 255)
