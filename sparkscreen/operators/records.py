"""Rules that every record of the labelled corpus keeps, as boolean columns.

A record has the columns id, kind, category, surface, payload, marker, pinned,
pinned_reason, source, lang, params (maps and arrays as ``sources.tables.CORPUS`` has
them) and ``keys``, the names of its fields in the order of its line.  A missing
map or field counts as empty.
"""

from __future__ import annotations

import html
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns, text
from ..functions.kinds import kind, struct
from ..functions.patterns import SECRET_SHAPES
from . import forms
from .html import normalize_text, parse, raw_text

# The vocabulary of records.
PREFIXES = {"attack": "atk", "benign": "ben"}
CATEGORIES = {
    "attack": (
        "instruction_override", "authority_impersonation", "prompt_boundary", "encoded_payload", "suspicious_url", "exfil_beacon", "envelope_breakout", "line_anchored_role", "url_borne_envelope", "natural_language",
        "authority_seo", "hidden_markup", "boundary_straddle", "density_thinned", "repetition_camouflage", "sustained_midband",
    ),
    "benign": ("news", "docs", "forum", "ecommerce", "code", "security_prose", "multilingual", "long_form", "over_defence_probe"),
}
WINDOW_FAMILIES = ("boundary_straddle", "density_thinned", "repetition_camouflage", "sustained_midband")
PAYLOAD = {"search": (("title", "url", "content"), ("engine", "content_kind")), "page": (("url", "title", "head_html", "body_html"), ()), "text": (("filename", "text"), ())}
CONTENT_KINDS = ("snippet", "chunk")
KEYS = ("id", "kind", "category", "surface", "payload", "marker", "pinned", "pinned_reason", "source", "lang", "params", "notes")
REQUIRED = ("id", "kind", "category", "surface", "payload", "source", "lang")
PINNED = ("blocked", "flagged", "neutralised", "clean")
MARKER_LEAST = 12
SOURCE_KEYS = ("kind", "name", "url", "licence", "revision", "record_ref", "framing")
SOURCE_KINDS, FRAMINGS = ("synthetic", "owned", "third_party"), ("indirect", "rehomed_direct")
LICENCES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0", "PSF-2.0", "Unlicense", "LicenseRef-PublicDomain")
PARAM_KEYS = ("density", "placement", "repeat", "carrier", "windows_min", "variant", "url_exception")
ATTACK_VARIANTS = ("plain", "case", "entity", "zwsp", "split_tags", "confusable", "second_paragraph", "url_query", "url_path", "title_field")
CARRIERS = ("jsonld", "meta_description", "og_description", "css_offscreen", "hidden_div", "html_comment", "alt_text", "title_stuffing")
URL_EXCEPTIONS = ("scheme", "private_ip", "ipv6_zone")
RESERVED_DOMAINS, RESERVED_TLDS = ("example.com", "example.net", "example.org"), ("example", "test", "invalid")
SCHEMES = ("data", "javascript")
SEARCH_CAPS = {"title": 512, "url": 2048, "content": 2000}
PAGE_BYTES, TEXT_CHARACTERS = 200_000, 114_688
LANG = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*\z"
FAKE_KEY = r"FAKEKEY-[A-Za-z0-9_\-]{9,}"
URL_ATTRIBUTE = r"""(?i)\b(?:href|src|content)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


@F.pandas_udf(kind("string"))
def casefolded(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(lambda x: None if x is None else x.casefold())


def leak_form(value: Column) -> Column:
    """The form in which markers are looked for."""
    return casefolded(text.normalize(value))


def _of(column: str, key: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(key))


def _held(column: str, key: str) -> Column:
    return F.coalesce(_of(column, key), F.lit(""))


def _escape(value: Column) -> Column:
    """HTML escaping of text and of both quotes."""
    return reduce(lambda v, swap: F.replace(v, F.lit(swap[0]), F.lit(swap[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), value)


def page_document() -> Column:
    """The document that a page record stands for."""
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>"), _escape(_held("payload", "title")), F.lit("</title>"), _held("payload", "head_html"), F.lit("</head><body>"), _held("payload", "body_html"), F.lit("</body></html>"))


def _subset(column: Column, allowed: tuple[str, ...]) -> Column:
    return F.forall(column, lambda k: k.isin(*allowed))


def _by_kind(choices: dict[str, tuple[str, ...]], value: Column) -> Column:
    return reduce(or_, [(F.col("kind") == k) & value.isin(*v) for k, v in choices.items()])


def _urls() -> Column:
    """Addresses of a record: its own, and those of attributes that name a scheme or a host."""
    of = lambda field: F.zip_with(F.zip_with(*[F.regexp_extract_all(_held("payload", field), F.lit(URL_ATTRIBUTE), F.lit(k)) for k in (1, 2)], lambda a, b: F.concat(a, b)), F.regexp_extract_all(_held("payload", field), F.lit(URL_ATTRIBUTE), F.lit(3)), lambda a, b: F.trim(F.concat(a, b)))
    told = lambda u: u.contains("://") | u.startswith("//") | F.lower(u).rlike("^(?:" + "|".join(SCHEMES) + "):")
    own = F.when(_of("payload", "url").isNotNull(), F.array(_of("payload", "url"))).otherwise(F.array().cast("array<string>"))
    return F.concat(own, F.filter(F.concat(of("head_html"), of("body_html")), told))


def _url_allowed(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    # What stands between // and the path, without user and port; addresses of six in brackets.
    place = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r"^\[|\]$", ""), r"\.+$", ""))
    allowed = _held("params", "url_exception")
    four = host.rlike(r"^(?:10(?:\.[0-9]{1,3}){3}|192\.168(?:\.[0-9]{1,3}){2}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.[0-9]{1,3}){2})$")
    six = place.startswith("[") & host.rlike(r"^(?:fe[89ab][0-9a-f]:|2001:0?db8:)")
    names = reduce(or_, [(host == d) | host.endswith("." + d) for d in RESERVED_DOMAINS])
    reserved = names | F.element_at(F.split(host, r"\."), -1).isin(*RESERVED_TLDS)
    return F.when(scheme.isin(*SCHEMES), allowed == "scheme").when(host == "", False).when(four, allowed == "private_ip").when(six, allowed == "ipv6_zone").otherwise(reserved)


#: Rules on what ``read_texts`` finds; the others need the record alone.
LATE = ("marker_in_payload", "sweep_stage2_clean")


def rules() -> dict[str, Column]:
    """Name and condition of each rule; a record passes where it holds."""
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    names = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    values = lambda c: F.coalesce(F.map_values(c), F.array().cast("array<string>"))
    places = F.transform(keys, lambda k: F.array_position(F.array(*map(F.lit, KEYS)), k))
    attack, pinned = F.col("kind") == "attack", F.col("pinned")
    marker = F.col("marker")
    payload = reduce(or_, [(F.col("surface") == s) & reduce(and_, [F.array_contains(names("payload"), k) for k in need]) & _subset(names("payload"), need + more) for s, (need, more) in PAYLOAD.items()])
    strings = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in ("id", "marker", "pinned_reason", "notes")]), values("payload"), values("source"))
    secret = lambda s: reduce(or_, [s.rlike(p) for p in [*SECRET_SHAPES.values(), FAKE_KEY]])
    size = F.when(F.col("surface") == "search", reduce(and_, [F.length(_held("payload", f)) <= n for f, n in SEARCH_CAPS.items()]))
    size = size.when(F.col("surface") == "page", F.octet_length(page_document()) <= PAGE_BYTES).when(F.col("surface") == "text", F.length(_held("payload", "text")) <= TEXT_CHARACTERS).otherwise(True)
    third = _held("source", "licence").isin(*LICENCES) & (_held("source", "revision") != "")
    no = lambda c, k: _of(c, k).isNull()
    return {
        "key_order": F.forall(places, lambda p: p > 0) & (F.array_sort(F.array_distinct(places)) == places) & reduce(and_, [F.array_contains(keys, k) for k in REQUIRED]),
        "id_prefix": reduce(or_, [(F.col("kind") == k) & F.col("id").rlike(f"^{p}-[0-9]{{4}}\\z") for k, p in PREFIXES.items()]),
        "category": _by_kind(CATEGORIES, F.col("category")),
        "payload_keys": payload & (no("payload", "content_kind") | _of("payload", "content_kind").isin(*CONTENT_KINDS)),
        "marker_iff_attack": F.when(attack, marker.isNotNull() & (F.length(marker) >= MARKER_LEAST) & ~marker.rlike("[\n\r]")).otherwise(marker.isNull()),
        "marker_in_payload": F.col("shown"),
        "pinned": pinned.isNull() | ((F.size(pinned) > 0) & (F.size(F.array_distinct(pinned)) == F.size(pinned)) & _subset(pinned, PINNED)),
        "pinned_reason": F.when(pinned.isNull(), F.col("pinned_reason").isNull()).otherwise(F.coalesce(F.trim("pinned_reason"), F.lit("")) != ""),
        "reserved_urls": F.forall(F.col("urls"), _url_allowed),
        "secret_shapes": ~F.exists(strings, secret),
        "sizes": size,
        "lang": F.col("lang").rlike(LANG),
        "source": _subset(names("source"), SOURCE_KEYS) & _of("source", "kind").isin(*SOURCE_KINDS) & (no("source", "framing") | _of("source", "framing").isin(*FRAMINGS)) & ((_of("source", "kind") != "third_party") | third),
        "params_keys": (F.size(names("params")) == 0) | (F.col("category").isin(*[c for v in CATEGORIES.values() for c in v]) & _subset(names("params"), PARAM_KEYS)),
        "params_values": (no("params", "variant") | _by_kind({"attack": ATTACK_VARIANTS, "benign": tuple(p.name for p in patterns.REGISTRY)}, _of("params", "variant"))) & (no("params", "carrier") | _of("params", "carrier").isin(*CARRIERS)) & (no("params", "url_exception") | _of("params", "url_exception").isin(*URL_EXCEPTIONS)),
        "sweep_stage2_clean": ~F.col("category").isin(*WINDOW_FAMILIES) | (F.col("surface").isin("page", "text") & ~F.col("scanned.refused") & (F.col("verdict") == "clean")),
    }


def _leak_form(value: str) -> str:
    """``leak_form`` for one string."""
    return normalize_text(value).casefold()


def is_shown(marker: str, joined: str, page: str | None) -> bool:
    """Whether the fields hold the marker, as they are, with entities decoded or as a page's text; ``page``: that text."""
    needle = _leak_form(marker)
    if not needle:
        return False
    return needle in _leak_form(joined) or "&" in joined and needle in _leak_form(html.unescape(joined)) or page is not None and needle in _leak_form(page)


def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns marker, joined, page and text, the last four columns, into ``shown``, ``forms`` and ``refused``: texts come
    in once and one at a time, and only forms that are scanned, those of the window families, go out."""
    for batch in batches:
        *kept, markers, joined, pages, texts = batch.columns
        out = []
        for columns in zip(batch.column("category"), markers, joined, pages, texts, strict=True):
            category, marker, whole, page, text = (c.as_py() for c in columns)
            page = None if page is None else raw_text(parse(page))
            own = page if text is None else text
            scanned = forms.scan_forms(own, text is None) if category in WINDOW_FAMILIES and own is not None else (None, None)
            out.append((marker is None or is_shown(marker, whole, page), *scanned))
        found = zip(*out, strict=True) if out else ((), (), ())
        made = [pa.array(list(v), t) for v, t in zip(found, (pa.bool_(), pa.list_(pa.string()), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[: len(kept)], "shown", "forms", "refused"])


def _broken(names: Iterable[str]) -> Column:
    own = rules()
    return F.array_compact(F.array(*[F.when(~F.coalesce(own[name], F.lit(False)), name) for name in names]))


def lint(records: DataFrame) -> DataFrame:
    """(id, rule) for every rule that a record breaks, and ``unique_ids`` for ids that occur twice.

    A condition that can't be told, as of a missing field, counts as broken.
    """
    # One text of all fields; a marker has no zero byte, so it can't be found across them.
    joined = F.array_join(F.coalesce(F.map_values("payload"), F.array().cast("array<string>")), "\n\x00\n")
    family, page = F.col("category").isin(*WINDOW_FAMILIES), F.col("surface") == "page"
    early = [name for name in rules() if name not in LATE]
    plain = records.withColumn("urls", _urls()).select(
        "id", "category", "surface", _broken(early).alias("broken"), "marker", F.when(F.col("marker").isNotNull(), joined).alias("joined"),
        F.when(page & (family | F.col("marker").isNotNull()), page_document()).alias("page"), F.when(family & (F.col("surface") == "text"), _held("payload", "text")).alias("text"),
    )
    kept = [plain.schema[c] for c in ("id", "category", "surface", "broken")]
    read = plain.mapInArrow(read_texts, T.StructType([*kept, *struct("shown boolean, forms array<string>, refused boolean")]))
    shown = read.withColumn("scanned", F.struct("forms", "refused")).withColumn("verdict", patterns.scan_forms(F.col("scanned.forms"), F.col("scanned.refused"))["verdict"])
    each = shown.select("id", F.explode(F.concat("broken", _broken(LATE))).alias("rule"))
    twice = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("unique_ids").alias("rule"))
    return each.unionByName(twice)
