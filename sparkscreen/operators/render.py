"""Pages, wire rows and report tables, put together from columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What HTML escaping replaces, in this order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
# Payloads by kind of record, with places for the parts that ``payload`` fills in.
PAYLOADS = {
    "forum_post": {"url": "{url}", "title": "Community forum thread", "head_html": "", "body_html": '<h1>Community forum thread</h1><article class="post"><p>Posted by a community member.</p>{heading}{paragraphs}</article>'},
    "article_page": {"url": "{url}", "title": "Travel and account notes", "head_html": "", "body_html": "<h1>Travel and account notes</h1><article>{paragraphs}</article>"},
    "search_snippet": {"title": "Customer notes and reviews", "url": "{url}", "content": "{text}", "engine": "example", "content_kind": "snippet"},
    "benign_page": {"url": "{url}", "title": "{title}", "head_html": "", "body_html": "<article><h1>{escaped}</h1>{paragraphs}</article>"},
    "benign_search": {"title": "{title}", "url": "{url}", "content": "{text}"},
    "question_page": {"url": "{url}", "title": "Community question", "head_html": "", "body_html": '<article class="question"><h1>Community question</h1><p>Asked by a community member.</p>{paragraphs}</article>'},
    "question_search": {"title": "Community question and answers", "url": "{url}", "content": "{text}", "engine": "example", "content_kind": "snippet"},
    "text_upload": {"filename": "{title}", "text": "{text}"},
}
# Fields of the answers to a retrieval and to an upload, in order.
RETRIEVED = (
    "request_id", "source_url", "final_url", "cache_hit", "cached_at", "title", "body", "word_count", "content_type", "trust_score", "trust_tier", "injection_detected", "injection_spans", "structural_flags",
    "stage2_verdict", "stage3_verdict", "promptguard_state", "domain", "redirect_chain", "domain_changed_on_redirect", "truncation_notice",
)
EXTRACTED = (
    "request_id", "title", "body", "word_count", "content_type", "trust_score", "trust_tier", "injection_detected", "injection_spans", "structural_flags", "stage2_verdict", "stage3_verdict", "promptguard_state",
    "provenance", "truncation_notice", "sanitizer_revision",
)
MISSING = "—"
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def escape(text: Column) -> Column:
    return reduce(lambda t, swap: F.replace(t, F.lit(swap[0]), F.lit(swap[1])), ESCAPES, text)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines as paragraphs, their lines parted by breaks."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n", -1), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<p>"), F.regexp_replace(escape(b), _BREAKS, "<br>"), F.lit("</p>"))), "")


def payload(kind: str, url: Column, title: Column, text: Column) -> Column:
    """map<string,string>: the payload of a kind of record."""
    heading = F.when(F.trim(title) != "", F.concat(F.lit("<h2>"), escape(title), F.lit("</h2>"))).otherwise("")
    parts = {"url": url, "title": title, "escaped": escape(title), "heading": heading, "paragraphs": paragraphs(text), "text": text}

    def filled(template: str) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            pieces += [F.lit(before), parts[name]]
        return F.concat(*pieces, F.lit(rest))

    return F.create_map(*[x for field, template in PAYLOADS[kind].items() for x in (F.lit(field), filled(template))])


def wire_rows(rows: DataFrame, fields: tuple[str, ...] = RETRIEVED) -> DataFrame:
    """The rows of an answer: its fields in order, null where a column lacks."""
    return rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])


def report_value(value: Column, kind: str) -> Column:
    """A value as a report writes it: four places, a dash for what is missing."""
    text = F.format_string("%.4f", F.bround(value, 4)) if kind in ("double", "float") else value.cast("string")
    return F.when(value.isNull(), MISSING).otherwise(text)


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line, text) of a Markdown table; a report's rows are few, so their order is one window."""
    kinds = dict(rows.dtypes)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[report_value(F.col(c), kinds[c]) for c in columns]), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 2).cast("bigint").alias("line"), line.alias("text"))
    head = rows.sparkSession.range(1, 3).select(F.col("id").alias("line"), F.when(F.col("id") == 1, "| " + " | ".join(columns) + " |").otherwise("|" + "---|" * len(columns)).alias("text"))
    return head.unionByName(body)


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON with sorted keys and numbers of four places."""
    kinds = dict(rows.dtypes)
    fields = [(F.round(F.col(c), 4) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in sorted(rows.columns)]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
