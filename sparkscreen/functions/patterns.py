"""The structural pattern registry, and what follows from its matches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES

_WS = f"[{SPACES}\\n]"
BLOCKING = ("instruction_override", "authority_impersonation", "prompt_boundary")
SUSPICIOUS = ("encoded_payload", "suspicious_url", "exfil_beacon", "envelope_breakout")


@dataclass(frozen=True)
class Pattern:
    index: int
    name: str
    category: str
    java: str
    probe: str


def _p(body: str, flags: str = "iuUd") -> str:
    return (f"(?{flags})" if flags else "") + body.replace("~", _WS)


# The registry in its order, as name, category, pattern and a text that fires it.
# ``~`` stands for the white-space class; line starts follow the line feed only.
REGISTRY = tuple(
    Pattern(i, *row)
    for i, row in enumerate([
        ("ignore_previous", "instruction_override", _p("ignore~+(all~+)?(previous|prior|above)"), "ignore previous"),
        ("disregard_instructions", "instruction_override", _p(r"disregard(?:(?!disregard|\n\n)[\s\S])*?instructions"), "disregard the instructions"),
        ("new_directive", "instruction_override", _p("new~+(directive|instruction|task|objective)"), "new directive"),
        ("system_bracket", "instruction_override", _p(r"\[SYSTEM\]"), "[SYSTEM]"),
        ("system_tag", "instruction_override", _p(r"<~*(?:/~*)?system\b[^<>]*>"), "<system>"),
        ("instructions_banner", "instruction_override", _p("---INSTRUCTIONS---"), "---INSTRUCTIONS---"),
        ("admin_bracket", "authority_impersonation", _p(r"\[admin\]"), "[admin]"),
        ("consumer_bracket", "authority_impersonation", _p(r"\[poppy\]"), "[poppy]"),
        ("assistant_line", "authority_impersonation", _p("^assistant:", "iuUdm"), "assistant:"),
        ("consumer_line", "authority_impersonation", _p("^POPPY:", "iuUdm"), "POPPY:"),
        ("system_line", "authority_impersonation", _p("^System:", "iuUdm"), "System:"),
        ("elevated_user", "authority_impersonation", _p("user~+with~+elevated"), "user with elevated"),
        ("base64_run", "encoded_payload", _p("[A-Za-z0-9+/]{40,}={0,2}", ""), "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZn"),
        ("rot13", "encoded_payload", _p("rot13"), "rot13"),
        ("hex_escape", "encoded_payload", _p(r"(?:\\x[0-9a-fA-F]{2}){4,}"), "\\x41\\x42\\x43\\x44"),
        ("system_fence", "prompt_boundary", _p("```system"), "```system"),
        ("instructions_fence", "prompt_boundary", _p("```instructions"), "```instructions"),
        ("im_start", "prompt_boundary", _p(r"<\|im_start\|>"), "<|im_start|>"),
        ("endoftext", "prompt_boundary", _p(r"<\|endoftext\|>"), "<|endoftext|>"),
        ("data_uri", "suspicious_url", _p("data:(?:text|image|application|audio|video|font)/"), "data:text/"),
        ("javascript_scheme", "suspicious_url", _p("javascript:"), "javascript:"),
        ("private_ip_href", "suspicious_url", _p(r"""(?:href|src)~*=~*["']?https?://(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})"""), 'href="http://10.0.0.1'),
        ("exfil_image", "exfil_beacon", _p(r"!\[(?:(?!!\[)[^\]])*\]\(https?://(?:(?!!\[)[^)])*?(?:\{\{|\$\{|%7[Bb])"), "![x](https://a.example/{{s}})"),
        ("envelope_breakout", "envelope_breakout", _p(r"(?:<|&lt;?|&#0*60;?|&#x0*3c;?)~*(?:/~*)?(?:retrieved_content|retrieval_note|retrieval_warning|retrieval_cache_note)\b"), "</retrieved_content>"),
    ])
)
MARKUP = tuple(REGISTRY[i] for i in (4, 21, 23))
#: What a text must hold, in lower case, for a pattern to have a match: one of each group.  Looking for these is much
#: cheaper than the patterns, and most texts hold none.
SIGNS = {
    0: [("ignore",)], 1: [("disregard",), ("instructions",)], 2: [("new",), ("directive", "instruction", "task", "objective")], 3: [("[system]",)], 4: [("system",), ("<",), (">",)], 5: [("---instructions---",)],
    6: [("[admin]",)], 7: [("[poppy]",)], 8: [("assistant:",)], 9: [("poppy:",)], 10: [("system:",)], 11: [("elevated",)], 12: [], 13: [("rot13",)], 14: [("\\x",)], 15: [("```system",)], 16: [("```instructions",)],
    17: [("<|im_start|>",)], 18: [("<|endoftext|>",)], 19: [("data:",)], 20: [("javascript:",)], 21: [("://",), ("href", "src")], 22: [("![",), ("{", "%7b")], 23: [("retrieved_content", "retrieval_")],
}
#: Beyond lower-casing, the characters that patterns of either case take for a Latin letter.
_CASED, _PLAIN = "ſıİK", "siik"

# Secret shapes.
SECRET_SHAPES = {
    "model_hub": "hf_[A-Za-z0-9]{20,}",
    "code_host_classic": "ghp_[A-Za-z0-9]{20,}",
    "code_host_fine": "github_pat_[A-Za-z0-9_]{20,}",
    "sk_plain": "sk-[A-Za-z0-9]{20,}",
    "sk_vendor": "sk-ant-[A-Za-z0-9_-]{20,}",
    "cloud_key": "AKIA[0-9A-Z]{16}",
    "chat_token": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assignment": r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}",
}

FLAG = "struct<category:string,matched:string,line:int>"
SCAN = f"struct<verdict:string,penalty:double,flags:array<{FLAG}>>"


def folded(text: Column) -> Column:
    """The text as the signs are looked for in it."""
    return F.lower(F.translate(text, _CASED, _PLAIN))


def may_match(low: Column, p: Pattern) -> Column:
    """Whether the folded text holds the signs of a pattern."""
    return reduce(and_, [reduce(or_, [F.contains(low, F.lit(sign)) for sign in group]) for group in SIGNS[p.index]], F.lit(True))


def hits(text: Column, low: Column | None = None) -> list[Column]:
    """Number of matches of each pattern; ``low``: the folded text, if it is at hand."""
    low = folded(text) if low is None else low
    return [F.when(may_match(low, p), F.regexp_count(text, F.lit(p.java))).when(text.isNotNull(), 0).alias(p.name) for p in REGISTRY]


def _lines(text: Column, pattern: str) -> Column:
    """1-based line of each match: line feeds between matches and inside them."""
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
    gaps = F.transform(F.split(text, pattern, -1), feeds)
    inside = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), feeds)
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        line = a["line"] + r["gap"]
        return F.struct((line + F.coalesce(r["own"], F.lit(0))).alias("line"), F.when(r["own"].isNotNull(), F.concat(a["out"], F.array(line))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.zip_with(gaps, inside, lambda g, o: F.struct(g.alias("gap"), o.alias("own"))), start, step, lambda a: a["out"])


def flags(text: Column) -> Column:
    """All matches of all patterns, in the registry's order and then by place."""
    return let(F.struct(text.alias("text"), folded(text).alias("low")), lambda x: _flags(x["text"], x["low"]))


def _flags(text: Column, low: Column) -> Column:
    none = F.array().cast(f"array<{FLAG}>")
    each = []
    for p in REGISTRY:
        found = F.regexp_extract_all(text, F.lit(p.java), F.lit(0))
        rows = F.transform(F.arrays_zip(found.alias("m"), _lines(text, p.java).alias("n")), _flag(p.category))
        each.append(F.when(may_match(low, p) & text.rlike(p.java), rows).otherwise(none))
    return F.concat(*each)


def _flag(category: str):
    return lambda z: F.struct(F.lit(category).alias("category"), z["m"].alias("matched"), z["n"].alias("line"))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def verdict_of(flagged: Column) -> Column:
    """clean, suspicious or blocked, and the penalty: every suspicious flag counts."""
    return let(flagged, _verdict)


def _verdict(flagged: Column) -> Column:
    blocked = F.exists(flagged, lambda f: f["category"].isin(*BLOCKING))
    n = F.size(F.filter(flagged, lambda f: f["category"].isin(*SUSPICIOUS)))
    verdict = F.when(F.size(flagged) == 0, "clean").when(blocked, "blocked").otherwise("suspicious")
    penalty = F.when(blocked | (F.size(flagged) == 0), 0.0).otherwise(F.greatest(F.lit(-0.45), F.lit(-0.15) * n))
    return F.struct(verdict.alias("verdict"), penalty.alias("penalty"), flagged.alias("flags"))


def scan(text: Column) -> Column:
    """Scan one text; null scans as empty."""
    return verdict_of(flags(F.coalesce(text, F.lit(""))))


def verdict_from_counts(blocked: Column, suspicious: Column) -> Column:
    """The verdict alone, from numbers of matches."""
    return F.when(blocked > 0, "blocked").when(suspicious > 0, "suspicious").otherwise("clean")


def rank(verdict: Column) -> Column:
    return F.when(verdict == "blocked", 2).when(verdict == "suspicious", 1).otherwise(0)


def combine(*scans: Column) -> Column:
    """The worst verdict; of equals the first keeps its flags and penalty."""
    start = verdict_of(F.array().cast(f"array<{FLAG}>"))
    return F.aggregate(F.array(*scans), start, _worse) if scans else start


def _worse(a: Column, b: Column) -> Column:
    return F.when(rank(b["verdict"]) > rank(a["verdict"]), b).otherwise(a)


def scan_markup(html: Column) -> Column:
    """First match of three patterns in raw markup, on line 0."""
    flat = F.regexp_replace(F.coalesce(html, F.lit("")), f"[{SPACES}\n]+", " ")
    found = F.array_compact(F.array(*[F.when(flat.rlike(p.java), F.struct(F.lit(p.category).alias("category"), F.regexp_substr(flat, F.lit(p.java)).alias("matched"), F.lit(0).alias("line"))) for p in MARKUP]))
    return verdict_of(found)


def refused_flag() -> Column:
    """What a text is flagged with whose folded forms grow too long."""
    return F.struct(F.lit("encoded_payload").alias("category"), F.lit("fold expansion").alias("matched"), F.lit(0).alias("line"))


def scan_forms(forms: Column, refused: Column) -> Column:
    """Scan an array of forms; a refused fold is blocked and adds a flag."""
    each = F.transform(forms, scan)
    start = verdict_of(F.array().cast(f"array<{FLAG}>"))
    best = F.aggregate(each, start, _worse)
    closed = lambda s: F.struct(F.lit("blocked").alias("verdict"), F.lit(0.0).alias("penalty"), F.concat(s["flags"], F.array(refused_flag())).alias("flags"))
    return let(best, lambda s: F.when(refused, closed(s)).otherwise(s))


def ingest_category(flagged: Column) -> Column:
    return F.coalesce(F.get(flagged, F.lit(0))["category"], F.lit("natural_language"))


def has_secret_shape(text: Column) -> Column:
    return reduce(or_, [text.rlike(p) for p in SECRET_SHAPES.values()])
