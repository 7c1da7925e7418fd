"""Trust, state, quarantine and summaries of screened documents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import let, rank
from ..functions.text import paragraphs, word_count

# Base score of each tier, penalties, the body of a quarantined document.
TIERS = {"trusted": 0.95, "verified": 0.85, "standard": 0.70, "untrusted": 0.40, "blocked": 0.0}
REDIRECT_PENALTY = -0.1
QUARANTINE_BODY = "Content quarantined due to potential prompt injection."


def trust_score(tier: Column, structural: Column, classifier: Column, domain_changed: Column) -> Column:
    """Base by tier, then the penalties in this order, between 0 and 1."""
    base = F.coalesce(*[F.when(tier == t, F.lit(s)) for t, s in TIERS.items()])
    total = base + structural + classifier + F.when(domain_changed, REDIRECT_PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def unavailable(tier: Column, fail_closed: Column) -> Column:
    """Without a classifier: struct<detected, penalty>."""
    shut = fail_closed & tier.isin("standard", "untrusted")
    return F.struct(shut.alias("detected"), F.when(shut, -0.5).otherwise(-0.1).alias("penalty"))


def classifier_outcome(tier: Column, verdict: Column, scores: Column, fired: Column, fail_closed: Column) -> Column:
    """struct<state, detected, penalty>: a trusted tier and a blocked text are not scored; null scores mean no classifier."""
    none = unavailable(tier, fail_closed)
    state = F.when(tier == "trusted", "skipped_trusted").when(verdict == "blocked", "structural_blocked").when(scores.isNull(), F.when(none["detected"], "unavailable_blocked").otherwise("unavailable_allowed")).otherwise("scanned")
    detected = F.when(state == "scanned", fired).otherwise(state == "unavailable_blocked")
    penalty = F.when(state == "scanned", F.when(fired, -0.5).otherwise(0.0)).when(state.startswith("unavailable"), none["penalty"]).otherwise(0.0)
    return F.struct(state.alias("state"), detected.alias("detected"), penalty.alias("penalty"))


def quarantine(title: Column, body: Column, notice: Column, verdict: Column, state: Column, detected: Column) -> Column:
    """struct<title, body, notice, diagnostic>: blocked or detected content is replaced."""
    label = F.when(verdict == "blocked", "structural_blocked").when(state == "unavailable_blocked", "promptguard_unavailable").when(detected, "injection_detected")
    hit = label.isNotNull()
    return F.struct(F.when(~hit, title).alias("title"), F.when(hit, QUARANTINE_BODY).otherwise(body).alias("body"), F.when(hit, "").otherwise(notice).alias("notice"), label.alias("diagnostic"))


# What keeps a paragraph in a summary, and classes of boilerplate.
KEEP = (
    r"(?U)\d+(\.\d+)?%", r"(?iuU)p\s*[<>=]\s*0\.\d+", r"(?iuU)CI\s*[:=]?\s*[\[\(]", r"(?U)\$[\d,]+(\.\d+)?", r'["“].{10,}?["”]', r"(?iu)according to|et al\.|published in|reported by|study by",
    r"(?Udm)^\s*[-*]\s+|^\s*\d+\.\s+", r"\|.*\|",
)
BOILERPLATE = (
    ("cookie/privacy notices", "(?iu)we use cookies|privacy policy|accept all|cookie settings"),
    ("author bios", "(?iu)about the author|written by .{3,30} is a"),
    ("related content", "(?iu)you may also like|related articles|read more|recommended for you"),
    ("ads/promotions", "(?iu)subscribe now|sign up for|limited time offer|click here"),
)
GENERAL = "general content"


def keeps(paragraph: Column) -> Column:
    return reduce(or_, [paragraph.rlike(p) for p in KEEP])


def boilerplate(paragraph: Column) -> Column:
    return F.coalesce(*[F.when(paragraph.rlike(p), name) for name, p in BOILERPLATE])


def summary(text: Column, fallback: Column) -> Column:
    """struct<paragraphs, kept, summary, classes>: first, last and telling paragraphs stay; of
    the rest the words are counted by class, in the order in which classes come.
    Boilerplate is told apart only in fallback text."""
    return let(paragraphs(F.coalesce(text, F.lit(""))), lambda paras: let(_marked(paras, fallback), _summary))


def _marked(paras: Column, fallback: Column) -> Column:
    """Each paragraph with whether it stays, its class and its words."""
    last = F.size(paras) - 1
    mark = lambda p, i: F.struct(p.alias("p"), ((i == 0) | (i == last) | keeps(p)).alias("keep"), F.coalesce(F.when(fallback, boilerplate(p)), F.lit(GENERAL)).alias("class"), word_count(p).alias("words"))
    return F.transform(paras, mark)


def _summary(marked: Column) -> Column:
    kept = F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: m["p"])
    gone = F.filter(marked, lambda m: ~m["keep"])
    names = F.array_distinct(F.transform(gone, lambda m: m["class"]))
    words = lambda n: F.aggregate(F.filter(gone, lambda m: m["class"] == n), F.lit(0), lambda a, m: a + m["words"])
    classes = F.transform(names, lambda n: F.struct(n.alias("class"), words(n).alias("words")))
    return F.struct(F.size(marked).alias("paragraphs"), kept.alias("kept"), F.array_join(kept, "\n\n").alias("summary"), classes.alias("classes"))


def notice(classes: Column, total_words: Column) -> Column:
    """What a summary left out, or nothing."""
    parts = F.array_join(F.transform(classes, lambda c: F.concat(c["class"], F.lit(" ("), c["words"].cast("string"), F.lit(" words)"))), ", ")
    text = F.concat(F.lit("Content extracted from "), total_words.cast("string"), F.lit(" word page. Summary preserves statistics, quotes, and referenced claims. Omitted: "), parts, F.lit(". Use extract_mode='full' to retrieve complete content."))
    return F.when(F.size(classes) == 0, "").otherwise(text)


def calendar_date(value: Column) -> Column:
    """The value itself if it is a real day written YYYY-MM-DD, else null."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(), value)


def degraded(*reasons: tuple[Column, str]) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in reasons]))


def worse(a: Column, b: Column) -> Column:
    return F.when(rank(b) > rank(a), b).otherwise(a)


def effective_policy(fail_closed: Column, floor: bool, threshold: Column, default: float, ceiling: float) -> Column:
    """A request may only tighten the policy."""
    return F.struct((F.coalesce(fail_closed, F.lit(False)) | F.lit(floor)).alias("fail_closed"), F.least(F.coalesce(threshold, F.lit(default)), F.lit(ceiling)).alias("threshold"))
