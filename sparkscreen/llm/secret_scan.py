"""Secret scans: base patterns, and credentials whose parts stand apart.

Everything is DataFrame and SQL functions.  Base kinds are found by pattern in every
whole text; places come from the lengths of what lies between and inside matches,
in code points, so no function has to search a text again.

Beyond those, parts that alone mean little are gathered as weak candidates: short
access identifiers, short or unnamed secrets, and endpoints (addresses, hosts,
connection strings).  Every link needs a secret, so only texts with one are searched
for the others; texts are read once, and what is found is written out.  Each part has a scope, the
interval of ``SCOPE`` code points around it.  Identifiers and secrets, and secrets and
endpoints, are interval-joined within a document: both sides carry the numbers of
the scope-sized bins that they touch, equal bins join, and the distance decides.
A weak candidate is reported only when a complementary part lies in its scope, as
a span of kind ``linked``.  A document with very many parts joins bin by bin, never all
pairs: of each bin only the first and the last end of each kind are needed to
tell whether anything is near enough, so one row a bin and kind goes into the join.

Defined results: null and empty texts have no spans; overlapping spans of different
kinds all stay; a weak candidate that a base span covers is not reported again;
repeated rows get equal results each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import let
from .shared import Scratch

SCOPE = 240
#: Matches that one fold joins; a text with more is folded in blocks of so many, so its cost stays near its length.
FOLDED = 256
#: Kinds in the order that ties are listed in; the last is what linking adds.
KINDS = ("assign", "access", "hex", "linked")

#: Fixed patterns of the base kinds: pattern, the group whose length counts, least length.
#: A run that the plain patterns of access and hex find is the same that these find with the length in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
BASE = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 1, 18), "hex": (HEX, 1, 16)}

#: Weak parts: role, pattern.  They never are spans by themselves.
WEAK = {
    "id": r"((?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{4,}|(?i:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,})",
    "secret": r"((?i:pass|passwd|password|pwd|secret|secret_?(?:access_?)?key|token|api_?key|auth)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,}|(?i:authorization[\"']?\x20*[:=]\x20*[\"']?(?:basic|bearer)\x20+)[A-Za-z0-9+/_.=-]{4,}|\b[A-Za-z0-9+/]{40}\b)",
    "endpoint": r"((?i:https?|ftp|jdbc:[a-z]+|amqp|redis|mongodb|postgres(?:ql)?)://[^\s\"'<>]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b(?::[0-9]{1,5}\b)?)",
}
#: Roles that complete one another.
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
SPAN = "struct<start:bigint,end:bigint,kind:string>"


SPANS = "array<struct<start:bigint,end:bigint>>"


def matches(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<start, end>> of leftmost non-overlapping matches of which ``group`` has ``least`` code points or more."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    # The n-th match stands behind n pieces and n - 1 matches; the last piece has no match behind it.
    sizes = F.zip_with(F.zip_with(between, whole, lambda b, w: F.struct(F.length(b).alias("gap"), F.length(w).alias("size"))), part, lambda r, p: F.struct(r["gap"].alias("gap"), r["size"].alias("size"), F.length(p).alias("part")))

    def step(acc: Column, r: Column) -> Column:
        begin = acc["at"] + r["gap"]
        end = begin + F.coalesce(r["size"], F.lit(0))
        return F.struct(end.alias("at"), F.when(r["part"] >= least, F.concat(acc["found"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["found"]).alias("found"))

    def folded(rows: Column, at: Column) -> Column:
        start = F.struct(at.cast("bigint").alias("at"), F.array().cast(SPANS).alias("found"))
        return F.aggregate(rows, start, step, lambda acc: acc["found"])

    def in_blocks(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(FOLDED)), lambda k: F.slice(rows, k, FOLDED))
        lengths = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, r: a + r["gap"] + F.coalesce(r["size"], F.lit(0))))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, let(lengths, _before), folded)))

    return let(sizes, lambda rows: F.when(F.size(rows) <= FOLDED, folded(rows, F.lit(0))).otherwise(in_blocks(rows)))


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, start, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"])


def _when_any(text: Column, pattern: str, found: Column) -> Column:
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _tagged(found: Column, kind: str, name: str = "kind") -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias(name)))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, joined by commas."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind>> of the base kinds."""
    return F.concat(*[_tagged(_when_any(text, pattern, matches(text, pattern, group, least)), kind) for kind, (pattern, group, least) in BASE.items()])


def linked_parts(candidates: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """Interval join of weak parts: rows (key, start, end, role) that have a complementary part within ``scope``.

    candidates: the same columns, distinct.  Two parts are near when the gap between
    them is ``scope`` at most; a part and one that overlaps it have no gap.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(scope)).cast("bigint")
    parts = candidates.withColumn("first_bin", bin_of("start")).withColumn("last_bin", bin_of("end"))
    # What a bin offers to others: of the parts of a role that begin in it, the outermost places are
    # enough for parts of other bins; parts of the same bin are near in any case.
    touching = parts.select(*key, "role", "start", "end", F.explode(F.sequence("first_bin", "last_bin")).alias("bin"))
    offers = touching.groupBy(*key, "role", "bin").agg(F.min("start").alias("least_start"), F.max("end").alias("greatest_end"))
    wanted = F.create_map(*[x for r, c in COMPLEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    asking = parts.select(*key, "role", "start", "end", "first_bin", "last_bin", F.explode(wanted[F.col("role")]).alias("other"))
    asks = asking.select(*key, "role", "start", "end", "other", F.explode(F.sequence(F.col("first_bin") - 1, F.col("last_bin") + 1)).alias("bin"))
    there = offers.select(*key, F.col("role").alias("other"), "bin", "least_start", "greatest_end")
    near = asks.join(there, [*key, "other", "bin"]).where((F.col("least_start") - F.col("end") <= scope) & (F.col("start") - F.col("greatest_end") <= scope))
    return near.select(*key, "role", "start", "end").distinct()


def text_key(text: Column) -> Column:
    """What tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit(""))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, content (a key of the text), ``base`` (array of spans) and ``weak`` (array of parts; empty without a secret)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weak = F.concat(*[_tagged(_when_any(text, p, matches(text, p)), role, "role") for role, p in WEAK.items()])
    none = F.array().cast("array<struct<start:bigint,end:bigint,role:string>>")
    return rows.select("doc_id", text_key(text).alias("content"), base_spans(text).alias("base"), F.when(text.rlike(WEAK["secret"]), weak).otherwise(none).alias("weak"))


def with_links(docs: DataFrame, scratch: Scratch, scope: int = SCOPE) -> DataFrame:
    """One row a document: doc_id, own (doc_id, or a number for null), content, ``base``, and ``spans``, the base spans and what linking finds.

    Documents are told apart by id and content, so repeated rows share one result.
    """
    found = scratch.stage(scan(docs).withColumn("own", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))), "found")
    roles = F.transform("weak", lambda w: w["role"])
    # Documents with one role only have nothing to link.
    some = found.where(F.size(F.array_distinct(roles)) > 1).select("own", "content", F.explode("weak").alias("w")).select("own", "content", "w.*").distinct()
    linked = linked_parts(scratch.stage(some, "parts"), ["own", "content"], scope)
    grouped = scratch.stage(linked.groupBy("own", "content").agg(F.collect_set(F.struct("start", "end", F.lit("linked").alias("kind"))).alias("linked")), "linked")
    joined = found.select("doc_id", "own", "content", "base").join(grouped, ["own", "content"], "left")
    fresh = F.filter(F.coalesce("linked", F.array().cast(f"array<{SPAN}>")), lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return joined.select("doc_id", "own", "content", "base", F.concat("base", fresh).alias("spans"))


def secret_digests(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row a document: counts, digest of the base spans, and all spans as text."""
    scratch = Scratch(docs.sparkSession)
    all_spans = with_links(docs, scratch, scope)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return all_spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows with all columns, secrets in ``text`` replaced; a null text stays null."""
    scratch = Scratch(docs.sparkSession)
    found = with_links(docs, scratch, scope).where(F.size("spans") > 0).select("own", "content", "spans").dropDuplicates(["own", "content"])
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__own", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("__content", text_key(text))
    spans = scratch.stage(found, "spans").select(F.col("own").alias("__own"), F.col("content").alias("__content"), F.col("spans").alias("__spans"))
    scratch.forget("found", "parts", "linked")
    joined = keyed.join(spans, ["__own", "__content"], "left")
    new = F.when(F.col("__spans").isNotNull(), redacted(text, F.col("__spans"))).otherwise(text)
    return joined.select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns])
