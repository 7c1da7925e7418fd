"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import BLOCKING, REGISTRY, SUSPICIOUS
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def planted_text(text: Column, doc_id: Column) -> Column:
    """A text with the probe of the pattern that its id chooses, on a line of its own."""
    out = F.when(F.lit(False), text)
    for p in REGISTRY:
        out = out.when(doc_id % 48 == p.index, F.concat(text, F.lit("\n" + p.probe)))
    return out.otherwise(text)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", planted_text(F.col("text"), F.col("doc_id")).alias("text"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pattern(index: int) -> str:
    """A pattern in the SQL engine's dialect: no look-around, equal on these tables."""
    special = {1: r"(?i)disregard[^\n]*?instructions", 22: r"(?i)!\[[^\]]*\]\(https?://[^)]*?(?:\{\{|\$\{|%7[Bb])"}
    if index in special:
        return special[index]
    java = REGISTRY[index].java
    from ..functions.text import SPACES

    return java.replace("(?iuUdm)", "(?im)").replace("(?iuUd)", "(?i)").replace(f"[{SPACES}\\n]", r"\s")


PLANTED = (
    "planted AS (SELECT doc_id, source, lang, CASE doc_id % 48 " + " ".join(f"WHEN {p.index} THEN text || chr(10) || {quoted(p.probe)}" for p in REGISTRY) + " ELSE text END AS text FROM documents)"
)
COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, {quoted(sql_pattern(p.index))})) AS BIGINT) AS {p.name}" for p in REGISTRY)


def sql_sum(categories: tuple[str, ...]) -> str:
    return " + ".join(p.name for p in REGISTRY if p.category in categories)


#: CTEs up to ``verdicts``: doc_id, source, lang, nb and ns (blocking and suspicious matches), verdict, penalty.
VERDICTS = (
    f"{PLANTED}, counted AS (SELECT doc_id, source, lang, {COUNTS} FROM planted), "
    f"summed AS (SELECT doc_id, source, lang, {sql_sum(BLOCKING)} AS nb, {sql_sum(SUSPICIOUS)} AS ns FROM counted), "
    "verdicts AS (SELECT *, CASE WHEN nb > 0 THEN 'blocked' WHEN ns > 0 THEN 'suspicious' ELSE 'clean' END AS verdict, "
    "CASE WHEN nb > 0 OR ns = 0 THEN 0.0::DOUBLE ELSE greatest(-0.45::DOUBLE, -0.15::DOUBLE * ns) END AS penalty FROM summed)"
)

#: CTE ``scored``: doc_id, scores (a list by place).
SCORED = "scored AS (SELECT doc_id, list_transform(range(0, 1 + doc_id % 6), lambda p: ((doc_id * 31 + p * 17) % 100) / 100.0::DOUBLE) AS scores FROM documents)"


def scores(doc_id: Column) -> Column:
    """Window scores that follow from the id."""
    return F.transform(F.sequence(F.lit(0), (doc_id % 6).cast("int")), lambda p: ((doc_id * 31 + p * 17) % 100) / F.lit(100.0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", scores(F.col("doc_id")).alias("scores"))
