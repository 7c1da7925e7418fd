"""The query catalogue, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import forms, html, structure
from ..sources.tables import table
from . import addresses, evaluation, extras, operations, records, screening, tallies
from .registry import QUERIES, SQL, Query

MODULES = (screening, addresses, evaluation, operations, extras, records, tallies)


def screened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: extraction, scan of text, inline text, all forms and markup, and what follows from it.

    One parse, two narrow Python passes, and no shuffle.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", html.extract_html("html").alias("x"))
    pages = pages.withColumn("f", forms.page_forms(F.col("x.raw_text"))).withColumn("inline", patterns.scan(F.col("x.scan_text_inline"))).withColumn("markup", patterns.scan_markup(F.col("html")))
    pages = pages.withColumn("scan", patterns.combine(F.col("inline"), F.col("markup"), patterns.scan_forms(F.col("f.forms"), F.col("f.refused"))))
    none = F.lit(None).cast("array<double>")
    pages = pages.withColumn("c", structure.classifier_outcome(F.lit("standard"), F.col("scan.verdict"), none, F.lit(False), F.lit(False)))
    q = structure.quarantine(F.col("x.title"), F.col("x.main_content"), F.lit(""), F.col("scan.verdict"), F.col("c.state"), F.col("c.detected"))
    score = structure.trust_score(F.lit("standard"), F.col("scan.penalty"), F.col("c.penalty"), F.lit(False))
    return pages.select("page_id", q["title"].alias("title"), F.col("scan.verdict").alias("stage2_verdict"), F.col("scan.penalty").alias("penalty"), F.round(score, 6).alias("trust_score"), F.col("c.state").alias("state"), q["diagnostic"].alias("diagnostic"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened_pages(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"screened_pages": screened_pages, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
