"""Readers: tables, labelled corpora, recordings, uploads and fold tables."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import struct

CORPUS = "id string, kind string, category string, surface string, payload map<string,string>, marker string, pinned array<string>, pinned_reason string, source map<string,string>, lang string, params map<string,string>, notes string, _corrupt string"
CASSETTE = "format int, model_id string, revision string, records map<string,struct<scores:array<double>,windows:int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir`` or that was given to ``setCheckpointDir``; a temporary
    one for a session in one process that has neither, and an error on a cluster."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("no shared folder for intermediate tables: set spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkscreen-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON-lines files, with ``file`` and, for a line that can't be read, ``_corrupt``."""
    return spark.read.schema(CORPUS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(list(paths)).withColumn("file", F.input_file_name())


def write_corpus(records: DataFrame, path: str) -> None:
    """Append records, a folder for each category."""
    records.drop("_corrupt", "file").write.mode("append").partitionBy("category").json(path)


def cassette(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, scores, windows) of a recording; ``fault`` names what is wrong with an entry."""
    raw = spark.read.schema(CASSETTE).option("multiLine", True).json(path)
    rows = raw.select(F.explode("records").alias("sha256", "r")).select("sha256", "r.scores", "r.windows")
    fault = F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "key").when(F.col("scores").isNull() | F.exists("scores", lambda s: s.isNull()), "scores").when(F.size("scores") != F.col("windows"), "windows")
    return rows.withColumn("fault", fault)


def write_cassette(scored: DataFrame, path: str) -> None:
    """Whole or not at all, by the commit protocol of the writer."""
    scored.select("sha256", "scores", F.size("scores").alias("windows")).write.mode("overwrite").json(path)


def fold_table(spark: SparkSession, confusables: str, supplement: str | None = None) -> DataFrame:
    """(source, target) from a confusables file (code points ; code points ; …): single
    non-ASCII sources with ASCII targets.  A supplement (U+XXXX, target, reason, by tabs) wins."""
    rows = spark.read.text(confusables).where(~F.col("value").startswith("#") & F.col("value").contains(";"))
    parts = F.split(F.regexp_replace("value", "^﻿|#.*$", ""), ";")
    code = lambda c: F.conv(c, 16, 10).cast("int")
    text = lambda col: F.array_join(F.transform(F.split(F.trim(col), r"\s+"), lambda c: F.decode(F.unhex(F.lpad(F.hex(code(c)), 8, "0")), "UTF-32")), "")
    own = rows.select(text(parts[0]).alias("source"), text(parts[1]).alias("target")).where((F.length("source") == 1) & (F.octet_length("source") > 1) & (F.octet_length("target") == F.length("target")))
    if supplement is None:
        return own
    more = spark.read.option("sep", "\t").option("comment", "#").schema("code string, target string, reason string").csv(supplement)
    bad = more.where(~F.col("code").rlike("^U\\+[0-9A-F]{4,6}$") | F.col("target").isNull())
    more = more.join(bad, "code", "left_anti").select(text(F.substring("code", 3, 6)).alias("source"), F.col("target").alias("better"))
    return own.join(more, "source", "full_outer").select("source", F.coalesce("better", "target").alias("target"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def inflate_bounded(most: int):
    """A column function (body, encoding) → struct<status, body>: identity, gzip or deflate; more than ``most`` bytes out, four times that in, or a broken stream is refused."""

    def one(body: bytes | None, encoding: str | None):
        if body is None:
            return "missing", None
        name = (encoding or "identity").strip().lower()
        if name not in ("", "identity", "gzip", "x-gzip", "deflate"):
            return "encoding", None
        if len(body) > 4 * most or name in ("", "identity") and len(body) > most:
            return "too_large", None
        if name in ("", "identity"):
            return "ok", body
        for bits in (31,) if "gzip" in name else (15, -15):
            d = zlib.decompressobj(bits)
            try:
                out = d.decompress(body, most + 1)
            except zlib.error:
                continue
            if len(out) > most:
                return "too_large", None
            return ("ok", out) if d.eof and not d.unused_data else ("broken", None)
        return "broken", None

    @F.pandas_udf(struct("status string, body binary"))
    def inflate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for body, encoding in batches:
            yield pd.DataFrame([one(b, e) for b, e in zip(body, encoding, strict=True)], columns=["status", "body"])

    return inflate
