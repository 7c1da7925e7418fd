"""A training corpus from ``documents``, stage by stage.

Each stage takes what the one before kept, as written Parquet.  A document that the
quality field rejects goes; of near duplicates one stays; contaminated documents
go; secrets are replaced in the texts; the last stage encodes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscreen.llm import bpe_automaton, decontaminate, ngram_join, quality_crf, secret_scan
from sparkscreen.llm.queries import table, tokenizer_path
from sparkscreen.llm.shared import staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field doesn't reject, with all their columns.

    It learns from the labels outside the held-out fold, as the operator's own query does.  Null and empty texts are one
    empty line and get that line's score; rows with a null doc_id are scored too; repeated rows are all kept or all not; no rows, no rows.
    """
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"), use=~quality_crf.held_out(0, 5))
    return quality_crf.keep_good(docs, field)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked ones: that of the smallest doc_id, of texts that share it the one with the smallest key.

    Texts without words and rows with a null doc_id have no duplicates and stay; of rows with one doc_id and text one stays.
    """
    return ngram_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows.

    Texts without words stay; rows are judged each by its own text, also where a doc_id is null or shared.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in ``text`` replaced by their kinds; a null text stays null, every row stays."""
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; null and empty texts have no ids."""
    return bpe_automaton.encode_documents(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded),
]

#: A trained field decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
