"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, token ids.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlane.llm import bpe, decontaminate, langid, neardup, secrets
from graphlane.llm.common import few_rows, table, written
from graphlane.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found."""
    few_rows(spark)
    return langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return neardup.one_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in the text replaced by its kind; n_chars follows the text."""
    return secrets.masked(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256: one row per row of docs, whatever its doc_id."""
    return bpe.digests(docs, vocabulary(), ("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("secrets_masked", secrets_masked),
    ("token_ids", token_ids),
]

#: SQL has no suffix automata, so the pipeline is held against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
