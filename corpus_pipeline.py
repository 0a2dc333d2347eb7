"""A training corpus from `documents`: toxic ones go, one of each near-duplicate group stays, secrets are masked, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revloom.llm import bpe, mixing, near_dedup, secrets, toxicity
from revloom.llm.common import fold, store, table
from revloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity classifier rejects; it learns from labels whose crc32(doc_id) mod 3 is not 1. Null and empty texts score by the intercept; all columns stay."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; rows without words or id stay."""
    return near_dedup.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked; null and empty texts stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of its source takes it: none, once or more."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text's tokens for each row; a null text has none."""
    return bpe.tokens(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: No SQL: classifiers, similarity joins and tokenizers aren't expressible; tests/llm/test_pipeline.py holds it against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder through all stages, each written to the shared folder and read again; no rows give none."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
