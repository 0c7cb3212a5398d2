"""The corpus pipeline: quality rules, near-duplicates, PII, mixing and packing over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankfile.llm import mixing, packing, pii, quality_rules, simhash
from rankfile.llm.common import discard, store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or stand on a rejected host (source)."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies (five words, similarity 0.8)."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it in the texts."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for; repeats are rows."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rows into sequences of at most 2048 tokens: one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixture),
    ("packing", pack),
]

#: Tokens, fingerprints and the fitted budget can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out = store(out, f"stage{k}")
        if k:  # the stage before last is read no more
            discard(docs)
        docs = out
