"""Training-corpus pipeline: ``STAGES`` in order, each stage's result written as Parquet and read by the next.

A stage takes the documents that its predecessor kept, with all their columns, and returns those that it keeps; the last
one returns their token ids. Empty input gives empty output; rows that share an id, or have none, are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packtables.llm import bytebpe, decontaminate, langid, secretscan, simhash
from packtables.llm.common import written
from packtables.session import read_table

LEAST_LANGUAGE_SCORE = 0.25     # texts that mix two or three languages stay


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (``und``), or whose language a quarter of the letters or less supports, go."""
    return langid.keep_identified(docs, langid.train(docs), LEAST_LANGUAGE_SCORE)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicate(docs, shingle=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark."""
    return secretscan.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with their digest and that of the decoded bytes."""
    return bytebpe.digests(docs, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Trained tables, fingerprints and token ids cannot be had from SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
