"""A training-corpus pipeline over ``documents``: classify, deduplicate, redact, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm import bpe, common, mixing, quality, secret_scan, simhash
from oddsloom.llm.queries import WORD_BPE


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secret_scan.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of the decoded text."""
    return bpe.encode_documents(docs, WORD_BPE())


STAGES = [("quality classifier", classify), ("SimHash near-dedup", deduplicate), ("secret scans", redact), ("mixing sources", mix), ("BPE encoding", encode)]

#: No SQL: classifier, near-duplicates and BPE are beyond it; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes Parquet to the shared folder and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
