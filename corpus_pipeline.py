"""The training-data pipeline: each stage works on the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cpgloom.llm import bpe, jaccard_join, mixing, pii, toxicity
from cpgloom.llm.common import materialize


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't find toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, with five-word shingles at a Jaccard similarity of 0.8."""
    return jaccard_join.keep_one(docs, ngram=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a document comes as often as the mix takes it, parts with their words only."""
    return mixing.materialise_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", civil),
    ("n-gram Jaccard join", distinct),
    ("PII", private),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express none of the learned stages; tests/llm/test_pipeline.py holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs
