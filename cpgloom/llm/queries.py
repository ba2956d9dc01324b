"""The operators' queries on the tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.llm import bpe, jaccard_join, licenses, line_dedup, mixing, pii, quality, resample, rlz_dedup, secrets, topk, toxicity, vector_codes
from cpgloom.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that an earlier document holds, as a digest."""
    return rlz_dedup.dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict of every text."""
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), "grade", "toxic")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of a mix of all sources by Sainte-Lague apportionment."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules and the verdict on every text."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumn("probability", F.round("probability", 6))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector against all vectors."""
    rows = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every text."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["start"], m["end"])), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), text.alias("matches"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by four-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_join.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.scan(_table(spark, sf_dir, "documents")).withColumn("spans", F.array_join("spans", ","))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.scan(_table(spark, sf_dir, "documents")).withColumn("spans", pii.spans_string(F.col("spans")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text decoded from them, as digests."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a later document and two others or more hold too, as a digest."""
    return line_dedup.dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts and its rank in the seeded draw."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of four bytes and its error."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_mixing, op4_quality, op5_topk, op6_licenses, op7_ngram_join, op8_secrets, op9_pii, op10_bpe, op11_line_dedup, op12_resampling, op13_vector_codes)}
