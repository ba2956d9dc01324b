"""The driver's tables in the shape of methylome tables.

A CpG is a part, a reference sample a line number, a query cell a supplier;
methylated and unmethylated counts are summed quantities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spark: SparkSession, sf_dir: str, key: Column, name: str) -> DataFrame:
    methylated = F.col("l_returnflag") == "R"
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(key.alias(name), F.col("l_partkey").alias("cpg_idx"))
        .agg(
            F.sum(F.when(methylated, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("m"),
            F.sum(F.when(methylated, 0.0).otherwise(F.col("l_quantity"))).cast("long").alias("u"),
        )
    )


def ref_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference observations: (sample_id, cpg_idx, m, u)."""
    return _counts(spark, sf_dir, (F.col("l_linenumber") - 1).cast("int"), "sample_id")


def query_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query cells: (cell_id, cpg_idx, m, u)."""
    return _counts(spark, sf_dir, F.col("l_suppkey"), "cell_id")


def celltype_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cell types for signatures: (cell_type, cpg_idx, m, u)."""
    return _counts(spark, sf_dir, (F.col("l_linenumber") % 3).cast("long"), "cell_type")


def cpgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cpg_idx")).distinct()


def n_samples(spark: SparkSession, sf_dir: str) -> int:
    """Reference samples, numbered from 0; a pattern has one digit for each."""
    return (table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber").alias("n")).first()["n"]) or 0


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, label, y): the supplier's nation, and whether its region is among the first two."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("cell_id"), F.col("n_name").alias("label"), (F.col("n_regionkey") < 2).cast("int").alias("y")
    )
