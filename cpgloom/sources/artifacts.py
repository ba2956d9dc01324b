"""Artifacts: a folder of Parquet tables with a manifest of their schemas."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def save(path: str, kind: str, tables: dict[str, DataFrame]) -> None:
    """Writes each table below ``path``, then the manifest; a folder without manifest is unfinished."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    rows = [(kind, name, json.dumps(df.schema.jsonValue(), sort_keys=True)) for name, df in tables.items()]
    spark.createDataFrame(rows, "kind string, name string, schema string").coalesce(1).write.parquet(f"{path}/_manifest.parquet")


def load(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, DataFrame]:
    """The tables of an artifact; another kind, or a table of another schema, is an error."""
    out = {}
    for r in spark.read.parquet(f"{path}/_manifest.parquet").collect():
        if kind is not None and r["kind"] != kind:
            raise ValueError(f"artifact of kind {r['kind']}, not {kind}")
        df = spark.read.parquet(f"{path}/{r['name']}")
        if [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(r["schema"]))] != df.dtypes:
            raise ValueError(f"table {r['name']} doesn't have the manifest's columns and types")
        out[r["name"]] = df
    return out


def describe(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """(key, value): kind, rows and columns of each table, and what matters of that kind (unit-index, units, trunk, signature, linear, boosted, store)."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select(F.lit("kind").alias("key"), F.lit(kind).alias("value"))
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"{name}.rows").alias("key"), "value"))
        out = out.unionByName(spark.range(1).select(F.lit(f"{name}.columns").alias("key"), F.lit(",".join(df.columns)).alias("value")))
    if kind in _FIELDS:
        own = _FIELDS[kind](tables)
        out = out.unionByName(own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in own.columns])).alias("r")).select("r.*"))
    return out


def _of_class(names: list[str], c: str = "class") -> list[Column]:
    return [F.count_if(F.col(c) == n).alias(n) for n in names]


def _index_fields(t: dict[str, DataFrame]) -> DataFrame:
    return t["units"].agg(F.count("*").alias("units"), *_of_class(["pure", "mixed", "PNA"]), F.sum("membership_count").alias("memberships"), F.sum("cpg_count").alias("cpgs"), F.max("cpg_count").alias("largest_unit"))


def _decoder_fields(t: dict[str, DataFrame]) -> DataFrame:
    rank = F.when(F.col("mode") == "factor", F.col("rank"))
    width = F.size("head") / F.when(F.col("mode") == "direct", F.size("cpgs")).otherwise(F.col("rank"))
    return t["units"].agg(
        F.count("*").alias("units"), *_of_class(["pure", "mixed", "PNA"]), *_of_class(["factor", "direct"], "mode"), F.min(rank).alias("least_rank"), F.max(rank).alias("greatest_rank"),
        F.max(width.cast("int")).alias("input_dim"), F.sum(F.size("cpgs")).alias("cpgs"), F.sum(F.size("a") + F.size("head") + F.size("E") + F.size("b")).alias("parameters"), F.round(F.avg("best_mae"), 6).alias("mean_best_mae"),
    )


def _trunk_fields(t: dict[str, DataFrame]) -> DataFrame:
    sites = t["sites"].agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.size("cpgs")), F.lit(0)).alias("cpgs"))
    return t["trunk"].select("n_input", "hidden", "rank", "patterns").crossJoin(sites)  # one row each


def _signature_fields(t: dict[str, DataFrame]) -> DataFrame:
    return t["signature"].agg(F.count_distinct("cell_type").alias("cell_types"), F.count_distinct("pattern").alias("patterns"))


def _linear_fields(t: dict[str, DataFrame]) -> DataFrame:
    return t["model"].agg(F.count("*").alias("features"), F.first("bias").alias("bias"), F.first("scale").alias("scale"))


def _boosted_fields(t: dict[str, DataFrame]) -> DataFrame:
    labels = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("class_idx", "label"))), lambda x: x["label"]), ",")
    return t["nodes"].agg(F.count_distinct("round").alias("rounds"), F.count_distinct("class_idx").alias("classes"), F.count_distinct("feature").alias("used_features"), F.count("value").alias("leaves"), labels.alias("labels"))


def _store_fields(t: dict[str, DataFrame]) -> DataFrame:
    own = t["members"].agg(F.count_distinct("cell_id").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("observed"), F.count("places").alias("lists"), F.count("bits").alias("bitmaps"))
    return t["ladder"].agg(F.count("*").alias("replicates"), F.min("sample").alias("least_sample"), F.max("sample").alias("greatest_sample")).crossJoin(own)  # one row each


_FIELDS = {"unit-index": _index_fields, "units": _decoder_fields, "trunk": _trunk_fields, "signature": _signature_fields, "linear": _linear_fields, "boosted": _boosted_fields, "store": _store_fields}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir, which driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(where or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: used several times, computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stage`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.staged_at)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole below ``path``."""
    fs, p = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is below ``path``, if anything, wherever Spark keeps it."""
    fs, p = _path(spark, path)
    fs.delete(p, True)
