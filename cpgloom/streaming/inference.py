"""Streaming inference: whole samples arrive as files, and each micro-batch is featurised and classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cpgloom.operators import classify, features

SCHEMA = "cell_id long, cpg_idx long, m long, u long"


def classify_stream(spark: SparkSession, path: str, masked: DataFrame, states: list[str], model: DataFrame, out: str, checkpoint: str, files: int = 8) -> StreamingQuery:
    """Classifies new files of observations under ``path`` into Parquet under ``out``, once for each batch.

    A file holds all observations of its cells, so a batch needs no state and no
    watermark. A batch that is run again writes to the same folder.
    """
    def each(batch: DataFrame, number: int) -> None:
        feat = features.features(batch, masked, states)
        classify.score_linear(feat, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
