"""A stored training set: what each replicate observes of each cell, by blocks of CpGs, and the truth beside it.

A replicate's CpGs of one cell and block are a list of places while that is the
smaller form, and a bitmap from then on. Rows are files by replicate, so a
replicate is read alone. What a replicate doesn't observe is found by testing the
truth's places against a block's bits, block by block; no CpG is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: CpGs of a block: those that one bitmap holds.
BITS = 32_768
MEMBERS = "cell_id long, block long, n int, places array<smallint>, bits binary, rep int"
TRUTH = "cell_id long, block long, places array<smallint>, codes array<int>"
LADDER = "rep int, sample long"


def _at():
    return F.floor(F.col("cpg_idx") / BITS).alias("block"), (F.col("cpg_idx") % BITS).cast("smallint").alias("place")


def packed(sampled: DataFrame) -> DataFrame:
    """(cell_id, block, n, places, bits, rep) of (rep, cell_id, cpg_idx): either places or bits, two bytes a CpG or one bit a place of the block."""
    block, place = _at()
    rows = sampled.select("rep", "cell_id", block, place).groupBy("rep", "cell_id", "block").agg(F.array_sort(F.collect_set("place")).alias("places"), F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    few = F.size("places") * 2 < BITS // 8
    return rows.select("cell_id", "block", F.size("places").alias("n"), F.when(few, F.col("places")).alias("places"), F.when(~few, F.col("bits")).alias("bits"), "rep")


def save(path: str, sampled: DataFrame, codes: DataFrame, ladder: DataFrame) -> None:
    """Writes the sampled CpGs by replicate, the truth (cell_id, cpg_idx, code) by cell and block, and the ladder."""
    block, place = _at()
    truth = codes.select("cell_id", block, place, "code").groupBy("cell_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("v"))
    packed(sampled).repartition("rep").sortWithinPartitions("rep", "cell_id", "block").write.partitionBy("rep").parquet(f"{path}/members")
    truth.select("cell_id", "block", F.col("v.place").alias("places"), F.col("v.code").alias("codes")).write.parquet(f"{path}/truth")
    ladder.select("rep", "sample").coalesce(1).write.parquet(f"{path}/ladder")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored set: members, truth, ladder. Replicates outside the ladder, or blocks whose number of CpGs isn't the stored one, are an error."""
    tables = {k: spark.read.schema(schema).parquet(f"{path}/{k}") for k, schema in (("members", MEMBERS), ("truth", TRUTH), ("ladder", LADDER))}
    members = tables["members"]
    count = F.coalesce(F.size("places"), F.bitmap_count("bits"))
    one = F.col("places").isNull() != F.col("bits").isNull()
    bad = members.where(~one | (F.nvl(count, F.lit(-1)) != F.col("n"))).limit(1).count() + members.select("rep").distinct().join(tables["ladder"], "rep", "left_anti").limit(1).count()
    if bad:
        raise ValueError("not a sound training set")
    return tables


def _free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unobserved places of a batch's cells and blocks, all at once: lists by their keys of row and place, bitmaps bit by bit."""
    for batch in batches:
        rep, cell, block, places, codes, seen, bits = batch.columns
        counts = pc.list_value_length(places).to_numpy()
        row, place = np.repeat(np.arange(batch.num_rows), counts), places.flatten().to_numpy().astype(np.int64)
        own = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(seen), 0).to_numpy())
        free = ~np.isin(row * BITS + place, own * BITS + seen.flatten().to_numpy())
        ends = counts.cumsum()
        for i in np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)).tolist():
            at = slice(ends[i] - counts[i], ends[i])
            free[at] = ~np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), bitorder="little", count=BITS).astype(bool)[place[at]]
        row, place, code = row[free], place[free], codes.flatten().to_numpy()[free]
        columns = [rep.to_numpy()[row], cell.to_numpy()[row], place + block.to_numpy()[row] * BITS, code / 65534.0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "cell_id", "cpg_idx", "y"])


def targets(store: dict[str, DataFrame], reps: list[int] | None = None) -> DataFrame:
    """(rep, cell_id, cpg_idx, y): true values of the CpGs that a replicate doesn't observe, of all replicates or of ``reps``, whose files alone are read."""
    members, ladder = store["members"], store["ladder"]
    if reps is not None:
        members, ladder = members.where(F.col("rep").isin(reps)), ladder.where(F.col("rep").isin(reps))
    rows = store["truth"].crossJoin(F.broadcast(ladder.select("rep")))  # a ladder is a few rows
    own = members.select("rep", "cell_id", "block", F.col("places").alias("seen"), "bits")
    return rows.join(own, ["rep", "cell_id", "block"], "left").select("rep", "cell_id", "block", "places", "codes", "seen", "bits").mapInArrow(_free, "rep int, cell_id long, cpg_idx long, y double")


def levels(store: dict[str, DataFrame]) -> DataFrame:
    """(sample, n_reps, n_observed, n_cells): each level's replicates, and the CpGs that they observe, over all cells."""
    own = store["members"].groupBy("rep").agg(F.sum("n").alias("k"), F.count_distinct("cell_id").alias("c"))
    rows = store["ladder"].join(own, "rep", "left")
    return rows.groupBy("sample").agg(F.count("*").alias("n_reps"), F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("n_observed"), F.coalesce(F.max("c"), F.lit(0).cast("long")).alias("n_cells"))
