"""Processing units: memberships packed greedily by rank, PNA CpGs in chunks, and every CpG's place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "unit int, output_offset long, cpg_count long, membership_count long, class string, oversized boolean"


def pack_runs(runs: list[tuple[int, int]], target: int) -> list[tuple[int, int, int, int]]:
    """Next-fit units of memberships in order, given as runs (CpGs of each, how many): (first rank, memberships, CpGs, units alike).

    A unit is closed when the next membership would exceed the target; one
    larger than the target has a unit of its own. No membership is split. Units
    of one run that are alike come as one entry, so the work follows the runs.
    """
    out, rank, first, held = [], 0, 0, 0

    def close() -> None:
        nonlocal first, held
        if held:
            out.append((first, rank - first, held, 1))
        first, held = rank, 0

    for n, k in runs:
        if n > target:
            close()
            out.append((rank, 1, n, k))
            rank += k
            first = rank
            continue
        fits = min(k, (target - held) // n)
        rank, held, k = rank + fits, held + fits * n, k - fits
        if k:
            close()
            each = target // n
            full = (k - 1) // each
            if full:
                out.append((rank, each, each * n, full))
            rank, first = rank + k, rank + full * each
            held = (k - full * each) * n
    close()
    return out


def membership_units(ranked: DataFrame, target: int) -> DataFrame:
    """Units of the ranked patterns, and for each its ranks: (unit, output_offset, cpg_count, membership_count, class, oversized, first_rank).

    Ranks go by count, so patterns of equal count are runs: with N CpGs there
    are no more than sqrt(2 N) different counts, and the sequential fold sees these alone.
    """
    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("n", ascending=False)
        rows, unit, at = [], 0, 0
        for first, members, n, alike in pack_runs(list(zip(df["n"].tolist(), df["k"].tolist())), target):
            rows.append((unit, at, n, members, first, alike))
            unit, at = unit + alike, at + n * alike
        return pd.DataFrame(rows, columns=["unit", "output_offset", "cpg_count", "membership_count", "first_rank", "alike"])

    runs = ranked.groupBy("n").agg(F.count("*").alias("k")).withColumn("all", F.lit(1))
    packed = runs.groupBy("all").applyInPandas(fold, "unit long, output_offset long, cpg_count long, membership_count long, first_rank long, alike long")
    i = F.col("i")
    return packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)).alias("i")).select(
        (F.col("unit") + i).cast("int").alias("unit"), (F.col("output_offset") + i * F.col("cpg_count")).alias("output_offset"), "cpg_count", "membership_count",
        F.when(F.col("membership_count") == 1, "pure").otherwise("mixed").alias("class"), (F.col("cpg_count") > target).alias("oversized"), (F.col("first_rank") + i * F.col("membership_count")).cast("int").alias("first_rank"),
    )


def pna_units(n_pna: int, real: DataFrame, target: int) -> DataFrame:
    """Units of ``n_pna`` background CpGs, after the real ones; each CpG is a membership of its own."""
    last = real.agg(F.coalesce(F.max("unit") + 1, F.lit(0)).alias("units"), F.coalesce(F.sum("cpg_count"), F.lit(0)).alias("at"))
    chunks = last.where(F.lit(n_pna > 0)).select("units", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_pna - 1, 0) // target).cast("long"))).alias("k"))
    n = F.least(F.lit(target).cast("long"), F.lit(n_pna).cast("long") - F.col("k") * target)
    return chunks.select((F.col("units") + F.col("k")).cast("int").alias("unit"), (F.col("at") + F.col("k") * target).alias("output_offset"), n.alias("cpg_count"), n.alias("membership_count"), F.lit("PNA").alias("class"), F.lit(False).alias("oversized"))


def scatter(members: DataFrame, ranked: DataFrame, real: DataFrame, target: int) -> DataFrame:
    """(dest, unit, cpg_idx): CpGs by pattern rank, then position, background last.

    Numbered within each pattern and shifted by the pattern's offset, so no task
    numbers all CpGs.
    """
    # patterns of equal count are runs of ranks: with N CpGs no more than sqrt(2 N) of them
    runs = ranked.groupBy("n").agg(F.min("rank").alias("r0"), F.sum("n").alias("held"))
    base = F.coalesce(F.sum("held").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranked.select("rank", "n").join(F.broadcast(runs.select("n", "r0", base.alias("base"))), "n").select("rank", (F.col("base") + (F.col("rank") - F.col("r0")) * F.col("n")).alias("at"))
    firsts = real.select("unit", "first_rank", (F.col("first_rank") + F.col("membership_count")).alias("end_rank"))
    placed = offsets.join(F.broadcast(firsts), (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))).select("rank", "at", "unit")
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).crossJoin(real.agg(F.coalesce(F.max("unit") + 1, F.lit(0)).alias("units")))
    # patterns hold from one to many millions of CpGs: each is numbered in blocks of positions
    block = F.floor(F.col("cpg_idx") / 65536)
    blocks = members.groupBy("rank", block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("rank").alias("b_rank"), F.col("block").alias("b_block"), before.alias("before"))
    rows = members.withColumn("block", block).withColumn("rn", F.row_number().over(Window.partitionBy("rank", "block").orderBy("cpg_idx")) - 1)
    rows = rows.join(blocks, F.col("rank").eqNullSafe(F.col("b_rank")) & (F.col("block") == F.col("b_block"))).withColumn("rn", F.col("rn") + F.col("before"))
    rows = rows.join(placed.withColumnRenamed("rank", "p_rank"), F.col("rank") == F.col("p_rank"), "left").crossJoin(F.broadcast(total))
    dest = F.when(F.col("rank").isNull(), F.col("total") + F.col("rn")).otherwise(F.col("at") + F.col("rn"))
    unit = F.when(F.col("rank").isNull(), F.col("units") + F.floor(F.col("rn") / target)).otherwise(F.col("unit"))
    return rows.select(dest.cast("long").alias("dest"), unit.cast("int").alias("unit"), "cpg_idx")


def stats(units: DataFrame) -> DataFrame:
    return units.groupBy("class").agg(
        F.count("*").alias("units"), F.min("cpg_count").alias("min_cpgs"), F.round(F.avg("cpg_count"), 6).alias("mean_cpgs"), F.max("cpg_count").alias("max_cpgs"), F.count_if("oversized").alias("oversized")
    )


def index_faults(places: DataFrame, units: DataFrame, cpgs: DataFrame) -> DataFrame:
    """(fault, n): what is wrong with a unit index of (dest, unit, cpg_idx) over all ``cpgs``; a sound one has no row.

    missing: CpGs without a place. repeated: places of a CpG beyond its first.
    unknown: placed CpGs that ``cpgs`` doesn't have. shared: CpGs of a place beyond
    its first. outside: places that aren't in the range of their unit. unfilled: by
    how much ranges and used places differ. gaps: ranges that begin neither at 0 nor
    where another ends.
    """
    known = cpgs.select("cpg_idx").distinct().withColumn("known", F.lit(True))
    of = places.groupBy("cpg_idx").agg(F.count("*").alias("k")).join(known, "cpg_idx", "full_outer")
    extra = F.coalesce(F.sum(F.when(F.col("known"), F.col("k") - 1)), F.lit(0))
    by_cpg = of.agg(F.count_if(F.col("k").isNull()).alias("missing"), extra.alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown"))
    taken = places.groupBy("dest").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("shared"), F.count("*").alias("used"))
    inside = (F.col("dest") >= F.col("output_offset")) & (F.col("dest") < F.col("output_offset") + F.col("cpg_count"))
    outside = places.join(units.select("unit", "output_offset", "cpg_count"), "unit", "left").agg(F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"))
    total = units.agg(F.coalesce(F.sum("cpg_count"), F.lit(0)).alias("total"))
    ends = units.select((F.col("output_offset") + F.col("cpg_count")).alias("at"))
    gaps = units.where("output_offset <> 0").select(F.col("output_offset").alias("at")).join(ends, "at", "left_anti").agg(F.count("*").alias("gaps"))
    # one row each
    found = by_cpg.crossJoin(taken).crossJoin(outside).crossJoin(total).crossJoin(gaps).withColumn("unfilled", F.abs(F.col("total") - F.col("used")))
    kinds = ("missing", "repeated", "unknown", "shared", "outside", "unfilled", "gaps")
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).cast("long").alias("n")) for k in kinds])).alias("f")).select("f.*").where("n > 0")


def check_index(places: DataFrame, units: DataFrame, cpgs: DataFrame) -> None:
    """A unit index is sound if places are 0 .. n - 1, each with another CpG of ``cpgs`` and in the unit that its range says, and ranges meet without gaps; else it is an error that says what is wrong."""
    found = {r["fault"]: r["n"] for r in index_faults(places, units, cpgs).collect()}  # seven kinds at most
    if found:
        raise ValueError("the unit index doesn't hold each CpG once, in the range of its unit: " + ", ".join(f"{n} {k}" for k, n in sorted(found.items())))
