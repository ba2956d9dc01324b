"""Cell by pattern features: unweighted means of CpG fractions, on the full grid of cells and states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.sources.artifacts import scratch


def order_states(states: DataFrame) -> DataFrame:
    """(pattern, ord) of (state, defined): numbered names by number, others as defined, Pna last."""
    number = S.first_number(F.col("state"))
    kind = F.when(F.col("state") == "Pna", 2).when(number.isNotNull(), 0).otherwise(1)
    order = Window.orderBy(kind, number.asc_nulls_last(), "defined")
    return states.select(F.col("state").alias("pattern"), (F.row_number().over(order) - 1).cast("int").alias("ord"))


def state_list(top: int, pna: str = "Pna") -> list[str]:
    return [*(f"P{k}" for k in range(1, top + 1)), pna]


def chosen(states: list[str], first: int | None = None, include_pna: bool = False, pna: str = "Pna") -> list[str]:
    """The states that a model is trained on: the first ``first`` in their order, by default all, without the background unless asked for."""
    n = first or len(states) - (0 if include_pna else states.count(pna))
    if not 0 < n <= len(states):
        raise ValueError("no such number of states")
    return states[:n]


def bucketed(df: DataFrame, name: str, buckets: int, by: str = "cpg_idx") -> DataFrame:
    """``df`` as a table of files by buckets of CpGs: tables of as many buckets are joined on their CpGs where they lie.

    Observations that are kept like this cross the network no more when features
    are made of them, only the sums of cells and states do.
    """
    spark = df.sparkSession
    df.write.bucketBy(buckets, by).sortBy(by).option("path", scratch(spark, name)).mode("errorifexists").saveAsTable(table := f"{name}_{uuid.uuid4().hex}")
    return spark.table(table)


def features(obs: DataFrame, masked: DataFrame, states: list[str], key: str = "cell_id") -> DataFrame:
    """(key, pattern, ord, beta, n_o): mean fraction and number of covered CpGs for each cell and state.

    One join and one grouped sum; the grid is an array of the few states put
    beside each cell. States that a cell does not cover have null beta and n_o 0.
    """
    covered = obs.where(S.coverage() > 0).select(key, "cpg_idx", S.beta().alias("b"))
    joined = covered.join(masked, "cpg_idx").groupBy(key, "state").agg(F.avg("b").alias("beta"), F.count("*").alias("n_o"))
    cells = obs.select(key).distinct()
    grid = cells.select(key, F.posexplode(F.array(*map(F.lit, states))).alias("ord", "state"))
    return grid.join(joined, [key, "state"], "left").select(key, F.col("state").alias("pattern"), "ord", "beta", F.coalesce("n_o", F.lit(0).cast("long")).alias("n_o"))


def mask_features(obs: DataFrame, masks: dict[str, DataFrame], states: dict[str, list[str]], key: str = "cell_id") -> DataFrame:
    """(key, mask_id, pattern, ord, beta, n_o) of several masks (cpg_idx, state) by one scan of the observations.

    A CpG's states in all masks are one row, so an observation is joined once and
    counted in each mask that has the CpG. Patterns are named mask-state and
    ordered by the state's number, the background last; equal ones in the masks' order.
    """
    names = list(masks)
    parts = [masks[m].select("cpg_idx", F.struct(F.lit(m).alias("mask_id"), F.col("state")).alias("s")) for m in names]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy("cpg_idx").agg(F.collect_list("s").alias("in"))
    covered = obs.where(S.coverage() > 0).select(key, "cpg_idx", S.beta().alias("b"))
    joined = covered.join(every, "cpg_idx").select(key, "b", F.explode("in").alias("s")).groupBy(key, "s.mask_id", "s.state").agg(F.avg("b").alias("beta"), F.count("*").alias("n_o"))
    listed = obs.sparkSession.createDataFrame([(m, s, i, k) for i, m in enumerate(names) for k, s in enumerate(states[m])], "mask_id string, state string, mask int, defined int")
    number = S.first_number(F.col("state"))
    order = Window.orderBy(F.when(F.col("state") == "Pna", 2).when(number.isNotNull(), 0).otherwise(1), number.asc_nulls_last(), "mask", "defined")  # a row for each state
    listed = listed.select("mask_id", "state", (F.row_number().over(order) - 1).cast("int").alias("ord"))
    grid = obs.select(key).distinct().crossJoin(F.broadcast(listed))
    name = F.concat_ws("-", "mask_id", "state").alias("pattern")
    return grid.join(joined, [key, "mask_id", "state"], "left").select(key, "mask_id", name, "ord", "beta", F.coalesce("n_o", F.lit(0).cast("long")).alias("n_o"))


def min_cov(feat: DataFrame, least: int) -> DataFrame:
    """Blanks betas with fewer covered CpGs; a bound of 1 blanks nothing."""
    return feat.withColumn("beta", F.when(F.col("n_o") >= least, F.col("beta"))) if least > 1 else feat


def wide(feat: DataFrame, states: list[str], key: str = "cell_id") -> DataFrame:
    return feat.where(F.col("pattern").isin(states)).groupBy(key).pivot("pattern", states).agg(F.first("beta", ignorenulls=True))


def signature(feat: DataFrame, max_missing: float = 0.3, key: str = "cell_type") -> DataFrame:
    """(key, pattern, beta): sparse patterns dropped, gaps filled with the pattern's median, six significant digits."""
    kept = feat.groupBy("pattern").agg(F.count("beta").alias("k"), F.count("*").alias("n"), F.median("beta").alias("mid"))
    kept = kept.where((F.col("k") > 0) & (1 - F.col("k") / F.col("n") <= max_missing)).select("pattern", "mid")
    return feat.join(kept, "pattern").select(key, "pattern", S.significant(F.coalesce("beta", "mid")).alias("beta"))


def used_patterns(sig: DataFrame, feat: DataFrame, pna: str = "Pna") -> DataFrame:
    """Patterns of both, without the background."""
    return sig.select("pattern").where(F.col("pattern") != pna).intersect(feat.select("pattern"))


def usable(sig: DataFrame, feat: DataFrame, least: int = 1) -> DataFrame:
    """(cell_id, pattern, beta) rows that a cell can be solved with: complete cases."""
    rows = feat.join(used_patterns(sig, feat), "pattern").where(F.col("beta").isNotNull())
    rows = rows.where(F.col("n_o") >= least) if least > 1 else rows
    return rows.select("cell_id", "pattern", "beta")
