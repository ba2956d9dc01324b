"""Simulated sparse training sets: ladders of sizes, stateless sampling, features and standardisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.sources.artifacts import stage


def ladder_fixed(spark: SparkSession, levels: list[int], reps: int) -> DataFrame:
    """(rep, sample): each level for ``reps`` replicates in turn."""
    level = F.element_at(F.array(*[F.lit(x).cast("long") for x in levels]), (F.col("id") / reps).cast("int") + 1)
    return spark.range(len(levels) * reps).select(F.col("id").cast("int").alias("rep"), level.alias("sample"))


def ladder_log(spark: SparkSession, reps: int, low: int, high: int, skew: float = 0.5) -> DataFrame:
    """(rep, sample): sizes from low to high on a log scale, denser to one end by ``skew``; at least 1."""
    u = F.lit(1.0) if reps == 1 else F.col("id") / float(reps - 1)
    size = F.floor(F.exp(math.log(low) + (math.log(high) - math.log(low)) * F.pow(u, F.lit(skew))) + 0.5)
    return spark.range(reps).select(F.col("id").cast("int").alias("rep"), F.greatest(F.lit(1).cast("long"), size.cast("long")).alias("sample"))


def near_sample(obs: DataFrame, ladder: DataFrame, seed: int = 1) -> DataFrame:
    """(rep, cell_id, cpg_idx, b, sample, n, key): the covered CpGs whose key is low enough to be in the sample, by four deviations and a few more, of ``n`` covered ones.

    The bound follows from the cell's number of covered CpGs, so all others go before anything is sorted.
    """
    covered = obs.where(S.coverage() > 0).select("cell_id", "cpg_idx", S.beta().alias("b"))
    rows = covered.join(covered.groupBy("cell_id").agg(F.count("*").alias("n")), "cell_id").crossJoin(F.broadcast(ladder))
    rows = rows.withColumn("key", S.key_of(seed, F.col("rep"), F.col("cell_id"), F.col("cpg_idx")))
    bound = (F.col("sample") + 4 * F.sqrt("sample") + 8) / F.col("n")
    return rows.where(S.share_of(F.col("key")) < bound).select("rep", "cell_id", "cpg_idx", "b", "sample", "n", "key")


def sample(obs: DataFrame, ladder: DataFrame, seed: int = 1) -> DataFrame:
    """(rep, cell_id, cpg_idx, b): of each cell's covered CpGs the first ``sample`` in a seeded order, for each replicate.

    The ladder is a few rows; the order of a CpG depends on seed, replicate,
    cell and CpG alone, so replicates are independent and reruns agree. Only CpGs
    of ``near_sample`` are sorted; a cell and replicate with too few of these is sorted whole.
    """
    own = Window.partitionBy("rep", "cell_id")
    rows = near_sample(obs, ladder, seed).select("*", F.row_number().over(own.orderBy("key", "cpg_idx")).alias("rn"), F.count("*").over(own).alias("near"))
    rows = stage(rows.where((F.col("rn") <= F.col("sample")) & (F.col("near") >= F.least("sample", "n"))).select("rep", "cell_id", "cpg_idx", "b"), "sampled")
    covered = obs.where(S.coverage() > 0).select("cell_id", "cpg_idx", S.beta().alias("b"))
    pairs = covered.select("cell_id").distinct().crossJoin(F.broadcast(ladder.where("sample > 0")))
    short = pairs.join(rows.select("rep", "cell_id").distinct(), ["rep", "cell_id"], "left_anti")
    if short.isEmpty():
        return rows
    short = stage(short, "short")
    whole = covered.join(short, "cell_id")
    order = own.orderBy(S.key_of(seed, F.col("rep"), F.col("cell_id"), F.col("cpg_idx")), "cpg_idx")
    whole = whole.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.col("sample"))
    return rows.unionByName(whole.select("rep", "cell_id", "cpg_idx", "b"))


def sampled_features(sampled: DataFrame, members: DataFrame, patterns: int, seed: int = 1) -> DataFrame:
    """(rep, cell_id, pattern, beta, beta_binary, n): means by pattern rank below ``patterns``, plain and after one draw a CpG."""
    drawn = S.uniform(seed, F.lit("b"), F.col("rep"), F.col("cell_id"), F.col("cpg_idx")) < F.col("b")
    rows = sampled.join(members.where(F.col("rank") < patterns), "cpg_idx")
    return rows.groupBy("rep", "cell_id", F.col("rank").alias("pattern")).agg(F.avg("b").alias("beta"), F.avg(drawn.cast("double")).alias("beta_binary"), F.count("*").alias("n"))


def split(cells: DataFrame, seed: int = 1) -> DataFrame:
    """(cell_id, split): 70, 15 and 15 in 100 in a seeded order; the cells are a small dimension. Too few for all three are an error."""
    n = F.count("*").over(Window.partitionBy())
    rn = F.row_number().over(Window.orderBy(S.key_of(seed, F.col("cell_id")), "cell_id"))
    train, val = F.floor(n * 70 / 100), F.floor(n * 15 / 100)
    few = (train < 1) | (val < 1) | (train + val >= n)
    return cells.select("cell_id", F.when(few, F.raise_error(F.lit("too few cells for a split")).cast("string")).when(rn <= train, "train").when(rn <= train + val, "val").otherwise("test").alias("split"))


def truth_codes(obs: DataFrame) -> DataFrame:
    return obs.where(S.coverage() > 0).select("cell_id", "cpg_idx", S.u16(S.beta()).alias("code"))


def grid(feat: DataFrame, rows: DataFrame, patterns: int) -> DataFrame:
    """Features on the full grid of (rep, cell) rows and patterns."""
    full = rows.select("rep", "cell_id", F.explode(F.sequence(F.lit(0), F.lit(patterns - 1))).alias("pattern"))
    return full.join(feat, ["rep", "cell_id", "pattern"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def channels(full: DataFrame, mode: str, patterns: int) -> DataFrame:
    """(rep, cell_id, j, v): raw inputs of a feature mode. Missing betas stay null.

    beta: the patterns' betas; missing: beta and missing indicator by turns;
    count: beta and log1p(n) by turns; scalar: the betas, then log1p of all n.
    """
    beta, second = F.col("beta"), F.when(F.col("beta").isNull(), 1.0).otherwise(0.0)
    if mode == "beta":
        return full.select("rep", "cell_id", F.col("pattern").alias("j"), beta.alias("v"))
    if mode == "scalar":
        total = full.groupBy("rep", "cell_id").agg(F.log1p(F.sum("n").cast("double")).alias("v"))
        return full.select("rep", "cell_id", F.col("pattern").alias("j"), beta.alias("v")).unionByName(total.select("rep", "cell_id", F.lit(patterns).alias("j"), "v"))
    if mode == "count":
        second = F.log1p(F.col("n").cast("double"))
    pair = F.array(F.struct((F.col("pattern") * 2).alias("j"), beta.alias("v")), F.struct((F.col("pattern") * 2 + 1).alias("j"), second.alias("v")))
    return full.select("rep", "cell_id", F.explode(pair).alias("p")).select("rep", "cell_id", "p.j", "p.v")


def standardise(rows: DataFrame, train: Column, trunk: bool = False) -> DataFrame:
    """(rep, cell_id, j, x): mean of the observed training rows, and their squared deviations over all training rows; missing is 0.

    A scale is at least 1e-6; for the trunk's inputs one of up to 1e-8 is 1 instead.
    But for the trunk's, an input that no training row has is an error.
    """
    never = F.raise_error(F.lit("an input is never observed in training")).cast("double")
    mean = rows.where(train).groupBy("j").agg(F.avg("v").alias("mean"))
    mean = mean if trunk else mean.select("j", F.coalesce("mean", never).alias("mean"))
    variance = F.coalesce(F.sum(F.pow(F.col("v") - F.col("mean"), 2)), F.lit(0.0)) / F.count("*")
    least = F.when(F.sqrt(variance) <= 1e-8, 1.0).otherwise(F.sqrt(variance)) if trunk else F.sqrt(F.greatest(variance, F.lit(1e-12)))
    scale = rows.where(train).join(mean, "j").groupBy("j", "mean").agg(least.alias("scale"))
    return rows.join(F.broadcast(scale), "j").select("rep", "cell_id", "j", F.coalesce((F.col("v") - F.col("mean")) / F.col("scale"), F.lit(0.0)).alias("x"))


def bias_prior(codes: DataFrame, train_cells: DataFrame, cpgs: DataFrame) -> DataFrame:
    """(cpg_idx, logit) of the mean truth over training cells, 0.5 without any, kept within 0.01 and 0.99."""
    mean = codes.join(train_cells, "cell_id").groupBy("cpg_idx").agg(F.avg(F.col("code") / 65534.0).alias("p"))
    return cpgs.join(mean, "cpg_idx", "left").select("cpg_idx", S.logit(F.coalesce("p", F.lit(0.5))).alias("logit"))


#: Rows that a task sorts at a time, about.
PER_TASK = 1 << 21


def parts_of(spark: SparkSession, rows: int) -> int:
    """How many partitions ``rows`` rows are sorted in: those of the session, and more of them for more rows, so that a task's sort stays as it is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PER_TASK), 1)


def targets(codes: DataFrame, sampled: DataFrame, ladder: DataFrame, parts: int | None = None) -> DataFrame:
    """(rep, cell_id, cpg_idx, y): true values of the CpGs that a replicate doesn't see; in ``parts`` partitions, if given."""
    keys = ["rep", "cell_id", "cpg_idx"]
    rows, seen = codes.crossJoin(F.broadcast(ladder.select("rep"))), sampled.select(*keys)
    if parts:
        rows, seen = rows.repartition(parts, *keys), seen.repartition(parts, *keys)
    return rows.join(seen, keys, "left_anti").select(*keys, (F.col("code") / 65534.0).alias("y"))


def target_scan(rows: DataFrame, places: DataFrame, units: DataFrame, want: int, seed: int = 1, parts: int | None = None) -> DataFrame:
    """(rep, cell_id, unit, cpg_idx, y): of a unit's targets the first ``want`` from a seeded start on, going round.

    ``rows`` are targets, ``places`` (dest, unit, cpg_idx) and ``units`` (unit,
    output_offset, cpg_count). A group is one unit of one cell and replicate, so no larger than a unit;
    with ``parts`` rows are sorted in so many partitions.
    """
    local = places.join(units.select("unit", "output_offset", "cpg_count"), "unit").select("unit", "cpg_idx", (F.col("dest") - F.col("output_offset")).alias("local"), "cpg_count")
    own = ["rep", "cell_id", "unit"]
    start = F.floor(S.uniform(seed, F.lit("t"), F.col("rep"), F.col("cell_id"), F.col("unit")) * F.col("cpg_count")).cast("long")
    order = Window.partitionBy(*own).orderBy(F.pmod(F.col("local") - start, F.col("cpg_count")))
    if parts:
        rows, local = rows.repartition(parts, "cpg_idx"), local.repartition(parts, "cpg_idx")
    rows = rows.join(local, "cpg_idx")
    rows = rows.repartition(parts, *own) if parts else rows
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= want).select(*own, "cpg_idx", "y")


def stratified_batch(groups: DataFrame, easy: list[int], batch: int, fraction: float, seed: int = 1) -> DataFrame:
    """(cpg_idx, group, pool): a seeded batch of grouped CpGs, ``fraction`` of it from the easy groups and the rest from the others.

    A pool with fewer CpGs gives all it has. Each pool's share is a top-k by a stateless order, so no pool is sorted whole.
    """
    active = groups.where(F.col("group") > 0).withColumn("pool", F.when(F.col("group").isin(easy), "easy").otherwise("variable")).withColumn("key", S.key_of(seed, F.col("cpg_idx")))
    share = int(batch * fraction + 0.5)
    parts = [active.where(F.col("pool") == pool).orderBy("key", "cpg_idx").limit(n) for pool, n in (("easy", share), ("variable", batch - share))]
    return parts[0].unionByName(parts[1]).select("cpg_idx", "group", "pool")
