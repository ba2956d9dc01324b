"""Pattern mining: calls, ambiguity, patterns of samples, ranks, memberships and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S

MAX_AMBIGUOUS, FOLD = 1.0, 10
#: Digits by which patterns of equal count are grouped for ranking.
LEAD = 12


def site_calls(obs: DataFrame, cpgs: DataFrame, ns: int, threshold: float = 0.5, mincov: int = 1) -> DataFrame:
    """(cpg_idx, n1, n0, digits): calls of each CpG, ``digits`` mapping samples to 0 or 1.

    One grouped aggregation; the grid of samples and CpGs is never made. A CpG
    without observations comes from ``cpgs`` with an empty map. ``obs`` has one
    row for each sample and CpG; a repeated one is an error.
    """
    called = obs.withColumn("digit", S.call(threshold, mincov)).where(F.col("digit").isNotNull() & (F.col("sample_id") < ns))
    grouped = called.groupBy("cpg_idx").agg(
        F.sum("digit").cast("long").alias("n1"), F.sum(1 - F.col("digit")).cast("long").alias("n0"), F.map_from_entries(F.collect_list(F.struct("sample_id", "digit"))).alias("digits")
    )
    return cpgs.join(grouped, "cpg_idx", "left").select("cpg_idx", F.coalesce("n1", F.lit(0).cast("long")).alias("n1"), F.coalesce("n0", F.lit(0).cast("long")).alias("n0"), F.coalesce("digits", F.create_map().cast("map<int,int>")).alias("digits"))


def cell_calls(sites: DataFrame, ns: int) -> DataFrame:
    """(cpg_idx, sample_id, digit) for every sample, null where ambiguous."""
    return sites.select("cpg_idx", "digits", F.explode(F.sequence(F.lit(0), F.lit(ns - 1))).alias("sample_id")).select("cpg_idx", "sample_id", F.try_element_at("digits", F.col("sample_id")).alias("digit"))


def ambiguity(sites: DataFrame, ns: int, max_ambiguous: float = MAX_AMBIGUOUS, fold: int = FOLD) -> DataFrame:
    """Adds namb, sweeping and is_pna. The majority sweeps if the minority is 0 or ``fold`` times smaller."""
    hi, lo = F.greatest("n1", "n0"), F.least("n1", "n0")
    sites = sites.withColumn("namb", F.lit(ns).cast("long") - F.col("n1") - F.col("n0"))
    sites = sites.withColumn("sweeping", (hi > 0) & ((lo == 0) | (hi >= fold * lo)))
    return sites.withColumn("is_pna", (F.col("namb") > max_ambiguous * ns) | ((F.col("namb") > 0) & ~F.col("sweeping")))


def cpg_pattern(sites: DataFrame, ns: int) -> DataFrame:
    """(cpg_idx, pattern): one digit for each sample, ambiguous ones filled by the majority (ties: 0); all 2 for PNA."""
    fill = F.when(F.col("n1") > F.col("n0"), 1).otherwise(0)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ns - 1)), lambda s: F.coalesce(F.try_element_at("digits", s), fill).cast("string")), "")
    return sites.select("cpg_idx", F.when(F.col("is_pna"), F.lit("2" * ns)).otherwise(digits).alias("pattern"))


def mine(obs: DataFrame, cpgs: DataFrame, ns: int, threshold: float = 0.5, mincov: int = 1, max_ambiguous: float = MAX_AMBIGUOUS, fold: int = FOLD) -> DataFrame:
    """(cpg_idx, pattern) from observations in one step."""
    return cpg_pattern(ambiguity(site_calls(obs, cpgs, ns, threshold, mincov), ns, max_ambiguous, fold), ns)


def pattern_rank(patterns: DataFrame, ns: int) -> DataFrame:
    """(rank, label, pattern, n): real patterns by count descending, then pattern.

    Only the aggregated patterns are ranked; the CpGs stay where they are. They
    are numbered within groups of equal count and first digits, and shifted by
    the groups' offsets, so no task numbers all patterns.
    """
    counted = patterns.where(F.col("pattern") != "2" * ns).groupBy("pattern").agg(F.count("*").alias("n")).withColumn("lead", F.substring("pattern", 1, LEAD))
    groups = counted.groupBy("n", "lead").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n"), "lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = groups.select("n", "lead", before.alias("before"))
    rows = counted.withColumn("rn", F.row_number().over(Window.partitionBy("n", "lead").orderBy("pattern")) - 1).join(offsets, ["n", "lead"])
    return rows.withColumn("rank", (F.col("before") + F.col("rn")).cast("int")).select("rank", S.label_of(F.col("rank")).alias("label"), "pattern", "n")


def membership(patterns: DataFrame, ranked: DataFrame) -> DataFrame:
    """(cpg_idx, rank): null for PNA."""
    return patterns.join(ranked.select("pattern", "rank"), "pattern", "left").select("cpg_idx", "rank")


def counts_with_pna(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern").agg(F.count("*").alias("n")).select("n", "pattern")


def checksum(patterns: DataFrame) -> DataFrame:
    """(checksum, groups): exclusive or of a hash of each pattern with its count, whatever the order."""
    key = F.conv(F.substring(S.key_of(F.col("pattern"), F.col("n")), 1, 15), 16, 10).cast("long")
    return counts_with_pna(patterns).agg(F.bit_xor(key).alias("checksum"), F.count("*").alias("groups"))


def mask(members: DataFrame, top: int, pna: str = "Pna") -> DataFrame:
    """(cpg_idx, state): P<rank + 1> of the first ``top`` patterns, else the PNA label."""
    return members.select("cpg_idx", F.when(F.col("rank") < top, S.label_of(F.col("rank"))).otherwise(F.lit(pna)).alias("state"))


def trim(masked: DataFrame, keep: list[str], pna: str = "Pna") -> DataFrame:
    return masked.select("cpg_idx", F.when(F.col("state").isin(keep), F.col("state")).otherwise(F.lit(pna)).alias("state"))


def group_map(masked: DataFrame, patterns: int) -> DataFrame:
    return masked.select("cpg_idx", S.group_of(F.col("state"), patterns).alias("group"))


def summary(patterns: DataFrame, ns: int) -> DataFrame:
    """(key, value): sizes of a pattern set."""
    pna = F.sum((F.col("pattern") == "2" * ns).cast("long"))
    one = patterns.agg(F.count("*").alias("n_cpg"), F.count_distinct("pattern").alias("kinds"), pna.alias("n_pna"))
    rows = F.array(
        F.struct(F.lit("n_cpg").alias("key"), F.col("n_cpg").cast("double").alias("value")),
        F.struct(F.lit("n_samples").alias("key"), F.lit(float(ns)).alias("value")),
        F.struct(F.lit("n_patterns").alias("key"), (F.col("kinds") - F.when(F.col("n_pna") > 0, 1).otherwise(0)).cast("double").alias("value")),
        F.struct(F.lit("n_pna").alias("key"), F.col("n_pna").cast("double").alias("value")),
        F.struct(F.lit("pna_percent").alias("key"), F.round(100.0 * F.col("n_pna") / F.col("n_cpg"), 4).alias("value")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.key", "r.value")
