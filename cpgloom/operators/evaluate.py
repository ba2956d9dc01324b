"""Evaluation: error metrics, strata, paired comparison, bootstrap intervals, coverage ladders, pilot choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.sources.artifacts import stage


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    d = F.col(p) - F.col(y)
    return [
        F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.corr(y, p).alias("pearson"),
        F.avg((F.abs(d) <= 0.05).cast("double")).alias("within_005"),
    ]


def metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(*metric_columns())


def strata(rows: DataFrame, by: str) -> DataFrame:
    """Metrics of each class and of all rows (class 'all')."""
    return rows.rollup(by).agg(*metric_columns(), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(by)).alias(by), "n", "rmse", "mae", "pearson", "within_005")


def contribution(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, d_mae, contrib): each unit's change from prediction ``p`` to ``q``, and its share of the total change."""
    units = rows.groupBy(by).agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("q") - F.col("y"))) - F.avg(F.abs(F.col("p") - F.col("y")))).alias("d_mae"))
    return units.withColumn("contrib", F.col("d_mae") * F.col("n") / F.sum("n").over(Window.partitionBy()))


def weighted_mae(units: DataFrame) -> DataFrame:
    """(class, mae_a, mae_b, delta) from (class, n, mae_a, mae_b) unit rows."""
    a, b = (F.sum(F.col("n") * F.col(c)) / F.sum("n") for c in ("mae_a", "mae_b"))
    return units.groupBy("class").agg(a.alias("mae_a"), b.alias("mae_b"), (b - a).alias("delta"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str = "beta", threshold: float = 0.5) -> DataFrame:
    """(n, na_agreement, max_diff, label_agreement) of two results on their common keys.

    na_agreement is the share of keys missing in both or in neither; the
    difference and the calls (above ``threshold`` or not) are over keys with both values.
    """
    x, y = F.col("x"), F.col("y")
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    same = ((x > threshold) == (y > threshold)).cast("double")
    return both.agg(F.count("*").alias("n"), F.avg((x.isNull() == y.isNull()).cast("double")).alias("na_agreement"), F.max(F.abs(x - y)).alias("max_diff"), F.avg(same).alias("label_agreement"))


def key_match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(n_both, only_a, only_b): how far two tables have the same keys. Paired comparisons need the last two to be 0."""
    left, right = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    x, y = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return left.join(right, keys, "full_outer").agg(F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))


def bootstrap(deltas: DataFrame, draws: int, seed: int = 1, nearest: bool = False) -> DataFrame:
    """(mean, lo, hi): 95 % interval of the mean delta over ``draws`` resamples.

    Limits are interpolated, or with ``nearest`` the means of the nearest ranks.

    ``deltas`` is (i, d) with i from 0. A resample draws as many rows as there
    are, at places that depend on seed, draw and position; deltas are few (one a
    unit or a row of an evaluation), so the drawn places join them broadcast.
    """
    spark = deltas.sparkSession
    n = deltas.count()
    if not n:
        return deltas.agg(F.avg("d").alias("mean"), F.avg("d").alias("lo"), F.avg("d").alias("hi"))
    places = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("draw"), F.floor(S.uniform(seed, F.col("id")) * n).cast("long").alias("i"))
    means = places.join(deltas, "i").groupBy("draw").agg(F.avg("d").alias("m"))
    if nearest:  # one mean for each draw
        ordered = F.sort_array(F.collect_list("m"))
        limits = means.agg(*[F.element_at(ordered, round((draws - 1) * q) + 1).alias(c) for q, c in ((0.025, "lo"), (0.975, "hi"))])
    else:
        limits = means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return deltas.agg(F.avg("d").alias("mean")).crossJoin(limits)


def parse_levels(text: str, n_cpg: int) -> list[int]:
    """Sizes from a list such as "0.5%,200": shares of all CpGs, or counts; each size once, rising."""
    words = [w for w in map(str.strip, text.split(",")) if w]
    if not words:
        raise ValueError("no levels")
    return sorted({round(float(w[:-1]) / 100 * n_cpg) if w.endswith("%") else int(w) for w in words})


def coverage_ladder(obs: DataFrame, members: DataFrame, levels: list[int], patterns: int, seed: int = 1, depth: int = 0) -> DataFrame:
    """(level, mae): error of pattern means from the first ``level`` CpGs of one nested order of each cell, on the others.

    With a ``depth``, a mean is over fractions of that many drawn reads at each CpG.
    """
    order = Window.partitionBy("cell_id").orderBy(S.key_of(seed, F.col("cell_id"), F.col("cpg_idx")), "cpg_idx")
    rows = obs.where(S.coverage() > 0).select("cell_id", "cpg_idx", S.beta().alias("b")).withColumn("rn", F.row_number().over(order))
    seen = S.binomial_fraction(F.col("b"), depth, seed, F.lit("d"), F.col("cell_id"), F.col("cpg_idx")) if depth else F.col("b")
    rows = stage(rows.join(members.where(F.col("rank") < patterns), "cpg_idx").select("cell_id", "rank", "rn", "b", seen.alias("seen")), "ladder-rows")
    levels = sorted(set(levels))
    # sums between two levels, added up over the levels: a cell's pattern has a few small rows
    between = F.size(F.filter(F.array(*map(F.lit, levels)), lambda x: x < F.col("rn")))
    sums = rows.where(F.col("rn") <= levels[-1]).groupBy("cell_id", "rank", between.alias("at")).agg(F.sum("seen").alias("s"), F.count("seen").alias("n"))
    sums = sums.groupBy("cell_id", "rank").agg(F.collect_list(F.struct("at", "s", "n")).alias("v"))

    def mean(at: int) -> Column:
        own = F.filter("v", lambda x: x["at"] <= at)
        s, n = F.aggregate(own, F.lit(0.0), lambda t, x: t + F.coalesce(x["s"], F.lit(0.0))), F.aggregate(own, F.lit(0.0), lambda t, x: t + x["n"])
        return F.struct(F.lit(levels[at]).alias("level"), F.try_divide(s, n).alias("p"))

    means = sums.select("cell_id", "rank", F.array(*[mean(k) for k in range(len(levels))]).alias("means"))
    held = rows.join(means, ["cell_id", "rank"]).select("b", F.explode(F.filter("means", lambda m: (m["level"] < F.col("rn")) & m["p"].isNotNull())).alias("m"))
    return held.groupBy("m.level").agg(F.avg(F.abs(F.col("m.p") - F.col("b"))).alias("mae"))


def spaced(n: Column, pick: int) -> Column:
    """The ``pick`` evenly spaced of n places, both ends among them; halves are rounded to the even one."""
    step = (n - 1) / F.lit(float(max(pick - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(pick - 1)), lambda j: F.bround(j * step, 0).cast("int"))


def target_variance(codes: DataFrame, places: DataFrame, units: DataFrame, train_cells: DataFrame, per_unit: int = 1024) -> DataFrame:
    """(unit, variance) of the training cells' true values at up to ``per_unit`` evenly spaced places of each unit.

    ``places`` is (dest, unit, cpg_idx). A unit without any value has none.
    """
    local = places.join(units.select("unit", "output_offset", "cpg_count"), "unit").withColumn("local", F.col("dest") - F.col("output_offset"))
    take = F.least(F.col("cpg_count"), F.lit(per_unit))
    # the place that is nearest below on the grid of ``take`` places
    j = F.ceil(F.col("local") * (take - 1) / F.greatest(F.col("cpg_count") - 1, F.lit(1)))
    chosen = (F.col("local") == F.col("cpg_count") - 1) | (F.floor(j * (F.col("cpg_count") - 1) / F.greatest(take - 1, F.lit(1))) == F.col("local"))
    chosen = F.when(take == 1, F.col("local") == 0).otherwise(chosen)
    rows = codes.join(train_cells.select("cell_id"), "cell_id").join(local.where(chosen).select("unit", "cpg_idx"), "cpg_idx")
    return rows.groupBy("unit").agg(F.var_pop(F.col("code") / 65534.0).alias("variance"))


def pilot(units: DataFrame, mixed: int = 6, pna: int = 8, strict: bool = True) -> DataFrame:
    """(unit, class): evenly spaced picks of each quarter of the mixed units by variance, and of the background units in order.

    ``units`` is (unit, class, variance), a row for each unit; pure units have no part. Too few units to pick from are an
    error; unless ``strict`` the places then fall on the same units, and a stratum gives what it has.
    """
    rows = units.where(F.col("class").isin("mixed", "PNA"))
    order = Window.partitionBy("class").orderBy(F.when(F.col("class") == "mixed", F.col("variance")).asc_nulls_last(), "unit")
    rows = rows.withColumn("quarter", F.when(F.col("class") == "mixed", F.ntile(4).over(order)).otherwise(0))
    group = Window.partitionBy("class", "quarter")
    rows = rows.withColumn("rn", F.row_number().over(group.orderBy(F.when(F.col("class") == "mixed", F.col("variance")).asc_nulls_last(), "unit")) - 1).withColumn("n", F.count("*").over(group))
    if strict:
        have = {(r["class"], r["quarter"]): r["n"] for r in rows.select("class", "quarter", "n").distinct().collect()}  # five rows
        if any(have.get(("mixed", q), 0) < mixed for q in (1, 2, 3, 4)) or have.get(("PNA", 0), 0) < pna:
            raise ValueError("too few units in a stratum")
    picked = F.when(F.col("class") == "mixed", F.array_contains(spaced(F.col("n"), mixed), F.col("rn"))).otherwise(F.array_contains(spaced(F.col("n"), pna), F.col("rn")))
    return rows.where(picked).select("unit", "class")


def pilot_metrics(trained: DataFrame, units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, class, cpgs, memberships, mode, bottleneck_dim, best_step, validation_n, validation_mae) of the wanted units; a direct head's dimension is 0."""
    own = units.join(wanted.select("unit"), "unit", "left_semi").select("unit", F.col("cpg_count").alias("cpgs"), F.col("membership_count").alias("memberships"))
    fit = trained.select("unit", "class", "mode", F.col("rank").alias("bottleneck_dim"), "best_step", F.col("checked").alias("validation_n"), F.col("best_mae").alias("validation_mae"))
    return fit.join(own, "unit").select("unit", "class", "cpgs", "memberships", "mode", "bottleneck_dim", "best_step", "validation_n", "validation_mae")


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, p, q): two models' predictions (keys, y, p) of the same targets side by side; each has the other's keys or it is an error."""
    both = a.select(*keys, "y", "p", F.lit(True).alias("in_a")).join(b.select(*keys, F.col("p").alias("q"), F.lit(True).alias("in_b")), keys, "full_outer")
    lone = F.col("in_a").isNull() | F.col("in_b").isNull()
    return both.select(*keys, "y", F.when(lone, F.raise_error(F.lit("the models' keys differ")).cast("double")).otherwise(F.col("p")).alias("p"), "q")


def paired_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mae_a, mae_b, delta): both models' errors on each row of targets, for intervals by rows."""
    a, b = F.avg(F.abs(F.col("p") - F.col("y"))), F.avg(F.abs(F.col("q") - F.col("y")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), a.alias("mae_a"), b.alias("mae_b"), (b - a).alias("delta"))


def candidates(*drawn: DataFrame, keys: list[str]) -> DataFrame:
    """(keys): all that any of the draws has, each once: the targets that every model is held to."""
    out = drawn[0].select(*keys)
    for rows in drawn[1:]:
        out = out.unionByName(rows.select(*keys))
    return out.distinct()


def compare(targets: DataFrame, models: dict[str, DataFrame], keys: list[str], by: list[str]) -> DataFrame:
    """(by, n, mae_<model> .., delta_<model> ..): errors of any number of models on the same targets (keys, y), for each row ``by`` of targets.

    A delta is against the first model. Models (keys, p) are gathered by key in
    one shuffle; a target that a model has no value for, or two, is an error, and
    what a model says of other keys doesn't count.
    """
    names = list(models)
    rows = targets.select(*keys, "y", F.lit(True).alias("asked"))
    for name, p in models.items():
        rows = rows.unionByName(p.select(*keys, F.col("p").alias(f"p_{name}")), allowMissingColumns=True)
    told = F.coalesce(F.sum(sum((F.col(f"p_{n}").isNotNull().cast("int") for n in names), F.lit(0))), F.lit(0))
    rows = rows.groupBy(*keys).agg(F.max("y").alias("y"), F.max("asked").alias("asked"), told.alias("told"), *[F.max(f"p_{n}").alias(f"p_{n}") for n in names]).where("asked")
    lone = (F.col("told") != len(names)) | F.greatest(*[F.col(f"p_{n}").isNull() for n in names], F.lit(False))
    y = F.when(lone, F.raise_error(F.lit("a model doesn't have one value for each target")).cast("double")).otherwise(F.col("y"))
    errors = rows.select(*by, *[F.abs(F.col(f"p_{n}") - y).alias(n) for n in names]).groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(n).alias(f"mae_{n}") for n in names])
    return errors.select("*", *[(F.col(f"mae_{n}") - F.col(f"mae_{names[0]}")).alias(f"delta_{n}") for n in names[1:]])


def compare_intervals(rows: DataFrame, by: str, names: list[str], draws: int, seed: int = 1) -> DataFrame:
    """(model, mean, lo, hi): 95 % intervals of the models' deltas in rows of ``compare``; all models share each draw of rows.

    Rows are those of an evaluation, a few for each cell; they are numbered in the order of ``by``.
    """
    numbered = stage(rows.select((F.row_number().over(Window.orderBy(by)) - 1).cast("long").alias("i"), *[f"delta_{n}" for n in names]), "deltas")
    n = numbered.count()
    places = rows.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).cast("long").alias("draw"), F.floor(S.uniform(seed, F.col("id")) * n).cast("long").alias("i"))
    means = places.join(numbered, "i").groupBy("draw").agg(*[F.avg(f"delta_{m}").alias(m) for m in names])
    limits = means.agg(*[F.percentile(m, F.lit(q)).alias(f"{c}_{m}") for m in names for q, c in ((0.025, "lo"), (0.975, "hi"))])
    whole = numbered.agg(*[F.avg(f"delta_{m}").alias(f"mean_{m}") for m in names]).crossJoin(limits)
    return whole.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"{c}_{m}").alias(c) for c in ("mean", "lo", "hi")]) for m in names])).alias("r")).select("r.*")


def class_gap(rows: DataFrame) -> DataFrame:
    """(class, n, mae_a, mae_b, gap, rmse_a, rmse_b) of targets in a ranked group (``group`` > 0: top), the residual ones, and all."""
    d, e = F.col("p") - F.col("y"), F.col("q") - F.col("y")
    by = rows.withColumn("class", F.explode(F.array(F.lit("all"), F.when(F.col("group") > 0, "top").otherwise("residual"))))
    by = by.groupBy("class").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae_a"), F.avg(F.abs(e)).alias("mae_b"), F.sqrt(F.avg(d * d)).alias("rmse_a"), F.sqrt(F.avg(e * e)).alias("rmse_b"))
    return by.select("class", "n", "mae_a", "mae_b", (F.col("mae_a") - F.col("mae_b")).alias("gap"), "rmse_a", "rmse_b")


def extremes(units: DataFrame, by: str, count: int = 12) -> DataFrame:
    """(side, place, by, contrib): the ``count`` units that add most to the change of the error (worst) and least (best)."""
    worst = units.orderBy(F.desc("contrib"), by).limit(count).withColumn("side", F.lit("worst"))
    best = units.orderBy(F.asc("contrib"), F.desc(by)).limit(count).withColumn("side", F.lit("best"))
    key = F.when(F.col("side") == "worst", -F.col("contrib")).otherwise(F.col("contrib"))
    tie = Window.partitionBy("side").orderBy(key, F.when(F.col("side") == "worst", F.col(by)), F.when(F.col("side") == "best", F.col(by)).desc())
    return worst.unionByName(best).select("side", F.row_number().over(tie).alias("place"), by, "contrib")


def rank_rollup(units: DataFrame) -> DataFrame:
    """(change, units, share, contrib) of (n, d_mae, rank_a, rank_b) units by whether the second model has a lower, higher or the same rank."""
    change = F.when(F.col("rank_b") < F.col("rank_a"), "demoted").when(F.col("rank_b") > F.col("rank_a"), "promoted").otherwise("unchanged")
    sums = units.groupBy(change.alias("change")).agg(F.count("*").alias("units"), F.sum("n").alias("n"), F.sum(F.col("d_mae") * F.col("n")).alias("d"))
    total = F.sum("n").over(Window.partitionBy())
    return sums.select("change", "units", (F.col("n") / total).alias("share"), (F.col("d") / total).alias("contrib"))


def levels(ladder: DataFrame) -> DataFrame:
    return ladder.groupBy("sample").agg(F.count("*").alias("n_reps"))
