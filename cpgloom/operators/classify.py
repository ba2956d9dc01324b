"""Classifiers: mean-difference and logistic linear models, and entropy confidence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.sources.artifacts import stage


def class_index(labels: DataFrame) -> DataFrame:
    """(label, class_idx): distinct labels in byte order."""
    return labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("class_idx"))


def check_classes(labels: DataFrame, exactly: int | None = None) -> None:
    """Classifiers need two classes or more, linear models exactly two; anything else is an error."""
    n = labels.select("label").where(F.col("label").isNotNull()).distinct().limit((exactly or 1) + 1).count()
    if n < 2 or exactly is not None and n != exactly:
        raise ValueError(f"need {'at least two' if exactly is None else f'exactly {exactly}'} classes")


def two_classes(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """(cell_id, label, y) with y the place of the label in byte order, and the two names; labels of more or fewer classes are an error."""
    labels = labels.select("cell_id", "label").where(F.col("label").isNotNull())
    check_classes(labels, 2)
    names = sorted(r["label"] for r in labels.select("label").distinct().collect())
    return labels.withColumn("y", (F.col("label") == names[1]).cast("int")), names


def feature_means(feat: DataFrame, labels: DataFrame) -> DataFrame:
    """(pattern, ord, mean, mu0, mu1): a class without values takes the overall mean, which is 0 without any."""
    rows = feat.join(labels.select("cell_id", "y"), "cell_id")
    rows = rows.groupBy("pattern", "ord").agg(F.avg("beta").alias("a"), F.avg(F.when(F.col("y") == 0, F.col("beta"))).alias("b"), F.avg(F.when(F.col("y") == 1, F.col("beta"))).alias("c"))
    mean = F.coalesce("a", F.lit(0.0))
    return rows.select("pattern", "ord", mean.alias("mean"), F.coalesce("b", mean).alias("mu0"), F.coalesce("c", mean).alias("mu1"))


def projected(feat: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell_id, s): weighted sum of the betas, missing ones at the mean. ``weights`` has a row for each pattern."""
    rows = feat.join(weights.select("pattern", "weight", "mean"), "pattern")
    return rows.groupBy("cell_id").agg(F.sum(F.col("weight") * F.coalesce("beta", "mean")).alias("s"))


def _check_two(labels: DataFrame) -> None:
    """A linear model's cells are of both classes, y being 0 and 1; else it is an error."""
    found = labels.agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b"), F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("c")).first()
    if not found["a"] or not found["b"] or found["c"]:
        raise ValueError("a linear model needs exactly two classes, numbered 0 and 1")


def fit_threshold(feat: DataFrame, labels: DataFrame) -> DataFrame:
    """(pattern, weight, mean, bias, scale): class mean differences; the cut lies midway between the classes' mean scores."""
    _check_two(labels)
    weights = feature_means(feat, labels).select("pattern", (F.col("mu1") - F.col("mu0")).alias("weight"), "mean")
    scores = projected(feat, weights).join(labels.select("cell_id", "y"), "cell_id")
    cut = scores.agg(F.avg(F.when(F.col("y") == 0, F.col("s"))).alias("c0"), F.avg(F.when(F.col("y") == 1, F.col("s"))).alias("c1"))
    half = (F.col("c1") - F.col("c0")) / 2
    cut = cut.select((-(F.col("c0") + F.col("c1")) / 2).alias("bias"), F.when(half <= 1e-9, 1.0).otherwise(half).alias("scale"))
    return weights.crossJoin(cut)  # one row beside each weight


def fit_logistic(feat: DataFrame, labels: DataFrame, rounds: int = 200) -> DataFrame:
    """(pattern, weight, mean, bias, scale) by logistic regression with a ridge of 1 on standardised weights.

    Features are standardised by their population deviation after mean
    imputation (deviation 1 where below 1e-6). The convex fit runs distributed;
    its ridge is 1 / rows in mean-loss terms. Weights are folded back to betas.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    _check_two(labels)
    means = feature_means(feat, labels).select("pattern", "ord", "mean")
    filled = feat.join(means.drop("ord"), "pattern").withColumn("x", F.coalesce("beta", "mean"))
    spread = filled.groupBy("pattern").agg(F.var_pop("x").alias("v")).select("pattern", F.when(F.col("v") > 1e-12, F.sqrt("v")).otherwise(1.0).alias("sd"))
    rows = filled.join(spread, "pattern").withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))
    vectors = rows.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "z"))), lambda t: t["z"]).alias("v")).join(labels.select("cell_id", F.col("y").cast("double").alias("label")), "cell_id")
    vectors = stage(vectors, "vectors")  # counted, and read in each round of the fit
    n = max(vectors.count(), 1)
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-10).fit(vectors.select(array_to_vector("v").alias("features"), "label"))
    info = means.join(spread, "pattern").orderBy("ord").collect()  # one row for each pattern of the model
    w = np.array([float(c) for c in model.coefficients]) / np.array([r["sd"] for r in info])
    bias = float(model.intercept) - float(w @ np.array([r["mean"] for r in info]))
    return feat.sparkSession.createDataFrame([(r["pattern"], float(x), r["mean"], bias, 1.0) for r, x in zip(info, w)], "pattern string, weight double, mean double, bias double, scale double")


def score_linear(feat: DataFrame, model: DataFrame, names: list[str] | None = None, probs: bool = False) -> DataFrame:
    """(cell_id, label, p1, confidence[, probs]): the second class from p1 = 0.5 on.

    label is 0 or 1, or the class's name if ``names`` has both; ``probs`` are the probabilities of both classes in order.
    """
    cut = model.select("bias", "scale").limit(1)
    p = S.sigmoid((F.col("bias") + F.col("s")) / F.col("scale"))
    rows = projected(feat, model).crossJoin(cut).select("cell_id", p.alias("p1"))
    second = F.col("p1") >= 0.5
    label = second.cast("int") if names is None else F.when(second, names[1]).otherwise(names[0])
    more = [F.array(1 - F.col("p1"), F.col("p1")).alias("probs")] if probs else []
    return rows.select("cell_id", label.alias("label"), "p1", S.entropy_confidence([F.col("p1"), 1 - F.col("p1")]).alias("confidence"), *more)


def decide(p: list[Column]) -> tuple[Column, Column]:
    """Class of the largest probability (the last of equals) and the confidence."""
    best = F.array_max(F.array(*[F.struct(x.alias("p"), F.lit(i).alias("i")) for i, x in enumerate(p)]))["i"]
    return best, S.entropy_confidence(p)


def logistic_slopes(feat: DataFrame, labels: DataFrame, model: DataFrame) -> DataFrame:
    """(pattern, slope): how steep the fit's objective still is in each standardised weight; all 0 at the optimum."""
    means = feature_means(feat, labels).select("pattern", "mean")
    filled = feat.join(means, "pattern").withColumn("x", F.coalesce("beta", "mean"))
    spread = filled.groupBy("pattern").agg(F.var_pop("x").alias("v")).select("pattern", F.when(F.col("v") > 1e-12, F.sqrt("v")).otherwise(1.0).alias("sd"))
    cut = model.select("bias").limit(1)
    error = projected(feat, model).crossJoin(cut).join(labels.select("cell_id", "y"), "cell_id").select("cell_id", (S.sigmoid(F.col("s") + F.col("bias")) - F.col("y")).alias("e"))
    rows = filled.join(spread, "pattern").join(error, "cell_id").join(model.select("pattern", "weight"), "pattern")
    return rows.groupBy("pattern").agg((F.sum(F.col("e") * (F.col("x") - F.col("mean")) / F.col("sd")) + F.first(F.col("weight") * F.col("sd"))).alias("slope"))
