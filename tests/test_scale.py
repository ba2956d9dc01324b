"""What is stored, sorted and shipped: the training store, threshold sampling, tiles of cells and buckets of CpGs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.operators import features as X
from cpgloom.operators import simulate as M
from cpgloom.operators import store as Z
from cpgloom.operators import upscale as V


def triples(df):
    return sorted(map(tuple, df.collect()))


def test_store_gives_the_targets_back(spark, tmp_path):
    """Lists and bitmaps both occur; targets are those of the anti join, for all replicates and for one."""
    codes = spark.range(9000).selectExpr("id % 3 AS cell_id", "CASE WHEN id < 6000 THEN id ELSE id + 30000 END AS cpg_idx", "CAST(id * 7 % 65535 AS INT) AS code")
    ladder = spark.createDataFrame([(0, 5), (1, 9000), (2, 40)], "rep int, sample long")
    sampled = codes.crossJoin(spark.createDataFrame([(0, 1000), (1, 1), (3, 1)], "rep int, every int")).where("rep <> 3 AND code % every = 0 AND (rep <> 1 OR cell_id = 0 OR cpg_idx % 2 = 0)").select("rep", "cell_id", "cpg_idx")
    full = spark.range(4000).selectExpr("2 AS rep", "5L AS cell_id", "id AS cpg_idx")  # a cell without any truth, dense enough for a bitmap
    sampled = sampled.unionByName(full)
    Z.save(str(tmp_path / "s"), sampled, codes, ladder)
    store = Z.load(spark, str(tmp_path / "s"))
    forms = store["members"].groupBy(F.col("bits").isNull()).count().collect()
    assert len(forms) == 2 and store["members"].where(F.col("bits").isNotNull()).count() == 1
    assert triples(Z.targets(store)) == triples(M.targets(codes, sampled, ladder))
    one = Z.targets(store, [1])
    assert triples(one) == triples(M.targets(codes, sampled, ladder.where("rep = 1")))
    assert "PartitionFilters: [isnotnull(rep" in one._jdf.queryExecution().toString() or "PartitionFilters: [(rep" in one._jdf.queryExecution().toString()
    got = {r["sample"]: r for r in Z.levels(store).collect()}
    assert (got[5]["n_reps"], got[5]["n_observed"]) == (1, sampled.where("rep = 0").count()) and got[40]["n_observed"] == 4000 and got[40]["n_cells"] == 1


def test_unsound_stores_are_refused(spark, tmp_path):
    codes, ladder = spark.createDataFrame([(1, 2, 3)], "cell_id long, cpg_idx long, code int"), spark.createDataFrame([(0, 1)], "rep int, sample long")
    Z.save(str(tmp_path / "a"), spark.createDataFrame([(4, 1, 2)], "rep int, cell_id long, cpg_idx long"), codes, ladder)
    with pytest.raises(ValueError):
        Z.load(spark, str(tmp_path / "a"))
    Z.save(str(tmp_path / "b"), spark.createDataFrame([(0, 1, 2)], "rep int, cell_id long, cpg_idx long"), codes, ladder)
    Z.load(spark, str(tmp_path / "b"))["members"].withColumn("n", F.lit(2)).write.partitionBy("rep").mode("append").parquet(str(tmp_path / "b" / "members"))
    with pytest.raises(ValueError):
        Z.load(spark, str(tmp_path / "b"))
    empty = codes.limit(0)
    Z.save(str(tmp_path / "c"), empty.selectExpr("1 AS rep", "cell_id", "cpg_idx"), empty, ladder)
    assert Z.targets(Z.load(spark, str(tmp_path / "c"))).count() == 0


def plain_sample(obs, ladder, seed):
    """Every covered CpG in its order."""
    out = []
    keyed = obs.where("m + u > 0").crossJoin(ladder).select("rep", "sample", "cell_id", "cpg_idx", S.key_of(seed, F.col("rep"), F.col("cell_id"), F.col("cpg_idx")).alias("key")).collect()
    groups = {}
    for r in keyed:
        groups.setdefault((r["rep"], r["sample"], r["cell_id"]), []).append((r["key"], r["cpg_idx"]))
    for (rep, size, cell), rows in groups.items():
        out += [(rep, cell, c) for _, c in sorted(rows)[:size]]
    return sorted(out)


def test_sampling_sorts_little_more_than_it_keeps(spark):
    obs = spark.range(30_000).selectExpr("id % 3 AS cell_id", "id AS cpg_idx", "IF(id % 11 = 0, 0L, 1L) AS m", "0L AS u")
    ladder = spark.createDataFrame([(0, 2000), (1, 3000)], "rep int, sample long")
    got = M.sample(obs, ladder, 5)
    assert sorted((r["rep"], r["cell_id"], r["cpg_idx"]) for r in got.collect()) == plain_sample(obs, ladder, 5)
    assert got.count() == 15_000 and M.near_sample(obs, ladder, 5).count() <= 1.2 * 15_000


def test_sampling_mends_cells_with_too_few(spark, monkeypatch):
    """With a bound that is far too low, all cells are sorted whole; sizes of 0 and above all CpGs."""
    obs = spark.range(600).selectExpr("id % 3 AS cell_id", "id AS cpg_idx", "1L AS m", "id % 2 AS u")
    ladder = spark.createDataFrame([(0, 0), (1, 7), (2, 1000)], "rep int, sample long")
    want = plain_sample(obs, ladder, 1)
    assert sorted((r["rep"], r["cell_id"], r["cpg_idx"]) for r in M.sample(obs, ladder).collect()) == want
    near = M.near_sample
    monkeypatch.setattr(M, "near_sample", lambda *a: near(*a).where("rep <> 1 OR cell_id <> 2"))
    assert sorted((r["rep"], r["cell_id"], r["cpg_idx"]) for r in M.sample(obs, ladder).collect()) == want


def test_units_are_sent_once_for_each_tile(spark):
    rng = np.random.default_rng(3)
    cells = [(int(c), rng.normal(size=3).tolist()) for c in range(50)]
    units = [(0, "factor", 1, [0.1], [1.0, -1.0, 0.5], [0.5, -1.0], [-0.2, 0.3], [0, 2]), (1, "direct", 0, [], [0.0, 1.0, 2.0], [], [0.05], [1]), (7, "direct", 0, [], [], [], [], [])]
    inputs = spark.createDataFrame(cells, "cell_id long, x array<double>")
    table = spark.createDataFrame(units, "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>")
    for tile in (8, 1000):
        rows, tiles = V.tiled(inputs, table, tile)
        sent = {r["unit"]: r["count"] for r in rows.where("unit IS NOT NULL").groupBy("unit").count().collect()}
        assert tiles == max(-(-50 // tile), 1) and set(sent.values()) == {tiles}
        cell_rows = rows.where("unit IS NULL").count()
        assert cell_rows == 50 * max(-(-4 // tiles), 1)  # four partitions
        out = V.upscale(inputs, table, tile=tile)
        assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
        got = {(r["cell_id"], r["cpg_idx"]): (r["p"], r["call"]) for r in out.collect()}
        assert len(got) == 150 == out.count()
        for c, x in cells:
            h = x[0] - x[1] + 0.5 * x[2] + 0.1
            for g, z in ((0, 0.5 * h - 0.2), (2, -h + 0.3), (1, x[1] + 2 * x[2] + 0.05)):
                p = 1 / (1 + np.exp(-z))
                assert got[c, g] == (pytest.approx(p), p > 0.5)
    assert V.upscale(inputs.limit(0), table).count() == 0 and V.upscale(inputs, table.limit(0)).count() == 0


def test_output_is_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(V, "AT_ONCE", 4)
    inputs = spark.createDataFrame([(c, [float(c)]) for c in range(9)], "cell_id long, x array<double>")
    table = spark.createDataFrame([(0, "direct", 0, [], [1.0, 0.0, -1.0], [], [0.0] * 3, [5, 6, 7])], "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>")
    assert V.upscale(inputs, table).select("cell_id", "cpg_idx").distinct().count() == 27


def test_bucketed_observations_stay_where_they_are(spark):
    """The plan has no exchange below the sums of cells and states but that of the cells' names."""
    obs = spark.range(4000).selectExpr("id % 20 AS cell_id", "id * 7 % 500 AS cpg_idx", "id % 3 AS m", "id % 2 AS u").groupBy("cell_id", "cpg_idx").agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    mask = spark.range(500).selectExpr("id AS cpg_idx", "CONCAT('P', id % 4 + 1) AS state")
    states = ["P1", "P2", "P3", "P4"]
    kept = X.bucketed(obs, "obs", 4), X.bucketed(mask, "mask", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = X.features(*kept, states)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert exchanges and not any("hashpartitioning(cpg_idx" in x for x in exchanges) and "SortMergeJoin [cpg_idx" in plan
        assert any("hashpartitioning(cpg_idx" in x for x in X.features(obs, mask, states)._jdf.queryExecution().executedPlan().toString().split("\n"))
        rounded = lambda t: sorted((r["cell_id"], r["pattern"], r["n_o"], None if r["beta"] is None else round(r["beta"], 9)) for r in t.collect())
        assert rounded(df) == rounded(X.features(obs, mask, states))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
