"""What only tables larger than the smallest ones show: strata that run empty, many values, one step for many cells."""

import math

import numpy as np
import pyarrow as pa
import pytest
from exact_trees import Boosted
from pyspark.sql import functions as F

from cpgloom.operators import boost as G
from cpgloom.operators import evaluate as E
from cpgloom.operators import simulate as M
from cpgloom.operators import store as Z
from cpgloom.operators import train as T
from cpgloom.operators import upscale as V
from cpgloom.plans import registry
from cpgloom.sources import bindings as B


def test_pilot_of_few_units_gives_what_there_is(spark):
    """On large tables every pattern is a unit of its own, so no mixed unit is left."""
    rows = [(u, "pure", None) for u in range(3)] + [(u, "PNA", None) for u in range(3, 7)]
    units = spark.createDataFrame(rows, "unit int, class string, variance double")
    with pytest.raises(ValueError):
        E.pilot(units, 2, 2)
    assert sorted(r["unit"] for r in E.pilot(units, 2, 2, strict=False).collect()) == [3, 6]
    mixed = spark.createDataFrame([(u, "mixed", 0.1 * u) for u in range(5)], "unit int, class string, variance double")
    # quarters of 2, 1, 1 and 1
    assert sorted(r["unit"] for r in E.pilot(mixed, 2, 2, strict=False).collect()) == [0, 1, 2, 3, 4]


def heads(spark, units):
    return spark.createDataFrame(units, "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>")


_UNITS = [(0, "factor", 1, [0.1], [1.0, -1.0], [0.5, -1.0], [-0.2, 0.3], [0, 2]), (1, "direct", 0, [], [0.0, 1.0], [], [0.05], [1])]


def test_blocks_are_no_group_of_their_own(spark):
    """Networks pass with their cells in one stream: thousands of blocks of one CpG each are no calls."""
    n = 3000
    same = {c: [1.0] for c in V.NETWORK} | {"fill": [0.5], "mean": [0.0]}
    models = spark.range(n).select(F.col("id").alias("block"), *[F.array(*[F.lit(v) for v in same[c]]).alias(c) if c != "b2" else F.array(F.col("id") / n).alias(c) for c in V.NETWORK]).where("block % 10 <> 3")
    wanted = spark.range(4 * n).selectExpr("id % 7 * 70000 AS cell_id", f"id % {n} AS cpg_idx")
    inputs = spark.range(6).selectExpr("id * 70000 AS cell_id", "array(IF(id = 2, NULL, double(id))) AS x")
    out = V.predict_blocks(inputs, models, wanted.union(wanted), 1)
    assert "FlatMap" not in out._jdf.queryExecution().toString()
    got = {(r["cell_id"], r["cpg_idx"]): r["p"] for r in out.collect()}
    want = {}
    for c, g in {(i % 7 * 70000, i % n) for i in range(4 * n)}:
        if c < 420000 and g % 10 != 3:
            x = 0.5 if c == 140000 else c / 70000
            h = (max(x + 1, 0) - 1) / np.sqrt(1 + 1e-5) + 1
            want[c, g] = 1 / (1 + np.exp(-(h + g / n)))
    assert got.keys() == want.keys() == {(r["cell_id"], r["cpg_idx"]) for r in out.select("cell_id", "cpg_idx").collect()} and out.count() == len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cells_are_added_up_where_they_are_made(spark):
    """As many rows as tasks and cells leave the forward pass, whatever the CpGs, and they say what the grid of all says."""
    inputs = spark.createDataFrame([(c, [float(c), 0.5]) for c in range(40)], "cell_id long, x array<double>")
    for units, n, sound in ((_UNITS, 3, True), ([*_UNITS, (2, "direct", 0, [], [1.0, 0.0, 1.0, 0.0], [], [0.0, 1.0], [2, 9])], 4, False)):
        table = heads(spark, units)
        for tile in (8, 1000):
            p = V.upscale(inputs, table, tile=tile)
            inside = F.min((F.col("p") >= 0) & (F.col("p") <= 1)) & (F.count("*") == F.count_distinct("cpg_idx"))
            want = p.groupBy("cell_id").agg(F.count_distinct("cpg_idx"), F.min("cpg_idx"), F.max("cpg_idx"), inside)
            got = sorted(map(tuple, V.upscale_summary(inputs, table, tile=tile).collect()))
            assert got == sorted(map(tuple, want.collect())) and {(r[1], r[4]) for r in got} == {(n, sound)} and len(got) == 40
    assert V.upscale_summary(inputs.limit(0), heads(spark, _UNITS)).count() == 0


def test_calls_at_one_half_are_those_of_the_sums_in_order(spark):
    """Many cells are at one half but for the last bit, where the order of the sums and the exponential's rounding decide."""
    def leaky(v):
        return 0.01 * v if v < 0 else v

    shared = tuple(np.array(v, float) for v in ([[0.5, -1], [-1, 0.25]], [0.1, 0], [[1, -1], [0, 0.5]], [0.05, 0]))
    rows = [(1.988839743156844, 0.9868846104486323), (-0.1986425334028521, -0.24580909215618366), (0.536279917389773, 0.29776987910720665), (1.156618494820584, 0.6133670965351772), (1.0137861543356208, 0.4908261503257708)]
    want = {}
    for c, (x0, x1) in enumerate(rows):
        h0, h1 = leaky(0.5 * x0 - x1 + 0.1), leaky(0.25 * x1 - x0)
        u = h0 + leaky(h0 - h1 + 0.05) - h1 - leaky(0.5 * h1) + 0.1
        want |= {(c, 0): 1 / (1 + math.exp(-(0.5 * u - 0.2))), (c, 2): 1 / (1 + math.exp(u - 0.3))}
    for tile in (2, 100):
        out = V.upscale(spark.createDataFrame([(c, [*x]) for c, x in enumerate(rows)], "cell_id long, x array<double>"), heads(spark, _UNITS), shared=shared, tile=tile)
        got = {(r["cell_id"], r["cpg_idx"]): (r["p"], r["call"]) for r in out.where("cpg_idx <> 1").collect()}
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(p, abs=1e-12), p > 0.5) for k, p in want.items())
    # whatever the vector exponential gave
    p, unit = np.array([[0.5 + 2**-53, 0.9]]), {"mode": "direct", "A": np.array([[1.0], [5.0]]), "b": np.zeros(2)}
    V.settle_ties(p, np.array([[3 * 2.0**-54]]), unit)
    assert p.tolist() == [[0.5, 0.9]]


def test_heads_meet_only_their_own_rows(spark):
    inputs = spark.createDataFrame([(r, c, [float(c), 0.5]) for c in range(5) for r in range(2)], "rep int, cell_id long, x array<double>")
    rows = spark.createDataFrame([(0, 1, 0, [0, 1], [0.5, 0.25]), (0, 3, 1, [1], [1.0]), (1, 2, 0, [0], [0.0])], "unit int, cell_id long, rep int, local array<int>, y array<double>")
    out = T.errors(heads(spark, _UNITS), rows, inputs)
    s = lambda z: 1 / (1 + np.exp(-z))
    h = [c - 0.5 + 0.1 for c in range(5)]
    want = {0: (3, (abs(s(0.5 * h[1] - 0.2) - 0.5) + abs(s(0.3 - h[1]) - 0.25) + abs(s(0.3 - h[3]) - 1)) / 3), 1: (1, s(0.5 + 0.05))}
    assert {r["unit"]: (r["n"], pytest.approx(r["mae"])) for r in out.collect()} == want


def test_every_value_is_a_cut_without_bins(spark):
    """Far more values than bins, some missing: the first trees are those of the exact search, deeper ones and later rounds, too."""
    rng = np.random.default_rng(7)
    x = rng.uniform(size=(1500, 2)).astype(np.float32).astype(float)
    y = (x[:, 0] + 0.2 * rng.normal(size=1500) > 0.5).astype(int)
    x[rng.uniform(size=x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(i, "ab"[y[i]], *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, label string, P1 double, P2 double").repartition(3)
    for rounds, depth in ((1, 1), (2, 2)):
        want = Boosted(rounds, depth=depth).fit(x, y, 2)
        model = G.fit_boosted(rows, ["P1", "P2"], rounds=rounds, depth=depth, bins=None)
        got = np.array([r["probs"] for r in G.predict_boosted(model, rows, ["P1", "P2"], probs=True).orderBy("cell_id").collect()])
        np.testing.assert_allclose(got, want.predict(x), atol=1e-9)
        root = {r["class_idx"]: (r["feature"], r["cut"], r["missing_left"]) for r in model.where("round = 0 AND node = 0").collect()}
        assert root == {k: (t[0], pytest.approx(t[1], abs=1e-12), t[2]) for k, t in enumerate(want.trees[0])}


def test_more_rows_are_sorted_in_more_partitions(spark, monkeypatch):
    """A task's sort doesn't grow with the rows; targets and scans are the same in any number of partitions."""
    monkeypatch.setattr(M, "PER_TASK", 100)
    assert M.parts_of(spark, 5000) == 50 and M.parts_of(spark, 10) == 4
    codes = spark.range(600).selectExpr("id % 5 AS cell_id", "id DIV 5 AS cpg_idx", "CAST(id AS INT) AS code")
    ladder = spark.createDataFrame([(0, 5), (1, 9)], "rep int, sample long")
    sampled = codes.where("code % 7 = 0").selectExpr("code % 2 AS rep", "cell_id", "cpg_idx")
    places = spark.range(120).selectExpr("id AS dest", "CAST(id DIV 40 AS INT) AS unit", "(id * 7) % 120 AS cpg_idx")
    units = spark.createDataFrame([(u, 40 * u, 40) for u in range(3)], "unit int, output_offset long, cpg_count long")
    out = [M.target_scan(M.targets(codes, sampled, ladder, n), places, units, 4, parts=n) for n in (None, 13)]
    assert sorted(map(tuple, out[0].collect())) == sorted(map(tuple, out[1].collect())) and out[1].count() == 2 * 5 * 3 * 4
    assert "hashpartitioning(rep#" in (plan := out[1]._jdf.queryExecution().executedPlan().toString()) and ", 13), REPARTITION_BY_NUM" in plan


def test_stored_targets_leave_by_batches(spark):
    """Cells and blocks of one CpG each are no batches of their own."""
    n = 500
    one = lambda v, t: pa.array(v, t)
    batch = pa.RecordBatch.from_arrays([one([0] * n, pa.int32()), one(range(n), pa.int64()), one([2] * n, pa.int64()), one([[i % 9, 10] for i in range(n)], pa.list_(pa.int16())), one([[i, 65534] for i in range(n)], pa.list_(pa.int32())),
                                        one([[i % 9] if i % 2 else None for i in range(n)], pa.list_(pa.int16())), one([b"\x00\x04" + bytes(4094) if i == 4 else None for i in range(n)], pa.binary())], names=["rep", "cell_id", "block", "places", "codes", "seen", "bits"])
    out = list(Z._free(iter([batch.slice(0, 300), batch.slice(300)])))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(0, i, p + 2 * Z.BITS, c / 65534) for i in range(n) for p, c in ((i % 9, i), (10, 65534)) if not (i % 2 and p < 9) and not (i == 4 and p == 10)]
    assert len(out) == 2 and got == want


def test_observations_are_added_up_once(spark, small, monkeypatch):
    """All steps of a training set read one table of the cells' observations."""
    calls = []
    of = B.query_obs
    monkeypatch.setattr(B, "query_obs", lambda *a: calls.append(1) or of(*a))
    registry.training_set(spark, small, registry.ONE_STEP)
    assert len(calls) == 1


def test_histograms_of_tasks_meet_node_by_node():
    """Rows of two tasks are added up as they pass, and a node leaves as one row, with the first feature's cut of equal ones."""
    g, h = [np.array(v, float).tobytes() for v in ([-3, 2, 0, 1], [3, 0, 0, -3], [0, 0, 0, 0])], np.array([2, 2, 0, 1.0]).tobytes()
    rows = [(0, 0, 1, g[2]), (0, 0, 2, g[0]), (0, 0, 2, g[0]), (0, 0, 3, g[0]), (0, 0, 3, g[0]), (1, 5, 0, g[2])]
    batch = pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], pa.array([r[3] for r in rows], pa.binary()), pa.array([h] * len(rows), pa.binary())], names=["k", "node", "f", "g", "h"])
    out = [r for b in G._best_of_nodes(1.0, 1.0)(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    assert [(r["k"], r["node"], r["hs"]) for r in out] == [(0, 0, 5.0), (1, 5, 5.0)] and out[1]["best"] is None


def test_a_level_is_one_stage_while_histograms_are_few(spark, monkeypatch):
    """More rounds are one job of one stage for each level; trees are the same where a shuffle adds up many histograms, and in one task or several."""
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, "abc"[int(x * 3)], float(int(x * 50)), float(y) if y > 0.1 else None) for i, (x, y) in enumerate(rng.uniform(size=(400, 2)))], "cell_id long, label string, P1 double, P2 double").repartition(3).cache()
    sc, trees, _ = spark.sparkContext, {}, rows.count()

    def grown(rounds):
        sc.setJobGroup(group := f"boosted-{len(trees)}-{rounds}", "")
        try:
            nodes = G.fit_boosted(rows, ["P1", "P2"], rounds=rounds, depth=3, bins=32)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
        return nodes, len(jobs), sum(len(j.stageIds) for j in jobs)

    one, three = grown(1), grown(3)
    assert (three[1] - one[1], three[2] - one[2]) == (6, 6)
    for name, here, own in (("here", 1 << 22, 1 << 15), ("tasks", 1 << 22, 100), ("shuffle", 0, 100)):
        monkeypatch.setattr(G, "MOST_HERE", here)
        monkeypatch.setattr(G, "ROWS", own)
        trees[name] = sorted(map(tuple, grown(3)[0].collect()), key=lambda r: (r[0], r[1], r[3]))
    for name in ("tasks", "shuffle"):
        assert [r[:5] + r[6:9] for r in trees[name]] == [r[:5] + r[6:9] for r in trees["here"]]
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for a, b in zip(trees[name], trees["here"]) for k in (5, 9) if a[k] is not None)


def test_rows_are_packed():
    """A batch of rows is one row of arrays by feature and by class."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1], pa.int32()), pa.array([0.5, None, 2.0])], names=["y", "c0"])
    (out,) = G._bin([(np.array([0.0, 1.0]), True)], 2, False)(iter([batch.slice(0, 0), batch]))
    ((y, cells, score),) = G._read(iter([out]), 1, 2, [])
    assert y.tolist() == [1, 0, 1] and cells.tolist() == [[0, 65_535, 1]] and score.tolist() == [[0.5] * 3] * 2
    tree = {0: {"feature": 0, "bin": 0, "left": False}, 1: {"feature": None, "value": -1.0}, 2: {"feature": None, "value": 2.0}}
    ((_, _, score),) = G._read(iter([out]), 1, 2, [[tree, {0: {"feature": None, "value": 0.0}}]])
    assert score.tolist() == [[-0.5, 2.5, 2.5], [0.5] * 3]
