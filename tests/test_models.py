"""Decoders, solvers and classifiers against hand-worked values and plain NumPy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.operators import boost as G
from cpgloom.operators import classify as C
from cpgloom.operators import deconvolve as D
from cpgloom.operators import evaluate as E
from cpgloom.operators import features as X
from cpgloom.operators import simulate as M
from cpgloom.operators import train as T
from cpgloom.operators import upscale as V
from exact_trees import Boosted


def sigma(x):
    return 1 / (1 + math.exp(-x))


def test_toy_block(spark):
    rows = spark.createDataFrame([(0, 2.0, -1.0, 5.0), (1, None, 0.0, 1.0)], "cell int, a double, b double, c double")
    x = [V.imputed(F.col(c), 0, 0, 1) for c in "abc"]
    p = V.block_forward(x, [[1, 0, 0], [0, 1, 0]], [0, 0], ([1, 1], [0, 0], [0, 0], [1, 1], 1e-5), [[1, 0], [0, 1], [1, 1], [-1, 0]], [0, 0, 0, 0])
    got = [list(r["p"]) for r in rows.select("cell", F.array(*p).alias("p")).orderBy("cell").collect()]
    assert got[0] == pytest.approx([0.880796, 0.5, 0.880796, 0.119204], abs=1e-5)
    assert got[1] == pytest.approx([0.5] * 4)


def test_units_in_position_order(spark):
    x = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 1.0])], "cell_id long, x array<double>")
    units = spark.createDataFrame(
        [(0, "factor", 1, [0.0], [1.0, 0.0, 0.0, 0.0], [1.0, -1.0], [0.0, 0.0], [2, 0]), (1, "direct", 0, [], [0.0, 0.0, 0.0, 1.0], [], [0.0], [1])],
        "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>",
    )
    got = V.upscale(x, units).orderBy("cpg_idx").collect()
    assert [r["p"] for r in got] == pytest.approx([sigma(-1), sigma(1), sigma(1)], abs=1e-12)
    assert [r["call"] for r in got] == [False, True, True]


def test_selected_outputs_are_those_of_all(spark):
    x = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=2).tolist()) for i in range(4)], "cell_id long, x array<double>")
    rng = np.random.default_rng(9)
    units = spark.createDataFrame(
        [(0, "factor", 3, rng.normal(size=3).tolist(), rng.normal(size=6).tolist(), rng.normal(size=12).tolist(), rng.normal(size=4).tolist(), [5, 0, 3, 1]), (1, "direct", 0, [], rng.normal(size=6).tolist(), [], rng.normal(size=3).tolist(), [2, 6, 4]), (2, "direct", 0, [], [0.5, 0.5], [], [0.1], [7])],
        "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>",
    )
    every = {(r["cell_id"], r["cpg_idx"]): r["p"] for r in V.upscale(x, units).collect()}
    for wanted in ([0, 3, 6, 3, 99], [4], []):
        kept = V.select_outputs(units, spark.createDataFrame([(c,) for c in wanted], "cpg_idx long"))
        assert kept.columns == units.columns
        got = {(r["cell_id"], r["cpg_idx"]): r["p"] for r in V.upscale(x, kept).collect()}
        assert got == pytest.approx({k: v for k, v in every.items() if k[1] in wanted})


def test_agreement_and_keys(spark):
    a = spark.createDataFrame([(1, 0.2), (2, None), (3, 0.9), (4, None), (5, 0.5)], "k int, beta double")
    b = spark.createDataFrame([(1, 0.3), (2, None), (3, 0.1), (4, 0.4), (6, 1.0)], "k int, beta double")
    (r,) = E.agreement(a, b, ["k"]).collect()
    assert (r["n"], r["na_agreement"], r["label_agreement"]) == (4, 0.75, 0.5) and r["max_diff"] == pytest.approx(0.8)
    assert tuple(E.key_match(a, b, ["k"]).first()) == (4, 1, 1)
    none = a.where("k < 0")
    assert tuple(E.key_match(none, none, ["k"]).first()) == (0, 0, 0)
    assert tuple(E.agreement(none, none, ["k"]).first()) == (0, None, None, None)


def test_scan_goes_round_and_batch_takes_what_there_is(spark):
    rows = spark.createDataFrame([(0, c, i, 0.5) for c in range(6) for i in range(10) if i != 4], "rep int, cell_id long, cpg_idx long, y double")
    places = spark.createDataFrame([(100 + i, 7, i) for i in range(10)], "dest long, unit int, cpg_idx long")
    units = spark.createDataFrame([(7, 100, 10)], "unit int, output_offset long, cpg_count long")
    got = M.target_scan(rows, places, units, 3).collect()
    for c in range(6):
        own = {r["cpg_idx"] for r in got if r["cell_id"] == c}
        rounds = [[(s + k) % 10 for k in range(10) if (s + k) % 10 != 4][:3] for s in range(10)]
        assert own in map(set, rounds)
    groups = spark.createDataFrame([(i, i % 3) for i in range(30)], "cpg_idx long, group long")
    batch = M.stratified_batch(groups, [1], 18, 0.8).collect()
    assert sorted((r["pool"], r["group"]) for r in batch) == [("easy", 1)] * 10 + [("variable", 2)] * 4


def test_pending_units(spark):
    units = spark.createDataFrame([(0,), (1,), (2,)], "unit int")
    done = spark.createDataFrame([(0, "a"), (1, "b"), (0, "a")], "unit int, run string")
    assert sorted(r["unit"] for r in V.pending(units, done, "a").collect()) == [1, 2]


def test_duplicate_position_is_rejected(spark):
    units = lambda *cpgs: spark.createDataFrame([(i, list(c)) for i, c in enumerate(cpgs)], "unit int, cpgs array<long>")
    V.check_units(units([2, 0], [1]), 3)
    for bad in (([2, 0], [0]), ([2, 0], [3]), ([2, 0],), ([2, 0], [1, 1])):
        with pytest.raises(ValueError):
            V.check_units(units(*bad), 3)


@pytest.mark.parametrize("rank,linear", [(3, True), (3, False), (0, True)])
def test_slopes_of_a_head(rank, linear):
    """Against differences of the loss, computed by the forward pass alone."""
    rng = np.random.default_rng(2)
    head = T.Head(4, rank, rng.normal(size=6), linear, rng)
    if rank:
        head.net["E"] = rng.normal(size=(6, 3))
    x, at, y = rng.normal(size=4), np.array([5, 0, 2]), rng.uniform(size=3)

    def loss():
        unit = {"mode": "factor", "A": head.net["A"], "a": head.net["a"], "E": head.net["E"], "b": head.net["b"]} if rank else {"mode": "direct", "A": head.net["A"], "b": head.net["b"]}
        return float(((V.unit_forward(x[None], unit, linear)[0, at] - y) ** 2).mean())

    for k, g in head.slopes(x, at, y, 0.0).items():
        for i in np.ndindex(g.shape):
            old = head.net[k][i]
            head.net[k][i] = old + 1e-6
            up = loss()
            head.net[k][i] = old - 1e-6
            down = loss()
            head.net[k][i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def unit_rows(rng, o=5, n=400):
    w = rng.normal(size=(o, 3))
    xs = rng.normal(size=(n, 3))
    return [("val" if i < 20 else "train", x, np.arange(o), 1 / (1 + np.exp(-w @ x))) for i, x in enumerate(xs)]


def test_training_stops_and_learns():
    rows = unit_rows(np.random.default_rng(3))
    for kind, direct in (("pure", False), ("mixed", False), ("mixed", True)):
        got = T.fit_unit(rows, kind, np.zeros(5), 1, T.Options(pure_rank=2, mixed_rank=3, direct=direct, min_steps=100, evaluate=20, patience=2, lr=0.05))
        assert (got["mode"], got["rank"]) == (("direct", 0) if direct else ("factor", 2 if kind == "pure" else 3)) and got["best_mae"] < 0.7 * got["first_mae"] and got["best_step"] >= 100
    still = T.fit_unit(rows, "pure", np.zeros(5), 1, T.Options(min_steps=100, evaluate=20, patience=2, lr=0.0))
    assert still["best_step"] == 0 and still["best_mae"] == still["first_mae"]


def test_batches_and_restart(spark, tmp_path):
    """Targets are unobserved, from the drawn start on; a second run trains the units that the first has not."""
    options = T.Options(pure_rank=1, mixed_rank=1, batch=3, min_steps=2, max_steps=6, evaluate=2, patience=1, checks=2)
    units = spark.createDataFrame([(0, 0, "pure"), (1, 5, "mixed")], "unit int, output_offset long, class string")
    places = spark.createDataFrame([(i, int(i >= 5), 100 + i) for i in range(10)], "dest long, unit int, cpg_idx long")
    codes = spark.createDataFrame([(c, 100 + i, 1000 * i) for c in range(4) for i in range(10) if (c, i) != (0, 2)], "cell_id long, cpg_idx long, code int")
    sampled = spark.createDataFrame([(r, c, 101) for r in range(2) for c in range(4)], "rep int, cell_id long, cpg_idx long")
    split = spark.createDataFrame([(0, "train"), (1, "train"), (2, "val"), (3, "test")], "cell_id long, split string")
    truth = T.held(codes, places, units)
    drawn = T.schedule(truth.select("unit", "cell_id").join(split, "cell_id"), 2, options)
    rows = T.batches(drawn, truth, T.seen(sampled, places, units), options)
    got = rows.collect()
    assert sorted({(r["unit"], r["split"], r["step"]) for r in got}) == sorted((u, s, t) for u in (0, 1) for s, n in (("train", 6), ("val", 2)) for t in range(1, n + 1))
    for r in got:
        free = [i for i in range(5) if not (r["unit"] == 0 and (i == 1 or (i == 2 and r["cell_id"] == 0)))]
        assert r["local"] in [[free[(s + k) % len(free)] for k in range(3)] for s in range(len(free))]
        assert r["y"] == [pytest.approx(1000 * (i + 5 * r["unit"]) / 65534) for i in r["local"]] and (r["split"] == "val") == (r["cell_id"] == 2)
    x = spark.createDataFrame([(r, c, [float(r), float(c)]) for r in range(2) for c in range(4)], "rep int, cell_id long, x array<double>")
    info = T.layout(places, units, spark.createDataFrame([(100 + i, 0.0) for i in range(10)], "cpg_idx long, logit double"))
    path, asked = str(tmp_path / "units"), []

    def train(own):
        asked.append(sorted({r["unit"] for r in own.select("unit").collect()}))
        return T.train_units(own, x, info, options)

    first = T.resume(spark, path, rows.where("unit = 0"), train, options).collect()
    both = T.resume(spark, path, rows, train, options).collect()
    assert asked == [[0], [1]] and sorted(r["unit"] for r in both) == [0, 1] and first[0] in both
    whole = {r["unit"]: r for r in T.train_units(rows, x, info, options).collect()}
    assert all(whole[r["unit"]] == r for r in both)
    other = T.Options(**{**vars(options), "lr": 0.5})
    T.resume(spark, path, rows, lambda own: T.train_units(own, x, info, other), other)
    assert {r["run"] for r in spark.read.parquet(path).collect()} == {options.run(), other.run()}
    out = V.upscale(x.where("rep = 0").select("cell_id", "x"), spark.createDataFrame(both, T.UNITS))
    assert out.count() == 40 and out.select("cpg_idx").distinct().count() == 10


def test_boosted_model_can_be_kept(spark, tmp_path):
    from cpgloom.sources import artifacts

    rng = np.random.default_rng(4)
    rows = [(i, "abc"[i % 3], float(i % 3 + 0.3 * rng.normal()) if i % 7 else None, float(rng.normal())) for i in range(120)]
    train = spark.createDataFrame(rows, "cell_id long, label string, P1 double, P2 double")
    model = G.fit_boosted(train, ["P1", "P2"], rounds=4, depth=3)
    artifacts.save(str(tmp_path / "m"), "boosted", {"nodes": model})
    kept = artifacts.load(spark, str(tmp_path / "m"), "boosted")["nodes"]
    a, b = ({r["cell_id"]: r for r in G.predict_boosted(m, train, ["P1", "P2"], probs=True).collect()} for m in (model, kept))
    assert a == b and sum(a[r[0]]["label"] == r[1] for r in rows) > 100
    direct = Boosted(4, depth=3).fit(np.array([[np.nan if v is None else np.float32(v) for v in r[2:]] for r in rows], dtype=float), np.array([i % 3 for i in range(120)]), 3)
    want = direct.predict(np.array([[np.nan if v is None else np.float32(v) for v in r[2:]] for r in rows], dtype=float))
    assert np.allclose([a[i]["probs"] for i in range(120)], want)
    assert {r["label"] for r in G.predict_boosted(kept.where("round < 0"), train, ["P1", "P2"]).collect()} == {None}


def test_logistic_slopes_vanish_at_the_optimum_only(spark):
    rng = np.random.default_rng(6)
    feat = spark.createDataFrame([(i, f"P{j + 1}", j, float(rng.uniform()) if (i, j) != (3, 1) else None, 3) for i in range(40) for j in range(2)], "cell_id long, pattern string, ord int, beta double, n_o long")
    labels = spark.createDataFrame([(i, "x", int(rng.uniform() < 0.5)) for i in range(40)], "cell_id long, label string, y int")
    model = C.fit_logistic(feat, labels)
    assert all(abs(r["slope"]) < 1e-3 for r in C.logistic_slopes(feat, labels, model).collect())
    assert all(abs(r["slope"]) > 0.1 for r in C.logistic_slopes(feat, labels, model.withColumn("weight", F.col("weight") + 1)).collect())


def test_trunk_and_count_input():
    x = (np.array([1.0, math.log1p(4)]) - [0.5, 1.0]) / [0.5, 1.0]
    h = V.trunk(x[None], np.eye(2), np.zeros(2), np.zeros((2, 2)), np.zeros(2))
    p = V.unit_forward(h, {"mode": "factor", "A": np.ones((1, 2)), "a": np.zeros(1), "E": np.ones((1, 1)), "b": np.zeros(1)})
    assert p[0, 0] == pytest.approx(5 / 6, abs=1e-5)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.integers(1, 4))
def test_nnls_is_optimal(seed, n):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 1, (12, n)), rng.uniform(0, 1, 12)
    x = D.nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w <= 1e-7).all() and np.abs(w[x > 1e-9]).max(initial=0) < 1e-7


def test_a_cell_alone_is_as_in_a_batch(spark):
    rng = np.random.default_rng(3)
    sig = spark.createDataFrame([(t, f"P{p}", float(rng.uniform())) for t in range(3) for p in range(1, 9)], "cell_type long, pattern string, beta double")
    rows = [(c, f"P{p}", p, None if (c, p) == (1, 2) else float(rng.uniform()), 5) for c in range(4) for p in range(1, 9)]
    feat = spark.createDataFrame(rows, "cell_id long, pattern string, ord int, beta double, n_o long")
    batch = {(r["cell_id"], r["cell_type"]): r["proportion"] for r in D.deconvolve(sig, feat).collect()}
    alone = {(r["cell_id"], r["cell_type"]): r["proportion"] for r in D.deconvolve(sig, feat.where("cell_id = 1")).collect()}
    assert all(batch[k] == v for k, v in alone.items())
    for c in range(4):
        total = sum(v for (cell, _), v in batch.items() if cell == c)
        assert total == pytest.approx(1) or total == 0
    none = feat.withColumn("beta", F.lit(None).cast("double"))
    assert {r["proportion"] for r in D.deconvolve(sig, none).collect()} == {0.0}


def test_nnls_of_nearly_equal_types():
    rng = np.random.default_rng(5)
    base = rng.uniform(0.2, 0.8, 60)
    a = np.stack([base + 1e-4 * rng.normal(size=60) for _ in range(4)], 1)
    x = np.array([0.1, 0.0, 0.6, 0.3])
    assert np.abs(D.nnls(a, a @ x) - x).max() < 1e-4


def test_pilot_golden(spark):
    rows = [(i, "mixed", float(v)) for i, v in enumerate([5, 1, 9, 3, 7, 2, 8, 0, 6, 4])] + [(10 + i, "pure", 0.5) for i in range(3)] + [(20 + i, "PNA", None) for i in range(4)]
    units = spark.createDataFrame(rows, "unit int, class string, variance double")
    # by variance the units are 7 1 5 | 3 9 0 | 8 4 | 6 2; two of each quarter are its ends; of four background units the places 0, 1.5 (even: 2) and 3
    assert sorted(r["unit"] for r in E.pilot(units, 2, 3).collect()) == sorted([7, 5, 3, 0, 8, 4, 6, 2, 20, 22, 23])
    with pytest.raises(ValueError):
        E.pilot(units, 3, 3)
    with pytest.raises(ValueError):
        E.pilot(units, 2, 5)


def test_paired_models_must_have_the_same_targets(spark):
    a = spark.createDataFrame([(1, 0.5, 0.4), (2, 0.1, 0.3)], "k int, y double, p double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.0)], "k int, p double")
    assert sorted(tuple(r) for r in E.paired(a, b, ["k"]).collect()) == [(1, 0.5, 0.4, 0.5), (2, 0.1, 0.3, 0.0)]
    with pytest.raises(Exception, match="keys differ"):
        E.paired(a, b.where("k = 1"), ["k"]).collect()


def test_feature_mean_is_of_cpgs_not_of_reads(spark):
    obs = spark.createDataFrame([(0, 0, 9, 1), (0, 1, 0, 1), (1, 0, 0, 0)], "cell_id long, cpg_idx long, m long, u long")
    masked = spark.createDataFrame([(0, "P1"), (1, "P1")], "cpg_idx long, state string")
    got = {r["cell_id"]: (r["beta"], r["n_o"]) for r in X.features(obs, masked, ["P1", "Pna"]).where("pattern = 'P1'").collect()}
    assert got == {0: (pytest.approx(0.45), 2), 1: (None, 0)}


def test_ties_go_to_the_last_class(spark):
    best, confidence = C.decide([F.lit(0.25), F.lit(0.375), F.lit(0.375)])
    r = spark.range(1).select(best.alias("b"), confidence.alias("c")).first()
    assert r["b"] == 2 and 0 <= r["c"] <= 1


def test_logistic_matches_gradient_descent(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(40, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=40) > 0.5).astype(int)
    feat = spark.createDataFrame([(i, f"P{j + 1}", j, float(x[i, j]), 3) for i in range(40) for j in range(2)], "cell_id long, pattern string, ord int, beta double, n_o long")
    labels = spark.createDataFrame([(i, "x", int(y[i])) for i in range(40)], "cell_id long, label string, y int")
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(2), 0.0
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= 0.5 * (z.T @ (p - y) + w) / 40
        b -= 0.5 * (p - y).mean()
    got = {r["pattern"]: r["weight"] for r in C.fit_logistic(feat, labels).collect()}
    assert [got["P1"], got["P2"]] == pytest.approx(list(w / x.std(0)), abs=1e-3)


def test_boosted_trees_learn_and_take_missing_values():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(300, 3))
    y = np.digitize(x[:, 0], [0.33, 0.66])
    x[rng.uniform(size=x.shape) < 0.05] = np.nan
    model = Boosted(rounds=10, depth=3).fit(x, y, 3)
    assert (model.predict(x).argmax(1) == y).mean() > 0.9
    assert np.allclose(model.predict(x).sum(1), 1)


def test_samples_are_nested_and_of_size(spark):
    obs = spark.createDataFrame([(c, i, 1, i % 2) for c in range(3) for i in range(50)], "cell_id long, cpg_idx long, m long, u long")
    ladder = spark.createDataFrame([(0, 10), (1, 100)], "rep int, sample long")
    got = M.sample(obs, ladder).groupBy("rep", "cell_id").count().collect()
    assert {(r["rep"], r["count"]) for r in got} == {(0, 10), (1, 50)}


def test_standardised_missing_is_zero(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1.0, "train"), (0, 1, 0, 3.0, "train"), (0, 2, 0, None, "train"), (0, 3, 0, 5.0, "test")], "rep int, cell_id long, j int, v double, split string")
    with pytest.raises(Exception, match="never observed"):
        M.standardise(rows.unionByName(rows.withColumn("j", F.lit(1)).withColumn("v", F.lit(None).cast("double"))), F.col("split") == "train").collect()
    got = {r["cell_id"]: r["x"] for r in M.standardise(rows, F.col("split") == "train").collect()}
    scale = math.sqrt(2 / 3)  # squared deviations of the observed over all training rows
    assert got == pytest.approx({0: -1 / scale, 1: 1 / scale, 2: 0.0, 3: 3 / scale})


def test_block_networks(spark):
    rng = np.random.default_rng(5)
    size, width, hidden = 4, 3, 2
    shapes = {"fill": (width,), "mean": (width,), "scale": (width,), "w1": (hidden, width), "b1": (hidden,), "gain": (hidden,), "shift": (hidden,), "centre": (hidden,), "spread": (hidden,), "w2": (size, hidden), "b2": (size,)}
    nets = {b: {c: rng.uniform(0.1, 1, s) for c, s in shapes.items()} for b in (0, 2)}
    models = spark.createDataFrame([(b, *[n[c].ravel().tolist() for c in shapes]) for b, n in nets.items()], "block long, " + ", ".join(f"{c} array<double>" for c in shapes))
    xs = {c: [float(v) for v in rng.uniform(0, 1, width)] for c in (1, 2, 700)}
    xs[2][1] = None
    inputs = spark.createDataFrame(list(xs.items()), "cell_id long, x array<double>")
    wanted = [(c, g) for c in (1, 2, 700, 9) for g in (0, 3, 5, 8, 11)] + [(1, 0)]
    got = {(r["cell_id"], r["cpg_idx"]): r["p"] for r in V.predict_blocks(inputs, models, spark.createDataFrame(wanted, "cell_id long, cpg_idx long"), size).collect()}
    want = {}
    for c, g in wanted:
        if c in xs and g // size in nets:
            n = nets[g // size]
            x = np.array([n["fill"][i] if v is None else v for i, v in enumerate(xs[c])])
            h = np.maximum(n["w1"] @ ((x - n["mean"]) / n["scale"]) + n["b1"], 0)
            h = n["gain"] * (h - n["centre"]) / np.sqrt(n["spread"] + 1e-5) + n["shift"]
            want[c, g] = 1 / (1 + np.exp(-(n["w2"][g % size] @ h + n["b2"][g % size])))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_binomial_reads(spark):
    rows = spark.range(4000).select(S.binomial_fraction(F.lit(0.3), 5, 1, F.col("id")).alias("s"), S.binomial_fraction(F.lit(1.0), 3, F.col("id")).alias("one"), S.binomial_fraction(F.lit(None).cast("double"), 3, F.col("id")).alias("none"))
    got = rows.agg(F.avg("s").alias("mean"), F.var_pop("s").alias("var"), F.min("one").alias("one"), F.max("none").alias("none")).first()
    assert abs(got["mean"] - 0.3) < 0.02 and abs(got["var"] - 0.3 * 0.7 / 5) < 0.004 and got["one"] == 1 and got["none"] is None
