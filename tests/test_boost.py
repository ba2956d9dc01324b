"""Distributed boosted trees against trees with every cut tried in one place; linear models as text."""

import numpy as np
import pytest
from exact_trees import Boosted

from cpgloom.operators import boost as G
from cpgloom.operators import classify as C
from cpgloom.sources import readers as R


def table(spark, x, y):
    rows = [(i, y[i], *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "cell_id long, label string, " + ", ".join(f"P{k + 1} double" for k in range(x.shape[1]))).repartition(3)


def probabilities(model, rows, columns):
    return np.array([r["probs"] for r in G.predict_boosted(model, rows, columns, probs=True).orderBy("cell_id").collect()])


def test_trees_equal_the_exact_ones_on_few_values(spark, monkeypatch):
    """Values are few, so every cut is a bin's: splits, sides of missing values and leaves are those of the exact search, over rounds that are written in between, too."""
    monkeypatch.setattr(G, "KEEP", 2)
    monkeypatch.setattr(G, "MOST", 100)  # one class a job
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (200, 3)).astype(float) / 8
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 0.4, 200) > 1.3).astype(int) + (x[:, 2] > 0.9)
    x[rng.uniform(size=x.shape) < 0.1] = np.nan
    columns, labels = ["P1", "P2", "P3"], ["abc"[k] for k in y]
    rows = table(spark, x, labels)
    model = G.fit_boosted(rows, columns, rounds=5, depth=3, bins=16)
    want = Boosted(5, depth=3).fit(x, y, 3)
    np.testing.assert_allclose(probabilities(model, rows, columns), want.predict(x), atol=1e-9)
    root = {r["class_idx"]: (r["feature"], r["cut"], r["missing_left"]) for r in model.where("round = 0 AND node = 0").collect()}
    assert root == {k: (t[0], pytest.approx(t[1]), t[2]) for k, t in enumerate(want.trees[0])}


def test_all_rows_train_and_quantiles_serve_for_many_values(spark):
    """More values than bins: as good as the exact trees; only the last rows have the third class."""
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(3000, 2))
    y = np.digitize(x[:, 0], [0.3, 0.7])
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    rows = table(spark, x, ["abc"[k] for k in y])
    low, exact = G.bounds(rows, ["P1"], 32)[0]
    assert not exact and 28 <= len(low) <= 32 and (np.diff(low) > 0).all()
    model = G.fit_boosted(rows, ["P1", "P2"], rounds=3, depth=2, bins=32)
    assert (probabilities(model, rows, ["P1", "P2"]).argmax(1) == y).mean() > 0.95
    assert {r["label"] for r in model.select("label").distinct().collect()} == {"a", "b", "c"}


def test_edges_of_training(spark):
    none = table(spark, np.zeros((0, 1)), [])
    assert G.fit_boosted(none, ["P1"]).count() == 0
    with pytest.raises(ValueError):
        G.fit_boosted(table(spark, np.zeros((3, 1)), ["a"] * 3), ["P1"])
    rows = table(spark, np.full((8, 1), np.nan), ["a", "b"] * 4)
    nodes = G.fit_boosted(rows, ["P1"], rounds=1).collect()
    assert [(r["node"], r["feature"], r["value"]) for r in nodes] == [(0, None, pytest.approx(0.0))] * 2


def test_linear_text_round_trip(spark, tmp_path):
    model = spark.createDataFrame([(f"P{k}", k / 7, k / 11, -0.123456789123, 1.5) for k in range(1, 4)], "pattern string, weight double, mean double, bias double, scale double")
    R.write_linear(str(tmp_path / "m"), model, "logistic", ["with space", "b"])
    back, method, names = R.read_linear(spark, str(tmp_path / "m"))
    assert (method, names) == ("logistic", ["with space", "b"])
    assert sorted(map(tuple, back.collect())) == [(f"P{k}", float(f"{k / 7:.9g}"), float(f"{k / 11:.9g}"), -0.123456789, 1.5) for k in range(1, 4)]
    feat = spark.createDataFrame([(1, "P1", 1.0), (1, "P2", None), (2, "P1", 0.0), (2, "P3", 0.1)], "cell_id long, pattern string, beta double")
    got = {r["cell_id"]: r for r in C.score_linear(feat, back, names, probs=True).collect()}
    assert got[1]["label"] == "b" and got[2]["label"] == "with space" and got[1]["probs"] == [pytest.approx(1 - got[1]["p1"]), got[1]["p1"]]
    for k, (text, scale) in enumerate((("x-linear\t1\nmethod\tthreshold\nlabels\tu\tv\nother\t1\nbias\t2\nscale\t0\nfeature\tP1\t1\t0.5\n", 1.0), ("x-linear\nmethod\tlogistic\nlabels\tu\tv\n", 1.0))):
        (tmp_path / f"t{k}").write_text(text)
        rows, _, names = R.read_linear(spark, str(tmp_path / f"t{k}"))
        assert names == ["u", "v"] and all(r["scale"] == scale for r in rows.collect())
    for k, text in enumerate(("method\tx\nlabels\tu\tv\n", "x-linear\t1\nlabels\tu\tv\n", "x-linear\t1\nmethod\tx\nlabels\tu\n", "x-linear\t1\nmethod\tx\nlabels\tu\tv\nfeature\tP1\t1\n")):
        (tmp_path / f"bad{k}").write_text(text)
        with pytest.raises(ValueError):
            R.read_linear(spark, str(tmp_path / f"bad{k}"))
    with pytest.raises(ValueError):
        R.write_linear(str(tmp_path / "n"), model, "logistic", ["a\tb", "c"])


def test_two_classes(spark):
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "cell_id long, label string")
    rows, names = C.two_classes(labels)
    assert names == ["a", "b"] and sorted((r["cell_id"], r["y"]) for r in rows.collect()) == [(1, 1), (2, 0), (4, 1)]
    for bad in (labels.where("label = 'a'"), labels.unionByName(labels.selectExpr("cell_id", "'c' AS label"))):
        with pytest.raises(ValueError):
            C.two_classes(bad)
    C.check_classes(labels)
    with pytest.raises(ValueError):
        C.check_classes(labels.where("label = 'a'"))


def test_linear_models_need_both_classes(spark):
    feat = spark.createDataFrame([(c, "P1", 0, 0.1 * c) for c in range(4)], "cell_id long, pattern string, ord int, beta double")
    labels = spark.createDataFrame([(c, "a", c % 2) for c in range(4)], "cell_id long, label string, y int")
    assert C.fit_threshold(feat, labels).count() == 1
    for bad in ("y = 0", "y = 1", "y IS NULL"):
        with pytest.raises(ValueError):
            C.fit_threshold(feat, labels.where(bad))
        with pytest.raises(ValueError):
            C.fit_logistic(feat, labels.where(bad))
    with pytest.raises(ValueError):
        C.fit_threshold(feat, labels.selectExpr("cell_id", "label", "IF(cell_id = 3, 2, y) AS y"))
