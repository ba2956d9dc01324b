"""The trunk's gradients against differences, and training on a signal that only the trunk can carry."""

import numpy as np
import pytest

from cpgloom.operators import trunk as K
from cpgloom.sources import artifacts


def test_slopes_equal_differences():
    rng = np.random.default_rng(3)
    o = K.Options(patterns=3, hidden=4, rank=2)
    flat = K.initial(5, o) + rng.normal(0, 0.1, len(K.initial(5, o)))
    own = {"E": rng.normal(0, 1, (6, 2)), "b": rng.normal(0, 1, 6)}
    groups, x, at, y = np.array([0, 1, 2, 0, 1, 2]), rng.normal(0, 1, 5), np.array([0, 2, 3, 5]), rng.uniform(0, 1, 4)

    def loss():
        return float(((K.slopes(K.unpack(flat, 5, o), own, groups, x, at, y, 2)[0] - y) ** 2).mean())

    _, shared, mine = K.slopes(K.unpack(flat, 5, o), own, groups, x, at, y, 2)
    got = np.concatenate([shared[k].ravel() for k in K.shapes(5, o)])
    for values, grads in ((flat, got), (own["E"].reshape(-1), mine["E"].ravel()), (own["b"], mine["b"])):
        for i in range(len(values)):
            old = values[i]
            values[i] = old + 1e-6
            up = loss()
            values[i] = old - 1e-6
            down = loss()
            values[i] = old
            assert grads[i] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def test_training_learns_and_is_kept(spark, tmp_path):
    rng = np.random.default_rng(4)
    o = K.Options(patterns=2, hidden=8, rank=2, rounds=6, steps=25, batch=8, checks=4, lr=0.03, block=10, seed=2)
    cells = {c: rng.normal(0, 1, 3) for c in range(24)}
    # a CpG follows the sign of the first input, or its contrary
    codes = [(c, g, int(65534 * ((x[0] > 0) == (g % 2 == 0)))) for c, x in cells.items() for g in range(20)]
    codes = spark.createDataFrame(codes, "cell_id long, cpg_idx long, code int")
    split = spark.createDataFrame([(c, "train" if c < 18 else "val") for c in cells], "cell_id long, split string")
    inputs = spark.createDataFrame([(0, c, x.tolist()) for c, x in cells.items()], "rep int, cell_id long, x array<double>")
    members = spark.createDataFrame([(g, None if g == 7 else g % 3) for g in range(20)], "cpg_idx long, rank int")
    sampled = spark.createDataFrame([(0, c, 0) for c in cells], "rep int, cell_id long, cpg_idx long")
    placed = K.places(members, o)
    active = {g for g in range(20) if g != 7 and g % 3 < 2}
    bias = spark.range(20).selectExpr("id AS cpg_idx", "0.0D AS logit")
    model = K.train(K.batches(placed, codes, sampled, split, 1, o), inputs, K.start(placed, bias, o), 3, o)
    mae = [r["mae"] for r in model["scores"].orderBy("round").collect()]
    assert mae[-1] < 0.3 < 0.4 < mae[0] + 0.2 and mae[-1] < mae[0]
    artifacts.save(str(tmp_path / "trunk"), "trunk", model)
    back = artifacts.load(spark, str(tmp_path / "trunk"), "trunk")
    assert {c for r in back["sites"].collect() for c in r["cpgs"]} == active
    w = K.weights(back["trunk"], 3)
    assert [x.shape for x in w] == [(8, 3), (8,), (8, 8), (8,)]
    with pytest.raises(ValueError):
        K.weights(back["trunk"], 4)
    x = {r["cell_id"]: r["x"] for r in K.raised(inputs, w).collect()}
    assert len(x) == 24 and all(len(v) == 8 for v in x.values())
    # the CpG that every replicate sees is no target
    mixed = K.batches(placed, codes, sampled, split, 1, K.Options(patterns=2, rounds=1, steps=4, batch=4, checks=1, easy=(1,), fraction=0.5, block=10)).collect()
    of = {(r["unit"], g + 10 * r["unit"]) for r in mixed for g in r["local"]}
    assert {g for _, g in of} <= active - {0} and all(sum((g + 10 * r["unit"]) % 3 == 0 for g in r["local"]) == 2 and len(r["y"]) == 4 for r in mixed)


def signal(spark):
    """Cells whose CpGs follow the sign of the first input, or its contrary: (cells, codes, split, inputs, sampled, bias)."""
    rng = np.random.default_rng(4)
    cells = {c: rng.normal(0, 1, 3) for c in range(24)}
    codes = spark.createDataFrame([(c, g, int(65534 * ((x[0] > 0) == (g % 2 == 0)))) for c, x in cells.items() for g in range(40)], "cell_id long, cpg_idx long, code int")
    split = spark.createDataFrame([(c, "train" if c < 18 else "val") for c in cells], "cell_id long, split string")
    inputs = spark.createDataFrame([(0, c, x.tolist()) for c, x in cells.items()], "rep int, cell_id long, x array<double>")
    sampled = spark.createDataFrame([(0, c, 0) for c in cells], "rep int, cell_id long, cpg_idx long")
    members = spark.createDataFrame([(g, g % 2) for g in range(40)], "cpg_idx long, rank int")
    return codes, split, inputs, sampled, members, spark.range(40).selectExpr("id AS cpg_idx", "0.1D * id - 1 AS logit")


def run(spark, o, path=None, data="", data_of=None):
    codes, split, inputs, sampled, members, bias = data_of or signal(spark)
    placed = K.places(members, o)
    return K.train(K.batches(placed, codes, sampled, split, 1, o), inputs, K.start(placed, bias, o), 3, o, path, data)


def net_of(model):
    r = model["trunk"].first()
    return {k: np.array(r[k]) for k in ("w1", "b1", "w2", "b2", "heads", "head_bias")}, sorted((x["unit"], x["cpgs"], x["E"], x["b"]) for x in model["sites"].collect())


def same(a, b):
    return all(np.array_equal(a[0][k], b[0][k]) for k in a[0]) and a[1] == b[1]


def test_one_block_takes_plain_steps(spark):
    """With one block, rounds are nothing but the trainer's steps one after another; written out here by layer and example."""
    o = K.Options(patterns=2, hidden=4, rank=2, rounds=3, steps=4, batch=6, checks=2, lr=0.02, block=100, seed=7)
    data = signal(spark)
    codes, split, inputs, sampled, members, bias = data
    placed = K.places(members, o)
    rows = sorted((r for r in K.batches(placed, codes, sampled, split, 1, o).collect() if r["split"] == "train"), key=lambda r: r["step"])
    assert [r["step"] for r in rows] == list(range(1, 13))
    x_of = {r["cell_id"]: np.array(r["x"]) for r in inputs.collect()}
    first = K.start(placed, bias, o).first()
    cpgs, groups = list(first["cpgs"]), np.array(first["groups"])
    own = np.frombuffer(first["net"]).reshape(3, len(cpgs), 3)[0].copy()
    w = {k: v.copy() for k, v in K.unpack(K.initial(3, o), 3, o).items()} | {"E": own[:, :2].copy(), "b": own[:, 2].copy()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    slope = lambda z: 1.0 if z > 0 else 0.01
    for t, r in enumerate(rows, 1):
        x, g = x_of[r["cell_id"]], {k: np.zeros_like(x) for k, x in w.items()}
        u = w["w1"] @ x + w["b1"]
        h = np.array([z * slope(z) for z in u])
        s = w["w2"] @ h + w["b2"]
        top = h + np.array([z * slope(z) for z in s])
        z = w["heads"] @ top + w["head_bias"]
        dtop, hit = np.zeros(4), set()
        for c, y in zip(r["local"], r["y"]):
            i = cpgs.index(c)
            k = int(groups[i]) * 2
            p = 1 / (1 + np.exp(-(w["E"][i] @ z[k : k + 2] + w["b"][i])))
            d = 2 * (p - y) * p * (1 - p) / len(r["y"])
            g["E"][i] += d * z[k : k + 2]
            g["b"][i] += d
            hit.add(i)
            for q in range(2):
                g["heads"][k + q] += d * w["E"][i][q] * top
                g["head_bias"][k + q] += d * w["E"][i][q]
                dtop += d * w["E"][i][q] * w["heads"][k + q]
        ds = np.array([a * slope(b) for a, b in zip(dtop, s)])
        du = (w["w2"].T @ ds + dtop) * np.array([slope(b) for b in u])
        g |= {"w1": np.outer(du, x), "b1": du, "w2": np.outer(ds, h), "b2": ds}
        for k in w:
            at = sorted(hit) if k in ("E", "b") else slice(None)
            grad = g[k][at] + (o.decay * w[k][at] if k in ("w1", "w2", "heads", "E") else 0)
            m[k][at] = 0.9 * m[k][at] + 0.1 * grad
            v[k][at] = 0.999 * v[k][at] + 0.001 * grad**2
            w[k][at] = w[k][at] - o.lr * (m[k][at] / (1 - 0.9**t)) / (np.sqrt(v[k][at] / (1 - 0.999**t)) + 1e-8)
    net, sites = net_of(run(spark, o, data_of=data))
    for k in net:
        np.testing.assert_allclose(net[k], w[k].ravel(), atol=1e-9)
    np.testing.assert_allclose(np.array(sites[0][2]).reshape(-1, 2), w["E"], atol=1e-9)
    np.testing.assert_allclose(sites[0][3], w["b"], atol=1e-9)


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    """A run that dies within a round ends like an unbroken one; other options or data are refused; old rounds are gone."""
    o = K.Options(patterns=2, hidden=4, rank=2, rounds=4, steps=3, batch=6, checks=2, lr=0.02, block=10, seed=7, tasks=2)
    data = signal(spark)
    whole = net_of(run(spark, o, data_of=data))
    path, plain = str(tmp_path / "run"), K.averaged
    calls = []

    def dies(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return plain(*args)

    monkeypatch.setattr(K, "averaged", dies)
    with pytest.raises(RuntimeError):
        run(spark, o, path, "d", data)
    assert artifacts.finished(spark, f"{path}/round-2/weights") and not artifacts.finished(spark, f"{path}/round-3/weights")
    monkeypatch.setattr(K, "averaged", plain)
    steps = []
    monkeypatch.setattr(K, "_advance", lambda *a, f=K._advance: (steps.append(a[2]), f(*a))[1])
    model = run(spark, o, path, "d", data)
    assert steps == [3, 4] and same(net_of(model), whole)
    assert [r["round"] for r in model["scores"].orderBy("round").collect()] == [1, 2, 3, 4]
    assert sorted(p.name for p in tmp_path.joinpath("run").iterdir() if p.name.startswith("round-")) == ["round-4"]
    assert same(net_of(run(spark, o, path, "d", data)), whole) and steps == [3, 4]
    for other, key in ((K.replace(o, lr=0.01), "d"), (o, "e")):
        with pytest.raises(ValueError):
            run(spark, other, path, key, data)


def test_what_moves_follows_tasks_and_not_blocks(spark, tmp_path, monkeypatch):
    """Forty blocks in three tasks: three sums of the model a round, and the mean over all blocks."""
    o = K.Options(patterns=2, hidden=4, rank=2, rounds=1, steps=2, batch=4, checks=1, block=1, seed=3, tasks=3)
    data, gone = signal(spark), []
    monkeypatch.setattr(K, "PIECE", 7)
    monkeypatch.setattr(artifacts, "remove", lambda spark, path: gone.append(path))
    path = str(tmp_path / "run")
    net, sites = net_of(run(spark, o, path, data_of=data))
    sums = spark.read.schema(K.FROM_TASK).parquet(f"{path}/round-1/blocks").where("kind = 0")
    size = 3 * len(K.initial(3, o))
    blocks = spark.read.schema(K.STATE).parquet(f"{path}/round-1/blocks/kind=1")
    learned = {r["unit"] for r in spark.read.parquet(f"{path}/rows").where("split = 'train'").select("unit").distinct().collect()}
    assert blocks.count() == 40 == len(sites) and len(learned) == 39  # CpG 0 is never a target
    assert sums.count() <= 3 * -(-size // 7) and sum(r["n"] for r in sums.where("at = 0").collect()) == len(learned)
    assert any(p.endswith("round-0") for p in gone) and any(p.endswith("kind=0") for p in gone)
    # the mean of the blocks, each trained alone from the same weights
    alone = [net_of(run(spark, K.replace(o, tasks=1), data_of=(*data[:4], data[4].where(f"cpg_idx = {c}"), data[5])))[0] for c in (1, 2)]
    both = net_of(run(spark, K.replace(o, tasks=2), data_of=(*data[:4], data[4].where("cpg_idx IN (1, 2)"), data[5])))[0]
    for k in both:
        np.testing.assert_allclose(both[k], (alone[0][k] + alone[1][k]) / 2, atol=1e-12)


def test_without_rows_the_weights_stay(spark):
    o = K.Options(patterns=2, hidden=4, rank=2, rounds=2, steps=2, batch=4, checks=1, block=10)
    codes, split, inputs, sampled, members, bias = signal(spark)
    model = run(spark, o, data_of=(codes, split.where("split = 'val'"), inputs, sampled, members, bias))
    np.testing.assert_array_equal(np.concatenate(list(net_of(model)[0].values())), K.initial(3, o))
    empty = run(spark, o, data_of=(codes.limit(0), split, inputs, sampled, members.limit(0), bias))
    assert empty["sites"].count() == 0 and [r["mae"] for r in empty["scores"].collect()] == [None, None]


def test_options_that_do_not_fit(spark):
    placed = K.places(signal(spark)[4], K.Options(patterns=2, block=10))
    fit = K.Options(patterns=2, hidden=4, rank=2, batch=8, block=10, easy=(2,))
    K.check(placed, fit)
    for bad in ({"batch": 41}, {"easy": (3,)}, {"easy": (0,)}, {"easy": (1, 1)}, {"easy": (1, 2)}, {"fraction": 1.5}, {"rank": 0}):
        with pytest.raises(ValueError):
            K.check(placed, K.replace(fit, **bad))
    with pytest.raises(ValueError):
        K.check(placed.limit(0), fit)
