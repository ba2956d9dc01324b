"""Generator and splits, several masks, comparison of models, solver status, checks of an index, descriptions by kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.functions import pcg
from cpgloom.operators import deconvolve as D
from cpgloom.operators import evaluate as E
from cpgloom.operators import features as X
from cpgloom.operators import simulate as M
from cpgloom.operators import units as U
from cpgloom.operators import upscale as V
from cpgloom.sources import artifacts as A


def test_generator_golden():
    # fixed values: the generator's published first numbers of seed 42 on stream 54
    want = [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293, 0xBFA4784B, 0xCBED606E]
    inc = 2 * 54 + 1
    assert pcg.numbers(pcg.seeded(42, inc), 6, inc).tolist() == want
    for k in range(6):
        assert pcg.numbers(pcg.advanced(pcg.seeded(42, inc), k, inc), 1, inc)[0] == want[k]


def step_by_step(seed):
    """One number after another."""
    state = 0
    for add in (0, seed):
        state = ((state + add) * pcg.MULTIPLIER + pcg.INCREMENT) % 2**64
    while True:
        x, turn = ((state >> 18 ^ state) >> 27) & 0xFFFFFFFF, state >> 59
        yield (x >> turn | x << (-turn & 31)) & 0xFFFFFFFF
        state = (state * pcg.MULTIPLIER + pcg.INCREMENT) % 2**64


@pytest.mark.parametrize("seed", [0, 1, 7, 2**63 + 5])
def test_split_of_a_seed(spark, seed):
    draws = step_by_step(seed)
    order = list(range(53))
    for q in range(53, 1, -1):
        j = next(draws) % q
        order[q - 1], order[j] = order[j], order[q - 1]
    assert pcg.shuffled(53, seed).tolist() == order
    cells = spark.range(53).selectExpr("id * 3 AS cell_id").repartition(4)
    got = {r["cell_id"]: r["split"] for r in pcg.split(cells.unionByName(cells), seed).collect()}
    assert [got[3 * i] for i in order] == ["train"] * 37 + ["val"] * 7 + ["test"] * 9


def test_too_few_cells(spark):
    few = spark.range(6).selectExpr("id AS cell_id")
    for split in (pcg.split, M.split):
        with pytest.raises(Exception, match="too few cells"):
            split(few).collect()
        assert split(spark.range(7).selectExpr("id AS cell_id")).count() == 7


def test_features_of_masks_equal_those_of_each(spark):
    obs = spark.range(600).selectExpr("id % 6 AS cell_id", "id * 7 % 100 AS cpg_idx", "id % 3 AS m", "id % 2 AS u").dropDuplicates(["cell_id", "cpg_idx"])
    one = spark.range(100).selectExpr("id AS cpg_idx", "IF(id % 3 = 0, 'P2', 'P10') AS state")
    two = spark.range(40).selectExpr("id AS cpg_idx", "IF(id % 2 = 0, 'P1', 'Pna') AS state")
    got = X.mask_features(obs, {"b": one, "a": two}, {"b": ["P2", "P10"], "a": ["P1", "Pna"]}).collect()
    assert [p for _, p in sorted({(r["ord"], r["pattern"]) for r in got})] == ["a-P1", "b-P2", "b-P10", "a-Pna"]
    for name, mask, states in (("b", one, ["P2", "P10"]), ("a", two, ["P1", "Pna"])):
        want = {(r["cell_id"], f"{name}-{r['pattern']}"): (r["beta"], r["n_o"]) for r in X.features(obs, mask, states).collect()}
        own = {(r["cell_id"], r["pattern"]): (r["beta"], r["n_o"]) for r in got if r["mask_id"] == name}
        assert own.keys() == want.keys() and all(own[k][1] == want[k][1] and own[k][0] == pytest.approx(want[k][0]) for k in want)


def test_any_number_of_models(spark):
    rng = np.random.default_rng(8)
    y = rng.uniform(size=(5, 4))
    p = rng.uniform(size=(4, 5, 4))
    table = lambda v, c: spark.createDataFrame([(i, j, float(v[i, j])) for i in range(5) for j in range(4)], f"cell_id int, cpg_idx int, {c} double")
    models = {n: table(p[k], "p") for k, n in enumerate("wxyz")}
    more = models["z"].unionByName(spark.createDataFrame([(9, 9, 0.5)], "cell_id int, cpg_idx int, p double"))
    rows = E.compare(table(y, "y"), models | {"z": more}, ["cell_id", "cpg_idx"], ["cell_id"])
    got = {r["cell_id"]: r for r in rows.collect()}
    for i in range(5):
        mae = {n: np.abs(p[k, i] - y[i]).mean() for k, n in enumerate("wxyz")}
        assert got[i]["n"] == 4 and all(got[i][f"mae_{n}"] == pytest.approx(mae[n]) for n in mae) and all(got[i][f"delta_{n}"] == pytest.approx(mae[n] - mae["w"]) for n in "xyz")
    assert len(got) == 5
    for bad in (models["y"].where("cpg_idx > 0"), models["y"].unionByName(models["y"].where("cpg_idx = 1")), models["y"].withColumn("p", F.when(F.col("cpg_idx") > 0, F.col("p")))):
        with pytest.raises(Exception, match="one value for each target"):
            E.compare(table(y, "y"), models | {"y": bad}, ["cell_id", "cpg_idx"], ["cell_id"]).collect()
    limits = {r["model"]: r for r in E.compare_intervals(rows, "cell_id", ["x", "y", "z"], 200).collect()}
    assert limits.keys() == {"x", "y", "z"} and all(r["lo"] <= r["mean"] <= r["hi"] for r in limits.values())
    twice = E.compare_intervals(rows.withColumn("delta_y", 2 * F.col("delta_x")), "cell_id", ["x", "y"], 200).collect()
    assert [twice[1][c] for c in ("mean", "lo", "hi")] == [pytest.approx(2 * twice[0][c]) for c in ("mean", "lo", "hi")]  # the same draws
    asked = E.candidates(models["w"].where("cell_id < 2"), models["x"].where("cell_id = 1"), keys=["cell_id", "cpg_idx"])
    assert asked.count() == 8


def test_solver_status(spark):
    a, b = np.array([[1.0, 0.2], [0.3, 1.0], [0.5, 0.5]]), np.array([1.0, 1.3, 1.0])
    x, done = D.solved(a, b)
    assert done and np.allclose(x, D.nnls(a, b)) and not D.solved(a, b, rounds=1)[1]
    assert D.solved(np.zeros((3, 2)), b)[1]
    sig = spark.createDataFrame([(t, f"P{k + 1}", float(a[k, t])) for t in range(2) for k in range(3)], "cell_type long, pattern string, beta double")
    feat = spark.createDataFrame([(1, f"P{k + 1}", float(b[k]), 5) for k in range(3)] + [(2, "P1", None, 0)], "cell_id long, pattern string, beta double, n_o long")
    got = {(r["cell_id"], r["cell_type"]): r for r in D.deconvolve(sig, feat, status=True).collect()}
    assert got[1, 0]["converged"] and got[1, 0]["n_used"] == 3 and got[2, 1]["converged"] is None and got[2, 1]["n_used"] == 0 and got[2, 1]["proportion"] == 0
    assert D.deconvolve(sig, feat).columns == ["cell_id", "cell_type", "proportion"]


def test_index_is_checked(spark):
    units = spark.createDataFrame([(0, 0, 3), (1, 3, 2)], "unit int, output_offset long, cpg_count long")
    good = [(i, int(i >= 3), 10 + i) for i in range(5)]
    table = lambda rows: spark.createDataFrame(rows, "dest long, unit int, cpg_idx long")
    cpgs = spark.range(10, 15).withColumnRenamed("id", "cpg_idx")
    U.check_index(table(good), units, cpgs)
    for k, row in ((0, (0, 0, 99)), (0, (1, 0, 10)), (0, (0, 1, 10)), (4, (5, 1, 14)), (1, (1, 0, 10)), (0, (0, 7, 10))):
        with pytest.raises(ValueError):
            U.check_index(table([row if i == k else r for i, r in enumerate(good)]), units, cpgs)
    with pytest.raises(ValueError):
        U.check_index(table(good[:4]), units, cpgs)
    with pytest.raises(ValueError):
        U.check_index(table(good), units.where("unit = 0"), cpgs)


def test_wanted_outputs_in_range(spark):
    units = spark.createDataFrame([(0, "direct", 0, [], [1.0, 2.0], [], [0.0, 0.5], [0, 1])], "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>")
    wanted = lambda *c: spark.createDataFrame([(x,) for x in c], "cpg_idx long")
    assert V.select_outputs(units, wanted(1, 1), 2).first()["cpgs"] == [1]
    for bad in (2, -1, None):
        with pytest.raises(ValueError):
            V.select_outputs(units, wanted(0, bad), 2)


def test_descriptions_by_kind(spark):
    def told(tables, kind):
        return {r["key"]: r["value"] for r in A.describe(tables, kind).collect()}

    units = spark.createDataFrame([(0, "pure", "factor", 2, [0.0] * 2, [0.0] * 6, [0.0] * 8, [0.0] * 4, [1, 2, 3, 4], 0.25), (1, "PNA", "direct", 0, [], [0.0] * 3, [], [0.0], [5], 0.5)], "unit int, class string, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>, best_mae double")
    got = told({"units": units}, "units")
    assert [got[k] for k in ("units", "pure", "mixed", "PNA", "factor", "direct", "least_rank", "greatest_rank", "input_dim", "cpgs", "parameters", "mean_best_mae")] == ["2", "1", "0", "1", "1", "1", "2", "2", "3", "5", "24", "0.375"]
    trunk = spark.createDataFrame([(3, 4, 2, 5)], "n_input int, hidden int, rank int, patterns int")
    sites = spark.createDataFrame([(0, [1, 2]), (1, [3])], "unit int, cpgs array<long>")
    got = told({"trunk": trunk, "sites": sites}, "trunk")
    assert [got[k] for k in ("n_input", "hidden", "rank", "patterns", "blocks", "cpgs")] == ["3", "4", "2", "5", "2", "3"]
    sig = spark.createDataFrame([("a", "P1", 0.1), ("b", "P1", 0.2)], "cell_type string, pattern string, beta double")
    assert told({"signature": sig}, "signature")["cell_types"] == "2" and told({"signature": sig}, "other") == {"kind": "other", "signature.rows": "2", "signature.columns": "cell_type,pattern,beta"}
    linear = spark.createDataFrame([("P1", 1.0, 0.5, 0.25, 2.0)], "pattern string, weight double, mean double, bias double, scale double")
    got = told({"model": linear}, "linear")
    assert (got["features"], got["bias"], got["scale"]) == ("1", "0.25", "2.0")
    nodes = spark.createDataFrame([(0, 0, "a", 0, 1, None), (0, 0, "a", 1, None, 0.1), (0, 1, "b", 0, None, 0.3)], "round int, class_idx int, label string, node int, feature int, value double")
    got = told({"nodes": nodes}, "boosted")
    assert (got["rounds"], got["classes"], got["used_features"], got["leaves"], got["labels"]) == ("1", "2", "1", "2", "a,b")


def test_faults_of_an_index(spark):
    units = spark.createDataFrame([(0, 0, 3), (1, 3, 2)], "unit int, output_offset long, cpg_count long")
    cpgs = spark.range(10, 15).withColumnRenamed("id", "cpg_idx")

    def faults(rows, of=units):
        return {r["fault"]: r["n"] for r in U.index_faults(spark.createDataFrame(rows, "dest long, unit int, cpg_idx long"), of, cpgs).collect()}

    good = [(i, int(i >= 3), 10 + i) for i in range(5)]
    assert faults(good) == {}
    assert faults([(0, 0, 99), *good[1:]]) == {"missing": 1, "unknown": 1}
    assert faults([(0, 0, 11), *good[1:]]) == {"missing": 1, "repeated": 1}
    assert faults([(1, 0, 10), *good[1:]]) == {"shared": 1, "unfilled": 1}
    assert faults([(0, 1, 10), *good[1:]]) == {"outside": 1}
    assert faults([(None, 0, None), *good[1:]]) == {"missing": 1, "unknown": 1, "outside": 1}
    assert faults(good[:4]) == {"missing": 1, "unfilled": 1}
    assert faults([]) == {"missing": 5, "unfilled": 5}
    late = spark.createDataFrame([(0, 0, 2), (1, 3, 2)], "unit int, output_offset long, cpg_count long")
    assert faults(good, late) == {"outside": 1, "unfilled": 1, "gaps": 1}
    with pytest.raises(ValueError, match="1 missing, 1 unfilled"):
        U.check_index(spark.createDataFrame(good[:4], "dest long, unit int, cpg_idx long"), units, cpgs)
