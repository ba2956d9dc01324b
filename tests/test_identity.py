"""A kept unit is used again only where all that its training depends on is the same."""

import pytest
from pyspark.sql import functions as F

from cpgloom.operators import train as T
from cpgloom.operators import upscale as V


@pytest.fixture(scope="module")
def base(spark):
    o = T.Options(pure_rank=1, mixed_rank=2, batch=3, min_steps=1, max_steps=3, evaluate=1, patience=1, checks=1)
    units = spark.createDataFrame([(0, 0, "pure"), (1, 5, "mixed")], "unit int, output_offset long, class string")
    places = spark.createDataFrame([(i, int(i >= 5), 100 + i) for i in range(10)], "dest long, unit int, cpg_idx long")
    return {
        "options": o, "units": units, "places": places,
        "codes": spark.createDataFrame([(c, 100 + i, 1000 * i + c) for c in range(4) for i in range(10)], "cell_id long, cpg_idx long, code int"),
        "sampled": spark.createDataFrame([(r, c, 101 + r) for r in range(2) for c in range(4)], "rep int, cell_id long, cpg_idx long"),
        "split": spark.createDataFrame([(0, "train"), (1, "train"), (2, "val"), (3, "test")], "cell_id long, split string"),
        "x": spark.createDataFrame([(r, c, [float(r), float(c)]) for r in range(2) for c in range(4)], "rep int, cell_id long, x array<double>"),
        "prior": spark.createDataFrame([(100 + i, 0.1 * i) for i in range(10)], "cpg_idx long, logit double"),
        "trunk": "",
    }


def made(t):
    truth = T.held(t["codes"], t["places"], t["units"])
    drawn = T.schedule(truth.select("unit", "cell_id").join(t["split"], "cell_id"), 2, t["options"])
    observed, layout = T.seen(t["sampled"], t["places"], t["units"]), T.layout(t["places"], t["units"], t["prior"])
    return truth, drawn, observed, layout


def runs(t):
    truth, drawn, observed, layout = made(t)
    return {r["unit"]: r["run"] for r in T.identity(layout, truth, observed, drawn, t["x"], t["options"], t["trunk"]).collect()}


def code(c, value):
    return F.when(c, value).otherwise(F.col("code")).cast("int").alias("code")


CHANGES = {
    # everything that the reference's key or its header has, and the data themselves: which units it changes
    "unit numbers": ({0, 1}, lambda t: {"units": t["units"].withColumn("unit", 1 - F.col("unit")), "places": t["places"].withColumn("unit", 1 - F.col("unit"))}),
    "order of CpGs": ({0}, lambda t: {"places": t["places"].withColumn("cpg_idx", F.when(F.col("dest") == 0, 101).when(F.col("dest") == 1, 100).otherwise(F.col("cpg_idx")))}),
    "number of CpGs": ({1}, lambda t: {"places": t["places"].where("dest < 9")}),
    "class": ({0}, lambda t: {"units": t["units"].withColumn("class", F.lit("mixed"))}),
    "mode": ({0, 1}, lambda t: {"options": T.replace(t["options"], direct=True)}),
    "rank": ({0, 1}, lambda t: {"options": T.replace(t["options"], pure_rank=3)}),
    "activation": ({0, 1}, lambda t: {"options": T.replace(t["options"], linear=False)}),
    "input width": ({0, 1}, lambda t: {"x": t["x"].withColumn("x", F.concat("x", F.array(F.lit(0.0))))}),
    "input values": ({0, 1}, lambda t: {"x": t["x"].withColumn("x", F.transform("x", lambda v: v * 1.5))}),
    "trunk": ({0, 1}, lambda t: {"trunk": "other"}),
    "seed": ({0, 1}, lambda t: {"options": T.replace(t["options"], seed=9)}),
    "schedule": ({0, 1}, lambda t: {"options": T.replace(t["options"], patience=2)}),
    "rate": ({0, 1}, lambda t: {"options": T.replace(t["options"], lr=0.5)}),
    "split": ({0, 1}, lambda t: {"split": t["split"].withColumn("split", F.when(F.col("cell_id") == 3, "train").otherwise(F.col("split")))}),
    "truth": ({1}, lambda t: {"codes": t["codes"].select("cell_id", "cpg_idx", code((F.col("cpg_idx") == 107) & (F.col("cell_id") == 1), 7))}),
    "sampling": ({0}, lambda t: {"sampled": t["sampled"].withColumn("cpg_idx", F.when(F.col("cell_id") == 0, 103).otherwise(F.col("cpg_idx")))}),
    "prior": ({1}, lambda t: {"prior": t["prior"].withColumn("logit", F.when(F.col("cpg_idx") == 109, 5.0).otherwise(F.col("logit")))}),
}


def test_each_field_alone_changes_the_key(base):
    first = runs(base)
    shuffled = {k: v.repartition(5) if k in ("codes", "sampled", "x", "prior", "places", "split") else v for k, v in base.items()}
    assert runs(shuffled) == first and len(set(first.values())) == 2
    for name, (changed, how) in CHANGES.items():
        now = runs(base | how(base))
        assert {u for u in first if now[u] != first[u]} == changed, name


def test_resume_trains_what_has_changed(spark, base, tmp_path):
    asked = []

    def resumed(t):
        truth, drawn, observed, layout = made(t)
        key = T.identity(layout, truth, observed, drawn, t["x"], t["options"])
        rows = T.batches(drawn, truth, observed, t["options"])

        def train(own):
            asked.append(sorted({r["unit"] for r in own.select("unit").collect()}))
            return T.train_units(own, t["x"], layout, t["options"], key)

        return T.resume(spark, str(tmp_path / "kept"), rows, train, t["options"], key)

    first = {r["unit"]: r for r in resumed(base).collect()}
    other = base | CHANGES["truth"][1](base)
    again = {r["unit"]: r for r in resumed(other).collect()}
    back = {r["unit"]: r for r in resumed(base).collect()}
    assert asked == [[0, 1], [1], []]
    assert first == back and again[0] == first[0] and again[1]["run"] != first[1]["run"] and len(again) == 2
    layout = resumed(base | CHANGES["order of CpGs"][1](base))
    assert asked[-1] == [0] and {r["unit"]: r["cpgs"][:2] for r in layout.collect()}[0] == [101, 100]
    out = T.exported(spark.createDataFrame(list(first.values()), T.UNITS)).orderBy("unit").collect()
    assert [(r["unit"], r["mode"], r["rank"], r["input_dim"], r["cpg_count"], r["param_floats"]) for r in out] == [(0, "factor", 1, 2, 5, 1 + 2 + 5 + 5), (1, "factor", 2, 2, 5, 2 + 4 + 10 + 5)]
    direct = spark.createDataFrame([(3, "direct", 0, [], [0.0] * 6, [], [0.0] * 3, [1, 2, 3], 5, 0.1, "r")], "unit int, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>, best_step int, best_mae double, run string")
    r = T.exported(direct).first()
    assert (r["input_dim"], r["param_floats"]) == (2, 9) and T.exported(direct, direct.where("unit = 4")).count() == 0
    assert V.upscale(base["x"].where("rep = 0").select("cell_id", "x"), spark.createDataFrame(list(again.values()), T.UNITS)).count() == 40
