"""Readers, artifacts, streaming and the entry point."""

import importlib
import random
import sys

import pytest

from cpgloom.operators import classify, evaluate, features
from cpgloom.sources import artifacts, readers
from cpgloom.streaming import inference


def put(path, text):
    path.write_text(text)
    return str(path)


def test_labels(spark, tmp_path):
    path = put(tmp_path / "labels.txt", " b \n\na\n")
    assert [r["label"] for r in readers.labels(spark, path, 2).orderBy("cell_id").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        readers.labels(spark, path, 3)


def test_splits(spark, tmp_path):
    path = put(tmp_path / "split.tsv", "# note\ncell\tsplit\n1\tval\n0\ttrain\tx\n\n2\ttest\n")
    assert {r["cell_id"]: r["split"] for r in readers.splits(spark, path, 3).collect()} == {0: "train", 1: "val", 2: "test"}
    for bad in ("0\ttrain\n0\tval\n", "0\ttrain\n1\ttest\n", "0\ttrain\n1\tother\n"):
        with pytest.raises(ValueError):
            readers.splits(spark, put(tmp_path / "bad.tsv", bad), 2)


def test_signature_and_features(spark, tmp_path):
    path = put(tmp_path / "sig.tsv", "cell\tP1\tP2\na\t0.5\tNA\nb\t0.25\t1\n")
    got = {(r["cell_type"], r["pattern"]): r["beta"] for r in readers.signature(spark, path).collect()}
    assert got == {("a", "P1"): 0.5, ("a", "P2"): None, ("b", "P1"): 0.25, ("b", "P2"): 1.0}
    with pytest.raises(ValueError):
        readers.signature(spark, put(tmp_path / "one.tsv", "cell\tP1\na\t0.5\n"))
    path = put(tmp_path / "feat.tsv", "x\ty\n1\tnan\n\t2\n")
    assert {(r["x"], r["y"]) for r in readers.features(spark, path, ["x", "y"]).collect()} == {(1.0, None), (None, 2.0)}
    path = put(tmp_path / "bad.tsv", "1\t2\n3\toops\n4\t5\n")
    assert sorted((r["x"], r["y"]) for r in readers.features(spark, path, ["x", "y"]).na.fill(-1).collect()) == [(1.0, 2.0), (3.0, -1.0), (4.0, 5.0)]


def test_samples_and_model_labels(spark, tmp_path):
    path = put(tmp_path / "names.idx", "s1\t0\ns2\t99\n")
    assert [r["name"] for r in readers.samples(spark, path).orderBy("sample_id").collect()] == ["s1", "s2"]
    path = put(tmp_path / "meta.tsv", "num\t2\nlabels\tx,y\n")
    assert [r["label"] for r in readers.model_labels(spark, path).orderBy("class_idx").collect()] == ["x", "y"]


def test_artifact_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    artifacts.save(str(tmp_path / "art"), "demo", {"t": df})
    assert artifacts.load(spark, str(tmp_path / "art"), "demo")["t"].collect() == df.collect()
    with pytest.raises(ValueError):
        artifacts.load(spark, str(tmp_path / "art"), "other")
    df.selectExpr("cast(k AS string) k", "v").write.mode("overwrite").parquet(str(tmp_path / "art" / "t"))
    with pytest.raises(ValueError):
        artifacts.load(spark, str(tmp_path / "art"))


def test_stream(spark, tmp_path):
    masked = spark.createDataFrame([(0, "P1"), (1, "Pna")], "cpg_idx long, state string")
    model = spark.createDataFrame([("P1", 2.0, 0.5, -1.0, 1.0)], "pattern string, weight double, mean double, bias double, scale double")
    obs = spark.createDataFrame([(5, 0, 9, 1), (6, 0, 1, 9)], inference.SCHEMA)
    obs.coalesce(1).write.parquet(str(tmp_path / "in"))
    inference.classify_stream(spark, str(tmp_path / "in"), masked, ["P1", "Pna"], model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["cell_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["cell_id"]: r["label"] for r in classify.score_linear(features.features(obs, masked, ["P1", "Pna"]), model).collect()}
    assert got == want == {5: 1, 6: 0}


def test_entry_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and "pattern_rank" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_names(spark, tmp_path):
    path = put(tmp_path / "names.idx", "s1\t0\ns2\t99\n")
    assert readers.samples(spark, path, records=2).count() == 2
    with pytest.raises(ValueError):
        readers.samples(spark, path, records=3)
    got = readers.named(spark.range(3).withColumnRenamed("id", "cell_id"), readers.samples(spark, path))
    assert {r["cell_id"]: r["name"] for r in got.collect()} == {0: "s1", 1: "s2", 2: "3"}


def test_unit_ids(spark, tmp_path):
    assert sorted(r["unit"] for r in readers.unit_ids(spark, put(tmp_path / "units", "3\n 1\n\n"), 4).collect()) == [1, 3]
    for bad in ("", "4\n", "1\n1\n", "1\nx\n", "-1\n"):
        with pytest.raises(ValueError):
            readers.unit_ids(spark, put(tmp_path / "bad", bad), 4)


def test_pattern_texts(spark, tmp_path):
    counts = readers.pattern_counts(spark, put(tmp_path / "counts", "      2 010\n      1 222\n"))
    assert {r["pattern"]: r["n"] for r in counts.collect()} == {"010": 2, "222": 1}
    readers.check_patterns(readers.site_patterns(spark, put(tmp_path / "sites", "010\n222\n010\n")), counts)
    for bad in ("010\n222\n", "010\n222\n010\n010\n", "010\n222\n011\n"):
        with pytest.raises(ValueError):
            readers.check_patterns(readers.site_patterns(spark, put(tmp_path / "bad", bad)), counts)
    for bad in ("2 010\n2 010\n", "0 010\n", "x 010\n", "5000000000 010\n"):
        with pytest.raises(ValueError):
            readers.pattern_counts(spark, put(tmp_path / "bad", bad))


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    lines = ["".join(random.Random(i).choices("01", k=7)) for i in range(3000)]
    for k in range(3):
        put(tmp_path / "many" / f"part-{k}", "\n".join(lines[k * 1000 : (k + 1) * 1000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.site_patterns(spark, str(tmp_path / "many"))
        assert [r["pattern"] for r in got.orderBy("cpg_idx").collect()] == lines
        assert [r["cpg_idx"] for r in got.orderBy("cpg_idx").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chosen_states():
    states = ["P1", "P2", "Pna"]
    assert features.chosen(states) == ["P1", "P2"] and features.chosen(states, include_pna=True) == states and features.chosen(states, 1) == ["P1"]
    for first in (4, -1):
        with pytest.raises(ValueError):
            features.chosen(states, first)


def test_levels():
    assert evaluate.parse_levels(" 50%, 7,,10 , 0.07%", 10_000) == [7, 10, 5000]
    with pytest.raises(ValueError):
        evaluate.parse_levels(" , ", 10)
