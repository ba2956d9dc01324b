"""The pipeline: each stage against brute force on its own input, and edge cases through the whole run."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cpgloom.llm import mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def prose(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do eius tempor labore magna aliqua enim minim veniam".split()) + rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(n))


def corpus(seed=1):
    """Rows of (doc_id, text, source) with toxic texts, near copies, personal data, nulls, repeats and a very long text; and labels."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randrange(20, 90))
        bad = rng.random() < 0.25
        if bad:
            w = text.split()
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "dolt"]))
            text = " ".join(w)
        if i % 9 == 0:
            text += f" write to user{i}@mail.org"
        rows.append((i, text, rng.choice(["a", "b", None])))
        labels.append((i, 1, int(bad)))
        if i % 12 == 0:
            near = text.split()
            near[-1] = "changed"
            rows += [(1000 + i, text, "b"), (2000 + i, " ".join(near), "a")]
    rows += [(None, None, "a"), (None, "", None), (None, "a lone text", "b"), (3000, None, "a"), (3001, " \n\t", "b"), (3002, prose(rng, 120_000), "a"), (3003, "same row", "b"), (3003, "same row", "b")]
    return rows, labels


@pytest.fixture
def folder(spark, tmp_path):
    """Writes documents and labels, with further columns of clashing names, and gives the folder."""
    def make(rows, labels):
        full = [(d, t, "en", s, None if t is None else len(t), "x", 1, 2) for d, t, s in rows]
        spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, place long, size int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def shingled(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_distinct(rows):
    """One row of each class by single links, the one with the smallest doc_id; wordless rows stay, but for repeats of one doc_id."""
    sets, group = [shingled(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, (d, t, _) in enumerate(rows):
        if sets[i]:
            best[group[i]] = min(best.get(group[i], (True, 0, "")), (d is None, d or 0, t)) if group[i] in best else (d is None, d or 0, t)
    return sorted([(d if not null else None, t) for null, d, t in best.values()] + [(d, t) for (d, t, _), s in zip(rows, sets) if not s], key=str)


def test_stages_equal_brute_force(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, labels = corpus()
    sf = folder(rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    read = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]

    weights, theta = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def toxic(text):
        words = {w.lower().encode() for w in re.findall(r"[A-Za-z0-9_]+", text or "")}
        hashes = {int(toxicity.row_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in words}
        return sum(weights[h] for h in hashes) >= theta[0]

    civil = stage["toxicity"](spark, docs, sf)
    assert sorted(read(civil), key=str) == sorted([r for r in rows if not toxic(r[1])], key=str)
    told = [i for i, _, bad in labels if bad]
    assert sum(toxic(rows_text) for i, rows_text, _ in rows if i in told) >= 0.9 * len(told) and len(read(civil)) > 0.7 * len(rows)

    distinct = stage["n-gram Jaccard join"](spark, civil, sf)
    assert sorted([r[:2] for r in read(distinct)], key=str) == brute_distinct(read(civil))

    private = stage["PII"](spark, distinct, sf)
    assert sorted(read(private), key=str) == sorted([(d, t if t is None else EMAIL.sub("<EMAIL>", t), s) for d, t, s in read(distinct)], key=str)
    assert private.where("n_chars IS DISTINCT FROM length(text)").count() == 0

    mixed = stage["mixing sources to target weights"](spark, private, sf)
    whole, seen = {}, {}
    for d, t, s in read(private):
        whole.setdefault((d, s), []).append(WORD.findall(t or ""))
    for d, t, s in read(mixed):
        w = WORD.findall(t or "")
        assert any(" ".join(w) in " ".join(x) for x in whole[d, s])
        seen[s] = seen.get(s, 0) + len(w)
    for r in mixing.mix(private).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert seen.get(r["source"], 0) == r["taken"] and abs(r["taken"] - r["target"]) <= 3 * mixing.BLOCK

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = stage["BPE encoding and decoding"](spark, mixed, sf)
    assert last.count() == mixed.count()
    for r in last.select("doc_id", "ids", "decoded").collect():
        assert ref.decode(r["ids"], skip_special_tokens=False) == r["decoded"]
    texts = sorted(t or "" for _, t, _ in read(mixed))
    assert sorted(r["decoded"] for r in last.collect()) == texts
    assert sorted(map(str, (r["ids"] for r in last.collect()))) == sorted(str(ref.encode(t, add_special_tokens=False).ids) for t in texts)


def test_run_on_edges(spark, folder):
    rows, labels = corpus(2)
    out = corpus_pipeline.run(spark, folder(rows, [*labels, (None, 1, 1), (1, None, None), (1, 0, 0)]))
    assert out.count() > 100 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "", "a"), (None, "", "a")]])
def test_run_on_next_to_nothing(spark, folder, rows):
    out = corpus_pipeline.run(spark, folder(rows, []))
    assert out.where(F.col("n_tokens") > 0).count() == 0
