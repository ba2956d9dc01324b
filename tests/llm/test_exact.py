"""Mixing, top-k search, BPE and the pipeline."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cpgloom.llm import bpe, mixing, queries, topk


def sainte_lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda k: (weights[k] / (2 * got[k] + 1), -k))
        got[i] += 1
    return got


def test_apportion(spark):
    rng = random.Random(1)
    for _ in range(6):
        weights, seats = [float(rng.randrange(1, 400)) for _ in range(rng.randrange(1, 9))], rng.randrange(0, 60)
        rows = spark.createDataFrame([(1, i, w, seats, 10**6) for i, w in enumerate(weights)], "g int, k int, w double, seats long, most long")
        got = [r["quota"] for r in mixing.apportion(rows, ["g"], "w", "seats", "k", "most").orderBy("k").collect()]
        assert got == sainte_lague(weights, seats)


def water_fill(sizes, weights, repeats=3):
    capped, total = {}, sum(sizes)
    while True:
        left = total - sum(capped.values())
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        aims = [capped.get(i, weights[i] * left / share if share else 0) for i in range(len(sizes))]
        over = [i for i in range(len(sizes)) if i not in capped and aims[i] > repeats * sizes[i]]
        if not over:
            return aims
        capped |= {i: repeats * sizes[i] for i in over}


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(8):
        n = rng.randrange(1, 8)
        sizes, weights = [rng.choice([0, 1, 10, 1000]) * rng.randrange(1, 5) for _ in range(n)], [1.0 + i % 3 for i in range(n)]
        rows = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
        got = [r["target"] for r in mixing.targets(rows).orderBy("source").collect()]
        assert got == pytest.approx(water_fill(sizes, weights))


def test_mix(docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), rng.choice(["a", "b", "c", "B", None, "z"])) for i in range(300)] + [(None, "x y", "a"), (7, "x y", "a"), (7, "x y", "a"), (8, None, "b")]
    d = docs(rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted([s for s in sizes if s is not None]) + [None]
    aims = dict(zip(order, water_fill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(aims[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - aims[s]) <= 3 * mixing.BLOCK
    again = mixing.mix(d.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    made = mixing.materialise_mix(d)
    assert made.columns == d.columns
    words = made.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix(docs([])).count() == 0 and mixing.materialise_mix(docs([])).count() == 0


def test_mix_in_groups_of_shards(docs, monkeypatch):
    """Many shards in several groups: sources come as near to their targets as with one group; repeated and very long rows too."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 4)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 5)
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice("aab")) for i in range(400)] + [(900, "v " * 60_000, "b")] + [(None, "same words again", "a")] * 200
    d = docs(rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * mixing.BLOCK * (1 + len(own) / 4)  # a shard's last block isn't full
    made = mixing.materialise_mix(d)
    assert made.columns == d.columns
    assert made.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == made.sparkSession.createDataFrame(got).agg(F.sum("taken")).first()[0]


def test_mix_is_native(docs):
    plan = mixing.mix(docs([(1, "a b c", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_top(rows, k):
    out = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    raw = [(i, rng.normal(size=int(rng.choice([20, 20, 20, 7]))).astype(np.float32).tolist()) for i in range(400)]
    raw += [(500 + i, raw[i][1]) for i in range(50)]
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in raw]
    odd = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf")]), (None, [1.0])]
    rows = topk.quantised(spark.createDataFrame(raw + odd, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = topk.top_k(rows.where("id % 50 = 0"), rows, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(ints, 5)
    assert topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0
    few = rows.where("id < 3")
    assert topk.top_k(few.where("id = 0"), few, 5).count() == 2
    assert topk.top_k(few.where("id < 0"), few, 5).count() == 0


def test_top_k_of_large_components(spark):
    """Scores are exact where neither float64 nor a long holds the products."""
    raw = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [0.0, 3.5]), (50, [0.0, 2.0**60]), (51, [2.0**55, -1.0]), (52, [1e300, -1e300]), (53, [2.0**43 + 0.5, 0.0]), (100, [1.0, 0.0])]
    ints = [(i, [int(x) * 256 if abs(x) >= 2**52 else int(np.floor(256 * x)) for x in v]) for i, v in raw]
    rows = topk.quantised(spark.createDataFrame(raw, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(rows.where("id % 50 = 0"), rows, 5).collect())
    assert got == [(*r[:3], r[3] if abs(r[3]) < 2**63 else None) for r in brute_top(ints, 5)]
    assert any(r[3] is None for r in got) and any(r[3] is not None and r[3] > 2**53 for r in got)


def test_blocks_of_small_norms_are_left_out(spark, monkeypatch):
    """Vectors of very different norms in many blocks: the same results, from a fraction of the block pairs."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SEEDS", 32)
    rng = np.random.default_rng(4)
    raw = [(i, (np.abs(rng.normal(size=8)) * float(0.97**i)).tolist()) for i in range(400)]
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in raw]
    rows = topk.quantised(spark.createDataFrame(raw, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk.top_k(rows.where("id % 50 = 0"), rows, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(ints, 5)


def test_bounds_drop_no_result():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-300, 300, (64, 900)), rng.integers(-300, 300, (64, 12))
    score = q.T @ v
    want = [(5000 + j, int(i), int(score[j, i])) for j in range(12) for i in np.lexsort((np.arange(900), -score[j]))[:5]]
    for bounds in (None, np.sort(score, 1)[:, -5].astype(float), np.full(12, -np.inf)):
        assert topk.search_block(q / 256, np.arange(5000, 5012), v / 256, np.arange(900), 5, step=4, bounds=bounds) == want


def test_bpe_equals_the_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    points = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    texts = ["", "a", "aaaaaaaaaaa aaaa", "don't 'S 've I'LL", "<|endoftext|>x<|endoftext|><|endoftext|>", " \n\n  x 　 \x1c\x1d\x85 y", "x" * 3000, "ab" * 2000 + " 123456", "\U0001f600́é 漢字"]
    texts += ["".join(rng.choice(points) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    texts += [" ".join(rng.choice(["the", "Model", "überall", "x1", "--", "'s", "\t"]) for _ in range(50)) for _ in range(50)]
    rows = [*enumerate(texts), (None, None), (3, texts[3])]
    got = bpe.encode(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        ids = ref.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == ref.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_digests(docs(rows)).collect():
        ids = ref.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(docs([])).count() == 0


def test_top_k_sums_integers_for_large_vectors_only(monkeypatch):
    """A few huge components among ordinary ones: the same results, and no other vector becomes Python integers."""
    rng = np.random.default_rng(8)
    q, v = rng.normal(size=(12, 7)), rng.normal(size=(12, 300))
    v[3, 5], v[7, 90], v[0, 91], q[2, 6] = 3e12, -4e200, 1.7e308, 5e14
    v[:, 10], q[:, 1] = 0.0, 0.0
    ids, own = np.arange(300), np.arange(295, 302)
    shapes = []
    whole = topk._integers
    monkeypatch.setattr(topk, "_integers", lambda x: shapes.append(x.shape) or whole(x))
    for k in (3, 400):
        want = []
        for j, o in enumerate(own.tolist()):
            scores = [(-sum(math.floor(Fraction(float(a)) * 256) * math.floor(Fraction(float(b)) * 256) for a, b in zip(q[:, j], v[:, i])), i) for i in ids.tolist() if i != o]
            want += [(o, i, -s) for s, i in sorted(scores)[:k]]
        assert topk.search_block(q, own, v, ids, k, step=5) == want
    shapes.clear()
    topk.search_block(q[:, :6], own[:6], v, ids, 3)
    assert shapes[0] == (12, 3) and set(shapes[1:]) <= {(12, 1)}


def test_bpe_splits_every_class_of_code_points():
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    for c in [*range(0, 0x3000, 7), *range(0x10000, 0x1F000, 61), 0x1C89, 0x10D40, 0x16D70, 0x2028, 0xFEFF]:
        text = f"a{chr(c)}b 1{chr(c)} ({chr(c)})  "
        assert bpe.words_of(text) == [text[a:b] for _, (a, b) in ref.pre_tokenize_str(text)], hex(c)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    want = c.execute(queries.ORACLES[name])
    columns = [x[0] for x in want.description]
    rows = sorted(want.fetchall(), key=str)
    assert rows == sorted(map(tuple, queries.QUERIES[name](spark, small).select(*columns).collect()), key=str)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, small)
        assert out.columns == columns
        seen.append(out.count())
    assert seen[0] >= seen[1] >= seen[2] == seen[3] > 0
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() == seen[4]
    assert rows.where(F.size("ids") != F.col("n_tokens")).count() == 0
