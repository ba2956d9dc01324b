"""Line dedup, resampling and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.llm import line_dedup, resample, vector_codes

# --- line dedup


def brute_lines(rows, least=20, least_docs=3):
    """Rows of (doc_id, text); each row is a document."""
    low = lambda d: (d is not None, d or 0)

    def key(line):
        k = line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
        return k if len(k) >= least else None

    holders = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            holders.setdefault(k, []).append(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in holders and len(holders[key(x)]) >= least_docs and low(doc) != max(map(low, holders[key(x)])))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    pool = [f"line number {i} of the shared pool, café" for i in range(40)] + ["short", "", "   ", "é" * 19, "é" * 20, "exactly twenty chars"]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {rng.random()} of this document" for _ in range(rng.randrange(0, 12))]
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f"\t {x}\r", f"{x}\x0b\x0c"]) for x in lines]
        rows.append((rng.choice([i, i, i, -i]), "\n".join(lines)))
    hot = "a line that nearly every document of the table holds"
    rows += [(1000 + i, f"{hot}\nmiddle {i}\n{hot}  ") for i in range(60)]
    rows += [(None, f"{hot}\nwithout an id"), (None, None), (2000, None), (2001, ""), (2002, "\n\n"), (2003, "no-break space stays part of the key ")]
    rows += [(3000, "a row that comes again and again, word for word\nx")] * 40 + [(3000, "a row that comes again and again, word for word\nanother text")]
    rows += [(4000 + i, "a line of one very long document and two others") for i in range(2)] + [(5000, "\n".join(f"line {i} of one very long document, counted" for i in range(30_000)) + "\na line of one very long document and two others")]
    return rows


def test_lines_against_brute_force(docs):
    rows = line_rows()
    got = line_dedup.dedup(docs(rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)
    for least, least_docs in ((1, 2), (5, 10)):
        assert sorted(map(tuple, line_dedup.dedup(docs(rows), least, least_docs).collect()), key=str) == brute_lines(rows, least, least_docs)
    with pytest.raises(ValueError):
        line_dedup.dedup(docs(rows), 20, 1)


def test_lines_with_hot_lines_and_many_keys_in_a_shard(docs, monkeypatch):
    rows = line_rows()
    monkeypatch.setattr(line_dedup, "HOT_FLOOR", 5)
    monkeypatch.setattr(line_dedup, "HOT", 1 << 30)
    assert sorted(map(tuple, line_dedup.dedup(docs(rows)).collect()), key=str) == brute_lines(rows)
    monkeypatch.setattr(line_dedup, "HOT", 1 << 14)
    assert sorted(map(tuple, line_dedup.dedup(docs(rows)).collect()), key=str) == brute_lines(rows)


def test_lines_empty_tables(docs):
    assert line_dedup.dedup(docs([])).collect() == []
    assert [tuple(r) for r in line_dedup.dedup(docs([(1, None)]), keep_text=False).collect()] == [(1, 1, 0, hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    """Slots are 0 .. n - 1, each once; keys outside the index are told by their fingerprint."""
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    sizes, bits, slot = line_dedup.build(hi, lo)
    assert sorted(slot.tolist()) == list(range(n)) and sum(sizes) <= 8 * n + 64 * 20
    assert (line_dedup.slots(sizes, bits, hi, lo) == slot).all()
    prints = np.zeros(n, np.uint64)
    prints[slot] = hi
    other = rng.integers(0, 2**64, (2, 1000), dtype=np.uint64)
    at = line_dedup.slots(sizes, bits, *other)
    assert at.max(initial=-1) < max(n, 1)
    assert not (prints[at[at >= 0]] == other[0][at >= 0]).any()


def test_perfect_hash_of_keys_with_one_half_in_common():
    hi = np.zeros(500, np.uint64)
    lo = np.arange(500, dtype=np.uint64)
    assert sorted(line_dedup.build(hi, lo)[2].tolist()) == list(range(500)) == sorted(line_dedup.build(lo, hi)[2].tolist())


def test_lines_are_probed_and_not_joined(docs):
    """What is joined is documents with the numbers of their lines; line hashes meet arrays."""
    plan = line_dedup.dedup(docs(line_rows()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "lines#" in plan and "Cartesian" not in plan


# --- resampling

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def feats(text, most=1, buckets=10_000):
    words = _WORD.findall((text or "").encode().lower().decode())
    grams = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def brute_draw(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    own, aim = {}, {}
    for counts, texts in ((own, [t for _, t in rows]), (aim, target)):
        for t in texts:
            for b in feats(t, most, buckets)[1]:
                counts[b] = counts.get(b, 0) + 1
    s, t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim.get(b, 0) + 1) * (s + buckets) / ((n + 1) * (t + buckets)))) for b, n in own.items()}
    out = []
    for doc, text in rows:
        n, found = feats(text, most, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def draw_rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "naïve", "日本", "x_y", "don't", "3rd"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120)))) for i in range(200)]
    rows += [(None, " ".join(["w1", "w2"] * 30)), (None, None), (900, None), (901, ""), (902, "?!\n"), (903, "w1\x00w2"), (904, "word " * 200_000), (7, "w5 " * 25), (7, "w6 " * 25)]
    target = [" ".join(rng.choice(vocabulary[:40]) for _ in range(80)) for _ in range(12)] + [None, "", "Unseen WORDS"]
    return rows, target


def test_draw_against_brute_force(spark, docs):
    rows, target = draw_rows()
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs(rows), aims)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(rows, target)
    options = {"most": 3, "buckets": 101, "percent": 35, "least_words": 1, "seed": 5}
    want = brute_draw(rows, target, 3, 101, 35, 1, 5)
    assert sorted(map(tuple, resample.resample(docs(rows), aims, **options).collect()), key=str) == want


def test_draw_of_repeated_rows_and_texts(spark, docs):
    """Equal rows each have a place; the drawn rows come whole, also where such a group is drawn in part."""
    rows = [(1, "a b c " * 10)] * 57 + [(2, "q r s " * 10)] * 44
    aims = spark.createDataFrame([("a b",)], "text string")
    d = docs(rows)
    got = sorted(map(tuple, resample.resample(d, aims).collect()), key=str)
    want = brute_draw(rows, ["a b"])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 11))
    assert [r[:4] for r in got if r[4]] == [r[:4] for r in want if r[4]] and len(got) == len(rows)
    for percent in (10, 60, 100):
        drawn = resample.draw(d, aims, percent=percent)
        assert drawn.columns == d.columns and drawn.count() == percent * len(rows) // 100
    assert resample.draw(docs(draw_rows()[0]), aims, least_words=1).count() == sum(1 for r in brute_draw(draw_rows()[0], ["a b"], least=1) if r[4])


def test_draw_with_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs([]), none).collect() == [] and resample.draw(docs([]), none).collect() == []
    rows = draw_rows()[0]
    assert sorted(map(tuple, resample.resample(docs(rows), none).collect()), key=str) == brute_draw(rows, [])


def test_postings_are_split_by_salt(docs, spark, monkeypatch):
    """A group of buckets is in several parts, each of which computes the same gains."""
    monkeypatch.setattr(resample, "GROUPS", 3)
    rows, target = draw_rows()
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(map(tuple, resample.resample(docs(rows), aims).collect()), key=str) == brute_draw(rows, target)


# --- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Rows of (id, label, vector) of Python numbers."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**43 for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    kept = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, _, v in kept[:entries]] for p in range(parts)]

    def near(y, book):
        return min((sum((a - b) ** 2 for a, b in zip(y, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, _, v in kept:
                got.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, ys in got.items():
                books[p][e] = [sum(c) // len(ys) for c in zip(*ys)]
    out = []
    for i, lab, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(g for g, _ in found)))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by = {}
    for _, lab, _, e in out:
        by[lab] = by.get(lab, 0) + e
    return sorted(((i, lab, code, e, by[lab], sha) for i, lab, code, e in out), key=str)


def vector_rows(spark, rows):
    return spark.createDataFrame([(v, i, lab, "x", 1) for i, lab, v in rows], "embedding array<double>, vec_id long, label int, code string, part int").repartition(3)


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 5) if i % 7 else None, (rng.integers(-4, 5, 8) / 2).tolist()) for i in rng.permutation(200).tolist()]  # many parts at equal distances
    rows += [(300, 1, None), (301, 1, [1.0, None]), (302, 2, [float("nan")] * 8), (303, 2, [float("-inf")] * 8), (None, 3, [0.25] * 8), (5, 3, [0.5] * 8), (304, None, [1.0, -1.0, 0.3]), (305, 4, [])]
    for options in ({}, {"entries": 16, "rounds": 3}, {"parts": 3, "entries": 30, "rounds": 1}, {"entries": 1}):
        got = vector_codes.compress(vector_rows(spark, rows), **options)
        assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, **options)


def test_codes_of_large_components(spark):
    """Beyond 64-bit squares all is still exact; errors that don't fit a long are null."""
    rng = np.random.default_rng(4)
    rows = [(i, 1, (rng.normal(size=4) * (2.0**42 if i % 9 == 0 else 1e6)).clip(-(2.0**42), 2.0**42).tolist()) for i in range(60)] + [(99, 1, [2.0**43, 0.0, 0.0, 0.0])]
    got = vector_codes.compress(vector_rows(spark, rows), entries=5, rounds=2).collect()
    fit = lambda x: x if x < 2**63 else None
    assert sorted(map(tuple, got), key=str) == sorted(((i, lab, c, fit(e), fit(s), h) for i, lab, c, e, s, h in brute_codes(rows, entries=5, rounds=2)), key=str)


def test_codes_of_empty_tables_and_many_labels(spark, monkeypatch):
    assert vector_codes.compress(vector_rows(spark, [])).collect() == []
    assert vector_codes.compress(vector_rows(spark, [(1, 1, None)])).collect() == []
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)
    rows = [(i, i % 3 if i % 4 else None, [i / 7, -i / 3, 0.0, 1.0]) for i in range(90)]
    got = vector_codes.compress(vector_rows(spark, rows), entries=10)
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, entries=10)
    with pytest.raises(ValueError):
        vector_codes.compress(vector_rows(spark, rows), entries=257)


@pytest.mark.parametrize("spread", [2, 50, 10**6, 2**40])
def test_nearest_entry(spread):
    rng = np.random.default_rng(spread % 97)
    book, x = rng.integers(-spread, spread + 1, (256, 4)), rng.integers(-spread, spread + 1, (300, 4))
    index, gap = vector_codes.nearest(x, book, vector_codes.tree(book))
    for i in range(len(x)):
        gaps = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], e)) for e in book]
        assert gap[i] == min(gaps) and index[i] == gaps.index(min(gaps))


def test_queries_have_the_contract_columns(spark, small):
    from cpgloom.llm import queries

    assert queries.op11_line_dedup(spark, small).columns[:4] == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert queries.op12_resampling(spark, small).dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert dict(queries.op13_vector_codes(spark, small).dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
