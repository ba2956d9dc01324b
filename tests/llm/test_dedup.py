"""Substring dedup and the n-gram join against brute force, with edge cases."""

import hashlib
import random
import re

from cpgloom.llm import components, jaccard_join, rlz_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(rows, window):
    """Per row: words, removed words and digest of the rest."""
    out = []
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, d), d)
    for d, w in words:
        gone = set()
        if d is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < d:
                    gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_texts(seed, n, vocabulary=60):
    """Texts that share passages of many lengths, with edits, repeats and odd separators."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgé") + str(rng.randrange(vocabulary))
    passages = [[word() for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            part = list(rng.choice(passages)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(1, 30))]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = word()
            w += part
        out.append((i, rng.choice([" ", "\n", " \t ", "\x0b"]).join(w)))
    return out


def run_dedup(docs, rows, window, gram):
    got = rlz_dedup.dedup(docs(rows), window, gram).collect()
    words, gone = {}, {}
    for d, t in rows:
        words.setdefault(d, []).append(WORD.findall(t or ""))
    for r in got:
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        # every factor is a copy of that place of an earlier document, and the factors cover what is gone
        own = next(w for w in words[r["doc_id"]] if len(w) == r["n_words"] and rlz_dedup.cut(w, rlz_dedup.covered([tuple(f) for f in r["factors"]])) == r["kept"].split(" ")[: len(w) - r["n_removed"]])
        for f in r["factors"]:
            assert f["ref"] < r["doc_id"] and f["end"] - f["start"] >= window
            assert any(own[f["start"] : f["end"]] == w[f["at"] : f["at"] + f["end"] - f["start"]] for w in words[f["ref"]])
        for f, g in zip(r["factors"], r["factors"][1:]):
            # greedy: a factor doesn't end where its source goes on as the next window's source
            assert g["start"] > f["start"] and not (g["ref"] == f["ref"] and g["start"] == f["end"] - window + 1 and g["at"] == f["at"] + g["start"] - f["start"])
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=str)


def test_dedup_matches_brute_force(docs):
    for seed, window, gram in ((1, 10, 4), (2, 7, 7), (3, 20, 1)):
        rows = shared_texts(seed, 60)
        assert run_dedup(docs, rows, window, gram) == brute_dedup(rows, window)


def test_dedup_edges(docs):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text), (None, None), (1, None), (2, ""), (3, " \n"), (9, text), (9, text), (7, "x y"), (8, "z " * 3000), (10, "z " * 3000)]
    assert run_dedup(docs, rows, 50, 12) == brute_dedup(rows, 50)
    assert run_dedup(docs, [(None, None)][:0], 50, 12) == []


def test_no_break_space_is_part_of_a_word(docs):
    rows = [(1, "a b c d"), (2, "\x1c \x85")]
    assert [r[1] for r in run_dedup(docs, rows, 2, 1)] == [2, 2]


def test_factors():
    assert rlz_dedup.factors([(5, 2, 1, 30), (7, 1, 1, 32), (8, 3, 2, 0), (20, 1, 1, 9)], 10) == [(5, 17, 1, 30), (8, 20, 2, 0), (20, 30, 1, 9)]
    # the longest of the stretches around the first window left, of equal ones the first document's; copies that meet are one stretch
    assert rlz_dedup.factors([(0, 5, 1, 40), (0, 3, 2, 10), (3, 9, 2, 13), (4, 2, 0, 4), (12, 3, 7, 0), (12, 3, 3, 9)], 10) == [(0, 21, 2, 10), (12, 24, 3, 9)]
    assert rlz_dedup.factors([(0, 8, 5, 0), (2, 4, 1, 0), (6, 6, 9, 3)], 4) == [(0, 11, 5, 0), (8, 15, 9, 5)]
    assert rlz_dedup.factors([]) == []
    assert rlz_dedup.covered([(5, 17, 1, 30), (8, 20, 2, 0), (20, 30, 1, 9), (40, 50, 1, 0)]) == [(5, 30), (40, 50)]
    assert rlz_dedup.cut(list(range(12)), [(2, 5), (4, 6), (9, 12)]) == [0, 1, 6, 7, 8]


def greedy(words, doc, window):
    """Number of factors of the longest greedy parse of ``doc`` against all documents with smaller ids."""
    own, i, n = words[doc], 0, 0
    held = {}
    for d in range(doc):
        for p in range(len(words[d]) - window + 1):
            held.setdefault(tuple(words[d][p : p + window]), []).append((d, p))
    while i + window <= len(own):
        longest = 0
        for d, p in held.get(tuple(own[i : i + window]), ()):
            m = window
            while i + m < len(own) and p + m < len(words[d]) and own[i + m] == words[d][p + m]:
                m += 1
            longest = max(longest, m)
        n, i = (n + 1, i + longest - window + 1) if longest else (n, i + 1)
    return n


def test_longest_source_wins(docs):
    """A block's first place is not where it goes on longest: the run's own first place is taken."""
    rng = random.Random(4)
    a, b, c, d = ([f"p{k}_{rng.randrange(10**6)}" for _ in range(90)] for k in range(4))
    x, y = (lambda k=k: [f"{k}{rng.randrange(10**9)}" for _ in range(25)] for k in "xy")
    texts = [a, x() + a + b + y(), b + c, x() + a + b + c, x() + d + y(), x() + a + b + c + y(), c + d, x() + a + b + c + d, y() + a + b + c + d]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run_dedup(docs, rows, 20, 5) == brute_dedup(rows, 20)
    found = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in rlz_dedup.dedup(docs(rows), 20, 5).collect()}
    assert found[5] == [(25, 295, 3, 25)]
    assert found[8] == [(25, 385, 7, 25)]
    longest = {k: greedy(dict(enumerate(texts)), k, 20) for k in found}
    # document 7 needs a run that is no power of two: the factor gets more than half of its blocks, and one more follows
    assert {k: len(f) for k, f in found.items()} == longest | {7: longest[7] + 1}


def test_factors_against_the_longest_greedy_parse(docs):
    """Whole queries: nowhere fewer factors than the longest greedy parse, and in all not many more: a factor gets more than half of the blocks that the longest would."""
    rng = random.Random(11)
    parts = [[f"q{k}_{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 120))] for k in range(8)]
    texts = []
    for i in range(60):
        k, m = rng.randrange(8), rng.randrange(1, 6)
        texts.append([w for j in range(m) for w in parts[(k + j) % 8]] + [f"o{i}_{j}" for j in range(rng.randrange(30))])
        if rng.random() < 0.3:
            texts[-1] = texts[-1] + parts[rng.randrange(8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run_dedup(docs, rows, 20, 5) == brute_dedup(rows, 20)
    got = {r["doc_id"]: len(r["factors"]) for r in rlz_dedup.dedup(docs(rows), 20, 5).collect()}
    want = {i: greedy(dict(enumerate(texts)), i, 20) for i in got}
    assert all(got[i] >= want[i] for i in got)
    assert sum(got.values()) <= 1.75 * sum(want.values())


def test_runs_that_repeat_a_word(docs):
    """One word repeated: each window is a block, runs are as many as the levels, and a start keeps its longest."""
    rows = [(1, "z " * 700), (2, "z " * 600), (3, "z " * 5000)]
    assert run_dedup(docs, rows, 50, 12) == brute_dedup(rows, 50)
    found = {r["doc_id"]: len(r["factors"]) for r in rlz_dedup.dedup(docs(rows), 50, 12).collect()}
    assert found[2] <= 2 and found[3] <= 10


def test_passage_in_most_documents(docs):
    """One notice in nine of ten documents, between words of their own: a few factors cover it, and nothing else."""
    rng = random.Random(9)
    notice = [f"n{i}" for i in range(60)]
    rows, at = [], {}
    for i in range(300):
        own = [[f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 40))] for _ in range(2)]
        at[i] = len(own[0])
        rows.append((i, " ".join(own[0] + (notice if i % 10 != 9 else []) + own[1])))
    assert run_dedup(docs, rows, 50, 12) == brute_dedup(rows, 50)
    for r in rlz_dedup.dedup(docs(rows), 50, 12).collect():
        want = [(at[r["doc_id"]], at[r["doc_id"]] + 60)] if r["doc_id"] % 10 != 9 and r["doc_id"] else []
        assert rlz_dedup.covered([tuple(f) for f in r["factors"]]) == want and len(r["factors"]) <= 3


def brute_classes(rows, n, percent):
    sets = []
    for d, t in rows:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def near_texts(seed, groups, size):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(4, 80))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
            text = " ".join(w)
            out.append((i, text.upper() if rng.random() < 0.2 else text))
            i += 1
    return out


def run_classes(docs, rows, n, percent):
    got = jaccard_join.classes(docs(rows), n, percent, cells=1 << 10).collect()
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str)


def test_join_matches_brute_force(docs):
    for seed, n, percent in ((1, 4, 85), (2, 2, 70)):
        rows = near_texts(seed, 12, 14)
        assert run_classes(docs, rows, n, percent) == brute_classes(rows, n, percent)


def test_join_edges(docs):
    rows = [(4, "a b"), (2, "A B"), (2, "A B"), (7, "a b c"), (None, "a b"), (9, None), (8, ""), (6, " "), (3, "x " * 500), (5, "x " * 700), (None, "only here it is"), (1, "İ ẞ"), (0, "i̇ ß")]
    assert run_classes(docs, rows, 4, 85) == brute_classes(rows, 4, 85)
    assert run_classes(docs, [], 4, 85) == []


def test_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (5, None), (6, ""), (7, "other words here")]
    kept = jaccard_join.keep_one(docs(rows), 5, 80)
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 5, 6, 7]
    assert kept.columns == docs(rows).columns


def test_keep_one_by_class(docs):
    """A class keeps one document whatever its rows' doc_ids: null, shared by two classes, or both."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, a + " more"), (None, b), (None, c), (4, c), (7, d), (7, "quite another text here"), (7, "quite another text here"), (8, d + " more")]
    wordless = [(None, None), (None, None), (None, ""), (None, " \t\n\v\f\r"), (9, None), (9, ""), (9, ""), (9, "\n")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs(rows + wordless), 5, 80).collect()]
    assert sorted(((i, t) for i, t in kept if (t or "").strip()), key=str) in (
        sorted([(None, x), (None, b), (4, c), (7, d), (7, "quite another text here")], key=str) for x in (a, a + " more")
    )
    assert sorted((x for x in kept if not (x[1] or "").strip()), key=str) == sorted([(None, None), (None, None), (None, ""), (None, " \t\n\v\f\r"), (9, None), (9, ""), (9, "\n")], key=str)
    assert jaccard_join.keep_one(docs([]), 5, 80).count() == 0


def test_suffix_filter_never_rejects_a_link():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        common = len(np.intersect1d(x, y))
        assert jaccard_join.overlap_bound(x, y) >= common
        assert jaccard_join.linked(x, y, 60) == (100 * common >= 60 * (len(x) + len(y) - common))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components.components(links.limit(0)).count() == 0


def test_template_pages_make_no_pairs(docs, monkeypatch):
    """Pages that share most of their text, but not enough to link, meet nowhere; those that link do."""
    from cpgloom.llm.common import materialize

    rng = random.Random(4)
    shared = [f"t{i}" for i in range(263)]
    page = lambda own: " ".join(shared[:100] + [f"o{rng.randrange(10**9)}" for _ in range(own)] + shared[100:])
    sizes = []

    def noted(df, name):
        out = materialize(df, name)
        if name == "join-pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    rows = [(i, page(35)) for i in range(300)]
    assert len({r[2] for r in run_classes(docs, rows, 4, 85)}) == 300 and sum(sizes) <= 300  # of 44,850; the few come from shared cells
    sizes.clear()
    rows = [(i, page(rng.randrange(0, 60))) for i in range(120)]
    assert run_classes(docs, rows, 4, 85) == brute_classes(rows, 4, 85)


def test_join_of_very_long_texts(docs):
    rng = random.Random(5)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    other = long[:57_000] + [f"v{i}" for i in range(3_000)]
    rows = [(3, " ".join(long)), (2, " ".join(other)), (1, " ".join(long[:40_000]))]
    assert run_classes(docs, rows, 4, 85) == brute_classes(rows, 4, 85)
