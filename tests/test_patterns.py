"""Pattern mining rules and unit packing on hand-made inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cpgloom.operators import patterns as P
from cpgloom.operators import units as U


def mined(spark, digits):
    """Patterns of CpGs given as strings of 0, 1 and . for ambiguous."""
    ns = len(digits[0])
    rows = [(s, i, 1 if c == "1" else 0, 1 if c == "0" else 0) for i, d in enumerate(digits) for s, c in enumerate(d) if c != "."]
    obs = spark.createDataFrame(rows, "sample_id int, cpg_idx long, m long, u long")
    out = P.mine(obs, spark.range(len(digits)).withColumnRenamed("id", "cpg_idx"), ns)
    return [r["pattern"] for r in out.orderBy("cpg_idx").collect()]


def test_fill_and_background(spark):
    assert mined(spark, ["0101", "000.", "111.", "001.", "...."]) == ["0101", "0000", "1111", "2222", "2222"]
    assert mined(spark, ["0" * 11 + "1."]) == ["0" * 11 + "10"]


def test_equal_counts_are_ambiguous(spark):
    obs = spark.createDataFrame([(0, 0, 3, 3), (1, 0, 5, 0)], "sample_id int, cpg_idx long, m long, u long")
    site = P.ambiguity(P.site_calls(obs, spark.range(1).withColumnRenamed("id", "cpg_idx"), 2), 2).first()
    assert (site["n1"], site["n0"], site["namb"], site["sweeping"], site["is_pna"]) == (1, 0, 1, True, False)


def layout(spark):
    # The golden patterns and their order.
    p0, p1, small, pna = "0" * 35, "1" * 35, "0" * 34 + "1", "2" * 35
    order = [pna, p0, small, p1, pna, p0, pna, small, p1, pna, p0, pna]
    cpgs = spark.createDataFrame(list(enumerate(order)), "cpg_idx long, pattern string")
    return cpgs, P.pattern_rank(cpgs, 35), (p0, small, p1)


def test_rank_and_units(spark):
    cpgs, ranked, (p0, small, p1) = layout(spark)
    assert [r["pattern"] for r in ranked.orderBy("rank").collect()] == [p0, small, p1]
    members = P.membership(cpgs, ranked)
    real = U.membership_units(ranked, 4)
    units = real.drop("first_rank").unionByName(U.pna_units(5, real, 4)).orderBy("unit").collect()
    assert [r["cpg_count"] for r in units] == [3, 4, 4, 1]
    assert [r["membership_count"] for r in units] == [1, 2, 4, 1] and not any(r["oversized"] for r in units)
    big = U.membership_units(ranked, 2).orderBy("unit").collect()
    assert [(r["cpg_count"], r["class"], r["oversized"], r["first_rank"]) for r in big] == [(3, "pure", True, 0), (2, "pure", False, 1), (2, "pure", False, 2)]
    assert {r["class"]: r["oversized"] for r in U.stats(U.membership_units(ranked, 2)).collect()} == {"pure": 1}
    assert [r["class"] for r in units] == ["pure", "mixed", "PNA", "PNA"]
    assert [r["output_offset"] for r in units] == [0, 3, 7, 11]
    placed = U.scatter(members, ranked, real, 4).orderBy("dest").collect()
    assert [r["dest"] for r in placed] == list(range(12))
    assert [r["cpg_idx"] for r in placed][-5:] == [0, 4, 6, 9, 11]
    assert [r["unit"] for r in placed] == [0] * 3 + [1] * 4 + [2] * 4 + [3]


def brute_pack(counts, target):
    """(first rank, memberships, CpGs) of next-fit units, one membership at a time."""
    out, own = [], []
    for i, n in enumerate(counts):
        if own and (sum(counts[k] for k in own) + n > target or counts[own[-1]] > target):
            out.append(own)
            own = []
        own.append(i)
    return [(o[0], len(o), sum(counts[k] for k in o)) for o in [*out, own] if o]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 40))
def test_packing(counts, target):
    counts = sorted(counts, reverse=True)
    runs = [(n, counts.count(n)) for n in sorted(set(counts), reverse=True)]
    got = [(first + i * members, members, n) for first, members, n, alike in U.pack_runs(runs, target) for i in range(alike)]
    assert got == brute_pack(counts, target)


def test_mining_options(spark):
    obs = spark.createDataFrame([(0, 0, 3, 2), (1, 0, 1, 0)], "sample_id int, cpg_idx long, m long, u long")
    cpgs = spark.range(1).withColumnRenamed("id", "cpg_idx")
    assert [P.mine(obs, cpgs, 2, **o).first()["pattern"] for o in ({}, {"threshold": 0.7}, {"mincov": 2})] == ["11", "01", "11"]


def test_no_background_units(spark):
    _, ranked, _ = layout(spark)
    assert U.pna_units(0, U.membership_units(ranked, 4), 4).count() == 0


def test_mask_and_groups(spark):
    members = spark.createDataFrame([(0, 0), (1, 5), (2, None)], "cpg_idx long, rank int")
    assert [r["state"] for r in P.mask(members, 2).orderBy("cpg_idx").collect()] == ["P1", "Pna", "Pna"]
    states = spark.createDataFrame([(0, "P3"), (1, "p4"), (2, "P12"), (3, "Xx"), (4, None)], "cpg_idx long, state string")
    assert [r["group"] for r in P.group_map(states, 5).orderBy("cpg_idx").collect()] == [3, 4, 0, 0, 0]


@pytest.mark.parametrize("top", [1, 3])
def test_summary_of_nothing_but_background(spark, top):
    cpgs = spark.createDataFrame([(i, "22") for i in range(top)], "cpg_idx long, pattern string")
    got = {r["key"]: r["value"] for r in P.summary(cpgs, 2).collect()}
    assert got["n_patterns"] == 0 and got["n_pna"] == top and got["pna_percent"] == 100
