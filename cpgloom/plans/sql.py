"""SQL of the shared steps, for comparison in DuckDB: common table expressions by name, each using earlier ones."""

from __future__ import annotations

TOP, FOLD = 16, 10

_COUNTS = """SELECT {key} AS {name}, l_partkey AS cpg_idx,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS m,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS BIGINT) AS u
FROM lineitem GROUP BY 1, 2"""

STEPS: dict[str, str] = {
    "ref_obs": _COUNTS.format(key="CAST(l_linenumber - 1 AS INTEGER)", name="sample_id"),
    "query_obs": _COUNTS.format(key="l_suppkey", name="cell_id"),
    "celltype_obs": _COUNTS.format(key="CAST(l_linenumber % 3 AS BIGINT)", name="cell_type"),
    "cpgs": "SELECT DISTINCT l_partkey AS cpg_idx FROM lineitem",
    "ns": "SELECT max(l_linenumber) AS ns FROM lineitem",
    "called": """SELECT cpg_idx, sample_id,
  CASE WHEN m + u < 1 THEN NULL WHEN m * 2 > m + u THEN 1 WHEN m * 2 < m + u THEN 0 END AS digit FROM ref_obs""",
    "calls": """SELECT c.cpg_idx, CAST(s.i AS INTEGER) AS sample_id, CAST(d.digit AS INTEGER) AS digit
FROM cpgs c CROSS JOIN (SELECT unnest(range(ns)) AS i FROM ns) s
LEFT JOIN called d ON d.cpg_idx = c.cpg_idx AND d.sample_id = s.i""",
    "amb": """SELECT cpg_idx, n1, n0, namb, sweeping, (namb > 1.0 * ns) OR (namb > 0 AND NOT sweeping) AS is_pna FROM (
  SELECT cpg_idx, n1, n0, namb, ns, greatest(n1, n0) > 0 AND (least(n1, n0) = 0 OR greatest(n1, n0) >= 10 * least(n1, n0)) AS sweeping
  FROM (SELECT cpg_idx, count(*) FILTER (digit = 1) AS n1, count(*) FILTER (digit = 0) AS n0, count(*) FILTER (digit IS NULL) AS namb, count(*) AS ns FROM calls GROUP BY cpg_idx))""",
    "pat": """SELECT c.cpg_idx, CASE WHEN any_value(a.is_pna) THEN repeat('2', CAST(count(*) AS INTEGER))
  ELSE string_agg(CAST(coalesce(c.digit, CASE WHEN a.n1 > a.n0 THEN 1 ELSE 0 END) AS VARCHAR), '' ORDER BY c.sample_id) END AS pattern
FROM calls c JOIN amb a USING (cpg_idx) GROUP BY c.cpg_idx""",
    "ranked": """SELECT CAST(row_number() OVER (ORDER BY n DESC, pattern) - 1 AS INTEGER) AS rank, pattern, n
FROM (SELECT pattern, count(*) AS n FROM pat WHERE pattern <> (SELECT repeat('2', CAST(ns AS INTEGER)) FROM ns) GROUP BY pattern)""",
    "member": "SELECT cpg_idx, rank FROM pat LEFT JOIN ranked USING (pattern)",
    "mask": f"SELECT cpg_idx, CASE WHEN rank < {TOP} THEN 'P' || (rank + 1) ELSE 'Pna' END AS state FROM member",
    "states": f"SELECT CAST(i AS INTEGER) AS ord, CASE WHEN i < {TOP} THEN 'P' || (i + 1) ELSE 'Pna' END AS state FROM (SELECT unnest(range({TOP + 1})) AS i)",
    "feat": """SELECT g.cell_id, g.state AS pattern, g.ord, f.beta, coalesce(f.n_o, 0) AS n_o
FROM (SELECT DISTINCT q.cell_id, s.state, s.ord FROM query_obs q CROSS JOIN states s) g
LEFT JOIN (SELECT cell_id, state, avg(m / (m + u)) AS beta, count(*) AS n_o FROM query_obs JOIN mask USING (cpg_idx) WHERE m + u > 0 GROUP BY 1, 2) f USING (cell_id, state)""",
    "typefeat": """SELECT g.cell_type, g.state AS pattern, f.beta
FROM (SELECT DISTINCT q.cell_type, s.state FROM celltype_obs q CROSS JOIN states s) g
LEFT JOIN (SELECT cell_type, state, avg(m / (m + u)) AS beta FROM celltype_obs JOIN mask USING (cpg_idx) WHERE m + u > 0 GROUP BY 1, 2) f USING (cell_type, state)""",
    "sig": """SELECT cell_type, pattern, CASE WHEN x = 0 THEN 0.0 ELSE round(x * pow(10.0, 5 - floor(log10(abs(x))))) / pow(10.0, 5 - floor(log10(abs(x)))) END AS beta FROM (
  SELECT cell_type, pattern, coalesce(beta, mid) AS x FROM typefeat JOIN (
    SELECT pattern, count(beta) AS k, count(*) AS n, median(beta) AS mid FROM typefeat GROUP BY 1) USING (pattern)
  WHERE k > 0 AND 1 - k / n <= 0.3)""",
    "used": "SELECT DISTINCT pattern FROM sig WHERE pattern <> 'Pna' INTERSECT SELECT pattern FROM feat",
    "usable": "SELECT cell_id, pattern, beta FROM feat JOIN used USING (pattern) WHERE beta IS NOT NULL AND n_o >= 2",
    "labels2": "SELECT s_suppkey AS cell_id, n_name AS label, CAST(n_regionkey < 2 AS INTEGER) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "lmeans": """SELECT pattern, coalesce(avg(beta), 0) AS mean, coalesce(avg(beta) FILTER (y = 0), avg(beta), 0) AS mu0, coalesce(avg(beta) FILTER (y = 1), avg(beta), 0) AS mu1
FROM feat JOIN labels2 USING (cell_id) GROUP BY pattern""",
    "lscore": "SELECT f.cell_id, sum((l.mu1 - l.mu0) * coalesce(f.beta, l.mean)) AS s FROM feat f JOIN lmeans l USING (pattern) GROUP BY 1",
    "lcut": """SELECT -(c0 + c1) / 2 AS bias, CASE WHEN (c1 - c0) / 2 <= 1e-9 THEN 1.0 ELSE (c1 - c0) / 2 END AS scale
FROM (SELECT avg(s) FILTER (y = 0) AS c0, avg(s) FILTER (y = 1) AS c1 FROM lscore JOIN labels2 USING (cell_id))""",
    "ladder": "SELECT CAST(i AS INTEGER) AS rep, CAST([8, 24][i // 1 + 1] AS BIGINT) AS sample FROM (SELECT unnest(range(2)) AS i)",
    "sampled": """SELECT rep, cell_id, cpg_idx, b FROM (
  SELECT rep, cell_id, cpg_idx, m / (m + u) AS b, sample, row_number() OVER (PARTITION BY rep, cell_id ORDER BY md5(concat_ws('|', '1', rep, cell_id, cpg_idx)), cpg_idx) AS rn
  FROM query_obs CROSS JOIN ladder WHERE m + u > 0) WHERE rn <= sample""",
    "simfeat": """SELECT rep, cell_id, rank AS pattern, avg(b) AS beta,
  avg(CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '1', 'b', rep, cell_id, cpg_idx)), 1, 8) AS BIGINT) / 4294967296.0 < b THEN 1.0 ELSE 0.0 END) AS beta_binary, count(*) AS n
FROM sampled JOIN member USING (cpg_idx) WHERE rank < 8 GROUP BY 1, 2, 3""",
    "codes": "SELECT cell_id, cpg_idx, CAST(round(m / (m + u) * 65534) AS INTEGER) AS code FROM query_obs WHERE m + u > 0",
    "split": """SELECT cell_id, CASE WHEN rn <= floor(n * 70 / 100) THEN 'train' WHEN rn <= floor(n * 70 / 100) + floor(n * 15 / 100) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT cell_id, row_number() OVER (ORDER BY md5(concat_ws('|', '1', cell_id)), cell_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT cell_id FROM query_obs))""",
    "simgrid": """SELECT r.rep, r.cell_id, CAST(p.i AS INTEGER) AS pattern, f.beta, coalesce(f.n, 0) AS n
FROM (SELECT DISTINCT rep, cell_id FROM sampled) r CROSS JOIN (SELECT unnest(range(8)) AS i) p LEFT JOIN simfeat f ON f.rep = r.rep AND f.cell_id = r.cell_id AND f.pattern = p.i""",
    "pred": """SELECT q.cell_id, q.cpg_idx, q.y, k.state, avg(q.y) OVER (PARTITION BY q.cell_id, k.state) AS p, avg(q.y) OVER (PARTITION BY k.state) AS q
FROM (SELECT cell_id, cpg_idx, m / (m + u) AS y FROM query_obs WHERE m + u > 0) q JOIN mask k USING (cpg_idx)""",
    "units": """WITH RECURSIVE w AS (
  SELECT r.rank, r.n, CAST(0 AS BIGINT) AS unit, r.n AS held, r.n > 100 AS closed FROM ranked r WHERE r.rank = 0
  UNION ALL
  SELECT r.rank, r.n, CASE WHEN w.closed OR w.held + r.n > 100 THEN w.unit + 1 ELSE w.unit END,
    CASE WHEN w.closed OR w.held + r.n > 100 THEN r.n ELSE w.held + r.n END, r.n > 100
  FROM w JOIN ranked r ON r.rank = w.rank + 1)
SELECT CAST(unit AS INTEGER) AS unit, CAST(sum(sum(n)) OVER (ORDER BY unit) - sum(n) AS BIGINT) AS output_offset, CAST(sum(n) AS BIGINT) AS cpg_count, count(*) AS membership_count,
  CASE WHEN count(*) = 1 THEN 'pure' ELSE 'mixed' END AS class, bool_or(n > 100) AS oversized, min(rank) AS first_rank FROM w GROUP BY unit""",
    "pnaunits": """SELECT CAST(t.units + k.i AS INTEGER) AS unit, CAST(t.total + k.i * 100 AS BIGINT) AS output_offset, CAST(least(100, t.n_pna - k.i * 100) AS BIGINT) AS cpg_count, CAST(least(100, t.n_pna - k.i * 100) AS BIGINT) AS membership_count, 'PNA' AS class, false AS oversized
FROM (SELECT (SELECT count(*) FROM member WHERE rank IS NULL) AS n_pna, (SELECT max(unit) + 1 FROM units) AS units, (SELECT sum(cpg_count) FROM units) AS total) t,
  LATERAL (SELECT unnest(range(CAST(ceil(t.n_pna / 100) AS BIGINT))) AS i) k""",
    "allunits": "SELECT unit, output_offset, cpg_count, membership_count, class, oversized FROM units UNION ALL SELECT * FROM pnaunits",
}

NEEDS: dict[str, list[str]] = {
    "called": ["ref_obs"], "calls": ["cpgs", "ns", "called"], "amb": ["calls"], "pat": ["calls", "amb"], "ranked": ["pat", "ns"], "member": ["pat", "ranked"], "mask": ["member"],
    "feat": ["query_obs", "states", "mask"], "typefeat": ["celltype_obs", "states", "mask"], "sig": ["typefeat"], "used": ["sig", "feat"], "usable": ["feat", "used"],
    "lmeans": ["feat", "labels2"], "lscore": ["feat", "lmeans"], "lcut": ["lscore", "labels2"], "sampled": ["query_obs", "ladder"], "simfeat": ["sampled", "member"],
    "codes": ["query_obs"], "split": ["query_obs"], "simgrid": ["sampled", "simfeat"], "pred": ["query_obs", "mask"], "units": ["ranked"], "pnaunits": ["member", "units"], "allunits": ["units", "pnaunits"],
}


def sql(body: str, *steps: str) -> str:
    """``body`` after the named steps and all that they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for s in steps:
        visit(s)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in order) + "\n" + body
