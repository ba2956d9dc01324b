"""SQL of the operators' rows for DuckDB, where SQL can express them on whole tables."""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN least USING (h) WHERE first < doc_id),
kept AS (SELECT doc_id, array_to_string(list(x ORDER BY i), ' ') AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3 = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sizes GROUP BY source)),
shares AS (SELECT *, source_size / weight AS ratio,
  (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
  FROM totals WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT *, CASE WHEN level IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), weight * level) END AS target FROM (
  SELECT *, (SELECT share FROM shares WHERE 3 * source_size >= share * weight ORDER BY ratio, source NULLS LAST LIMIT 1) AS level FROM shares)),
seats AS (SELECT *, CAST(round(sum(target) OVER () / 16) AS BIGINT) AS seats, sum(target) OVER () AS whole, count(*) OVER () AS n, 3 * CAST(ceil(source_size / 16) AS BIGINT) AS most FROM aims),
bounds AS (SELECT *, CAST(greatest(0, floor(target * seats / whole - target * seats / whole * n / (2 * seats) - 1)) AS BIGINT) AS low, CAST(ceil(target * seats / whole + target * seats / whole * n / (2 * seats) + 1) AS BIGINT) AS high FROM seats),
ranked AS (SELECT source, low, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, source NULLS LAST, s) AS rank, free FROM (
  SELECT *, unnest(range(low, high)) AS s FROM (SELECT *, seats - sum(low) OVER () AS free FROM bounds))),
quotas AS (SELECT b.source, b.source_size, b.target, b.docs, least(b.low + coalesce(r.won, 0), b.most) AS quota FROM bounds b LEFT JOIN (
  SELECT source, count(*) FILTER (rank <= free) AS won FROM ranked GROUP BY source) r ON r.source IS NOT DISTINCT FROM b.source),
dealt AS (SELECT s.doc_id, s.source, s.size, q.source_size, q.target, q.quota, md5(concat_ws('|', '17', coalesce(CAST(s.doc_id AS VARCHAR), ''), s.size)) AS key, CAST(ceil(q.docs / 256) AS BIGINT) AS shards
  FROM sizes s JOIN quotas q ON q.source IS NOT DISTINCT FROM s.source),
placed AS (SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM dealt),
shardwords AS (SELECT source, shard, shard % any_value(CAST(ceil(shards / 4096) AS BIGINT)) AS grp, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS quota, CAST(ceil(sum(size) / 16) AS BIGINT) AS blocks FROM placed GROUP BY source, shard),
groupwords AS (SELECT source, grp, CAST(sum(words) AS BIGINT) AS words, any_value(quota) AS seats, CAST(3 * sum(blocks) AS BIGINT) AS most FROM shardwords GROUP BY source, grp),
gbounds AS (SELECT *, CAST(coalesce(greatest(0, floor(x - coalesce(x * n / nullif(2 * seats, 0), 0) - 1)), 0) AS BIGINT) AS low, CAST(coalesce(ceil(x + coalesce(x * n / nullif(2 * seats, 0), 0) + 1), 0) AS BIGINT) AS high FROM (
  SELECT *, words * seats / nullif(CAST(sum(words) OVER (PARTITION BY source) AS DOUBLE), 0) AS x, count(*) OVER (PARTITION BY source) AS n FROM groupwords)),
granked AS (SELECT source, grp, free, row_number() OVER (PARTITION BY source ORDER BY words / (2 * s + 1) DESC, grp, s) AS rank FROM (
  SELECT *, unnest(range(low, high)) AS s FROM (SELECT *, seats - sum(low) OVER (PARTITION BY source) AS free FROM gbounds))),
gquotas AS (SELECT b.source, b.grp, least(b.low + coalesce(r.won, 0), b.most) AS seats FROM gbounds b LEFT JOIN (
  SELECT source, grp, count(*) FILTER (rank <= free) AS won FROM granked GROUP BY ALL) r ON r.source IS NOT DISTINCT FROM b.source AND r.grp = b.grp),
shardsizes AS (SELECT w.source, w.grp, w.shard, w.words, w.blocks, g.seats FROM shardwords w JOIN gquotas g ON g.source IS NOT DISTINCT FROM w.source AND g.grp = w.grp),
sbounds AS (SELECT *, CAST(coalesce(greatest(0, floor(x - coalesce(x * n / nullif(2 * seats, 0), 0) - 1)), 0) AS BIGINT) AS low, CAST(coalesce(ceil(x + coalesce(x * n / nullif(2 * seats, 0), 0) + 1), 0) AS BIGINT) AS high FROM (
  SELECT *, words * seats / nullif(CAST(sum(words) OVER (PARTITION BY source, grp) AS DOUBLE), 0) AS x, count(*) OVER (PARTITION BY source, grp) AS n FROM shardsizes)),
sranked AS (SELECT source, shard, free, row_number() OVER (PARTITION BY source, grp ORDER BY words / (2 * s + 1) DESC, shard, s) AS rank FROM (
  SELECT *, unnest(range(low, high)) AS s FROM (SELECT *, seats - sum(low) OVER (PARTITION BY source, grp) AS free FROM sbounds))),
squotas AS (SELECT b.source, b.shard, b.words, b.blocks, least(b.low + coalesce(r.won, 0), 3 * b.blocks) AS quota FROM sbounds b LEFT JOIN (
  SELECT source, shard, count(*) FILTER (rank <= free) AS won FROM sranked GROUP BY ALL) r ON r.source IS NOT DISTINCT FROM b.source AND r.shard = b.shard),
stream AS (SELECT p.*, q.words, q.blocks, q.quota AS shard_quota,
  CAST(coalesce(sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.key, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM placed p JOIN squotas q ON q.source IS NOT DISTINCT FROM p.source AND q.shard = p.shard),
picks AS (SELECT *, CASE WHEN blocks > 0 THEN shard_quota // blocks ELSE 0 END AS full_times, CASE WHEN blocks > 0 THEN shard_quota % blocks ELSE 0 END AS extra,
  CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5(concat_ws('|', '17', 'start', coalesce(source, ''), shard)), 1, 8) AS BIGINT) % blocks ELSE 0 END AS first FROM stream)
SELECT doc_id, size, source_size, target, source, CAST(full_times * size
  + greatest(0, least(least((first + extra) * 16, words), begun + size) - greatest(first * 16, begun))
  + greatest(0, least(greatest(first + extra - blocks, 0) * 16, begun + size) - greatest(0, begun)) AS BIGINT) AS taken
FROM picks
"""

OP5 = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM t q JOIN t c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS p) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 85 * (m.n + o.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP11 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
held AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT doc_id, line, i, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""

# crc32 by its definition: a table of 256 remainders made bit by bit, applied to a word's bytes one after another
OP12 = r"""
WITH remainders AS (SELECT list(r ORDER BY b) AS t FROM (
  SELECT b, list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b) AS r FROM range(256) x(b))),
words AS (SELECT 0 AS corpus, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(1, length(hex(encode(w))), 2), lambda i: CAST('0x' || substr(hex(encode(w)), i, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), remainders),
counts AS (SELECT corpus, doc_id, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
sums AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (corpus = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (corpus = 1), 0) AS DOUBLE) AS t FROM counts GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS weight FROM counts JOIN gains USING (bucket) WHERE corpus = 0 GROUP BY doc_id),
scores AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents d LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scores s LEFT JOIN able USING (doc_id)
"""


def _op13(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Assignments and means, one pair of steps after another."""
    steps = [f"""x AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, 1 + p * len(v) // {parts}, (p + 1) * len(v) // {parts}) AS y FROM (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0), range({parts}) r(p))""",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c FROM x WHERE vec_id IN (SELECT vec_id FROM x WHERE p = 0 ORDER BY vec_id LIMIT {entries}))"]
    for k in range(rounds + 1):
        gap = "CAST(list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, p, y, min(struct_pack(g := {gap}, e := e)) AS best FROM x JOIN b{k} USING (p) GROUP BY ALL)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, list(mean ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(t) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean FROM (SELECT p, best.e AS e, unnest(y) AS t, generate_subscripts(y, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))")
    steps.append(f"codes AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.g) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM codes"


OP13 = _op13()

ORACLES = {"op1_substring_dedup": OP1, "op3_mixing": OP3, "op5_topk": OP5, "op7_ngram_join": OP7, "op11_line_dedup": OP11, "op12_resampling": OP12, "op13_vector_codes": OP13}
