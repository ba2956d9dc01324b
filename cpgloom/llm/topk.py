"""Exact top-k search by columnar branch and bound.

Vectors are packed into blocks in vertical layout: one row of a block's matrix
is one dimension. Vectors are dealt to the blocks by their norm, so a block's
largest norm bounds all scores in it. First, all queries meet the SEEDS vectors
of largest norm, a set of bounded size; each query's k-th best score among them
is a bound that its results must reach. Then blocks of queries meet blocks of
vectors by an equi-join on a block number, a bounded pair at a time, unless no
query of the block can reach its bound with the other block's largest norm. In a
pair, the queries' scores are accumulated a few dimensions at a time; after each
step a candidate's score can grow by no more than the product of the norms of
what is left of query and vector, and candidates that cannot reach the query's
bound any more are dropped from the columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, queries in a block, dimensions in a step.
BLOCK, QUERIES, STEP = 4096, 256, 16
#: Vectors of largest norm that set the queries' first bounds.
SEEDS = 1024
#: Products of this size and below are summed exactly in float64.
EXACT = float(1 << 52)
#: Bytes of a score's sort key: scores of any finite float64 components fit.
KEY_BYTES = 272

_PACKED = "block long, n int, dims int, top double, ids binary, values binary"
_FOUND = "query_id long, vec_id long, score long, key binary"


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows whose vector has no null and no non-finite component: the components as they are.

    They count as floor(SCALE * x) in all scores; a component of 2**52 or more is an integer, so no digit is lost.
    """
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


SCALE = 256


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[float]] = []

        def flush() -> pa.RecordBatch:
            dims = max(map(len, vectors), default=0)
            grid = np.zeros((dims, len(ids)))
            for i, v in enumerate(vectors):
                grid[: len(v), i] = v
            with np.errstate(over="ignore"):
                top = float(norms(np.floor(grid * SCALE))[0].max(initial=0.0))
            row = [pa.array([min(ids)], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), pa.array([top]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([grid.tobytes()], pa.binary())]
            ids.clear()
            vectors.clear()
            return pa.RecordBatch.from_arrays(row, names=["block", "n", "dims", "top", "ids", "values"])

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(i)
                    vectors.append(v)
                    if len(ids) == size:
                        yield flush()
        if ids:
            yield flush()

    return pack


def norms(grid: np.ndarray) -> np.ndarray:
    """Row d: the norm of each column's components from d on; a little too large, so that bounds hold in spite of rounding."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.concatenate(((grid[::-1] ** 2).cumsum(0)[::-1], np.zeros((1, grid.shape[1]))))) * (1 + 1e-9)


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python integers."""
    return np.array([[int(c) * SCALE if abs(c) >= 2.0**52 else math.floor(c * SCALE) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def search_block(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int, step: int = STEP, bounds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in a block; columns are vectors, rows dimensions.

    ``bounds``: scores that each query's results must reach (-inf for none).
    A pair for which float64 isn't exact has a sum of Python integers as its score.
    """
    dims = max(len(queries), len(values))
    q, v = np.zeros((dims, queries.shape[1])), np.zeros((dims, values.shape[1]))
    q[: len(queries)], v[: len(values)] = queries, values
    with np.errstate(over="ignore", invalid="ignore"):
        whole_q, whole_v = q, v
        q, v = np.floor(q * SCALE), np.floor(v * SCALE)
        top_q, top_v = (np.abs(x).max(axis=0, initial=0) for x in (q, v))
        rest_q, rest_v = norms(q), norms(v)
        finite_q, finite_v = (np.isfinite(x[0]) for x in (rest_q, rest_v))
        # vectors that are too large for one of the queries; only these become Python integers
        large = ~(top_q.max(initial=0) * top_v * max(dims, 1) < EXACT) | ~finite_v | ~finite_q.all()
    integers = _integers(whole_v[:, large])
    out = []
    for j, own in enumerate(query_ids.tolist()):
        least = -np.inf if bounds is None else bounds[j]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (top_q[j] * top_v * max(dims, 1) < EXACT) & finite_v & finite_q[j]
            alive = np.flatnonzero(exact & (ids != own) & (rest_q[0, j] * rest_v[0] + 1e-6 >= least))
        others: list[tuple[int, int]] = []
        if not exact.all():
            sums = (_integers(whole_q[:, j : j + 1]) * integers).sum(0) if dims else np.zeros(int(large.sum()), dtype=object)
            others = [(-s, c) for s, c, e in zip(sums, ids[large].tolist(), exact[large]) if c != own and not e]
        score = np.zeros(len(alive))
        for d in range(0, dims, step):
            if not len(alive):
                break
            score = score + q[d : d + step, j] @ v[d : d + step, alive]
            left = rest_q[min(d + step, dims), j] * rest_v[min(d + step, dims), alive]
            if len(score) > k:
                # the k-th largest of the least that the candidates will reach is a bound too
                least = max(least, np.partition(score - left, len(score) - k)[len(score) - k] - 1e-6)
            # the bound is a float: a little is added for its rounding
            keep = score + left + 1e-6 >= least
            alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(own, c, -s) for s, c in sorted(others + [(-int(score[b]), int(ids[alive[b]])) for b in best])[:k]]
    return out


def sort_key(score: int) -> bytes:
    """Bytes in the order of the scores."""
    return (score + (1 << (8 * KEY_BYTES - 1))).to_bytes(KEY_BYTES, "big")


def _unpacked(r: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r[prefix + "values"]).reshape(r[prefix + "dims"], r[prefix + "n"]), np.frombuffer(r[prefix + "ids"], np.int64)


def _bounded(k: int):
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with each query's k-th best score among the seeds, and the least norm that a useful vector has."""
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                (queries, query_ids), (values, ids) = _unpacked(r, "q_"), _unpacked(r)
                bounds = np.full(len(query_ids), -np.inf)
                found: dict[int, list[int]] = {}
                for own, _, score in search_block(queries, query_ids, values, ids, k):
                    found.setdefault(own, []).append(score)
                with np.errstate(over="ignore", invalid="ignore"):
                    size = norms(np.floor(queries * SCALE))[0]
                    for j, own in enumerate(query_ids.tolist()):
                        if len(found.get(own, ())) == k:
                            least = found[own][-1]
                            bounds[j] = least - 1e-6 if abs(least) < EXACT else -np.inf
                    need = np.where(np.isfinite(bounds) & (bounds > 0) & np.isfinite(size) & (size > 0), bounds / np.maximum(size, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in range(4)] + [pa.array([bounds.tobytes()], pa.binary()), pa.array([float(need.min(initial=np.inf)) * (1 - 1e-9)])], names=["q_n", "q_dims", "q_ids", "q_values", "q_bounds", "q_need"])

    return bounded


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = search_block(*_unpacked(r, "q_"), *_unpacked(r), k, bounds=np.frombuffer(r["q_bounds"]))
                columns = [pa.array([f[c] for f in found], pa.int64()) for c in range(2)]
                columns += [pa.array([s if -(2**63) <= s < 2**63 else None for _, _, s in found], pa.int64()), pa.array([sort_key(s) for _, _, s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "key"])

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k highest integer inner products: (query_id, rank, vec_id, score).

    Both arguments are (id long, v array<double>), as ``quantised`` makes them; a
    query is not its own candidate (same id). Ties go to the smaller vec_id; with
    fewer candidates all come; shorter vectors are padded with zeros; of repeated
    ids every row is a candidate, and repeated query rows count once. Empty
    inputs give no rows. Scores are exact at any size; one that does not fit in a
    long is null, in its right rank.
    """
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sized = vectors.select("id", "v", norm.alias("norm"))
    packed = sized.repartitionByRange(parts, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc(), "id").select("id", "v").mapInArrow(_pack(BLOCK), _PACKED)
    # SEEDS rows, whatever the input
    seeds = sized.orderBy(F.col("norm").desc(), "id").limit(SEEDS).select("id", "v").coalesce(1).mapInArrow(_pack(SEEDS), _PACKED)
    asked = queries.dropDuplicates(["id"]).mapInArrow(_pack(QUERIES), _PACKED)
    asked = asked.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("_part"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "values")])
    spread = seeds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.join(spread.hint("shuffle_merge"), "_part").select("q_n", "q_dims", "q_ids", "q_values", "n", "dims", "ids", "values")
    asked = asked.mapInArrow(_bounded(k), "q_n int, q_dims int, q_ids binary, q_values binary, q_bounds binary, q_need double")
    # every block of queries goes to every part of the vectors' blocks; the parts are as many as tasks
    left = packed.withColumn("_part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    right = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = left.join(right.hint("shuffle_merge"), (left["_part"] == right["_part"]) & (F.col("top") >= F.col("q_need"))).drop("_part", "block", "top", "q_need")
    found = pairs.mapInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("key").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
