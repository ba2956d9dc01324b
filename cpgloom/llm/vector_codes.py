"""Vector compression by product quantisation, in integers throughout.

A vector is cut into parts, and each part is replaced by the number of its
nearest entry in that part's codebook. A round broadcasts one kd-tree for each
codebook (entries and dimensions are options, so its size is bounded), assigns
every part by branch and bound, and adds up the parts of each entry in the task;
the tasks' sums are added up by a grouped sum, and only one row for each entry
comes to the driver. A search leaves a box of the tree out only if its bound is
above the best distance so far: boxes at the same distance are visited, so of
entries at one distance the smallest index is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries in a leaf of a tree.
LEAF = 8
#: Components from here on have no exact integer of sound size and count as not finite.
LIMIT = float(1 << 43)
#: Different labels up to which their sums are broadcast.
MOST_LABELS = 10_000

_FAR = 1 << 200


@dataclass
class Node:
    """A box around some entries: either two halves or a leaf's entries in the order of their indices."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    halves: tuple[Node, Node] | None = None


def tree(book: np.ndarray) -> Node:
    """A kd-tree of a codebook's entries (rows), cut at the median of the widest dimension."""
    def grow(ids: np.ndarray) -> Node:
        own = book[ids]
        low, high = own.min(0), own.max(0)
        if len(ids) <= LEAF or not book.shape[1] or (low == high).all():
            return Node(low, high, entries=np.sort(ids))
        order = ids[np.argsort(own[:, int(np.argmax(high - low))], kind="stable")]
        return Node(low, high, halves=(grow(order[: len(ids) // 2]), grow(order[len(ids) // 2 :])))

    return grow(np.arange(len(book)))


def _gap(x: np.ndarray, node: Node) -> np.ndarray:
    """Squared distance of each row to a node's box: no entry of it is nearer."""
    off = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return (off * off).sum(1)


def nearest(x: np.ndarray, book: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row of ``x``, the smallest index in ties."""
    big = (2 * max(int(np.abs(a).max(initial=0)) for a in (x, book)) + 1) ** 2 * max(x.shape[1], 1) >= 1 << 62
    if big:  # beyond what 64 bits hold: Python's integers
        x, book = x.astype(object), book.astype(object)
    best = np.full(len(x), _FAR if big else np.iinfo(np.int64).max, dtype=object if big else np.int64)
    index = np.full(len(x), len(book))

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.entries is not None:
            for a in range(0, len(rows), 4096):
                some = rows[a : a + 4096]
                off = x[some][:, None, :] - book[node.entries][None, :, :]
                gaps = (off * off).sum(2)
                at = gaps.argmin(1)  # the first of equal ones, so the smallest index of the leaf
                gap, found = gaps[np.arange(len(some)), at], node.entries[at]
                better = (gap < best[some]) | ((gap == best[some]) & (found < index[some]))
                best[some[better]], index[some[better]] = gap[better], found[better]
            return
        one, two = node.halves
        to_one, to_two = _gap(x[rows], one), _gap(x[rows], two)
        first = to_one <= to_two
        visit(one, rows[first & (to_one <= best[rows])])
        visit(two, rows[~first & (to_two <= best[rows])])
        now = best[rows]
        visit(two, rows[first & (to_two <= now)])
        visit(one, rows[~first & (to_one <= now)])

    visit(root, np.arange(len(x)))
    return index, best


def quantised(rows: DataFrame, key: str, vector: str, label: str | None = None, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v array<bigint>), written, of the rows whose vector is there and holds no null and no non-finite component.

    Shorter vectors are filled with zeros to the longest one's length, and all to a multiple of ``parts``.
    """
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    whole = F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))
    own = rows.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), whole.alias("v")).where(F.col("v").isNotNull())
    longest = own.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    dims = -(-longest // parts) * parts
    return materialize(own.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))), "codes-vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(books, parts: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, entry, n, s0, s1 ..): a task's parts of each entry, added up."""
        own = books.value
        total = [np.zeros(b.shape, object) for b, _ in own]
        count = [np.zeros(len(b), np.int64) for b, _ in own]
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            for p, y in enumerate(np.split(x, parts, axis=1)):
                index, _ = nearest(y, *own[p])
                count[p] += np.bincount(index, minlength=len(count[p]))
                # below 2**53 each: so many rows at a time can't leave 64 bits
                for a in range(0, len(y), 512):
                    some = np.zeros(own[p][0].shape, np.int64)
                    np.add.at(some, index[a : a + 512], y[a : a + 512])
                    total[p] += some
        used = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p]).tolist()]
        columns = [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used], pa.int64())]
        width = own[0][0].shape[1]
        columns += [pa.array([int(total[p][e][d]) for p, e in used], pa.decimal128(38, 0)) for d in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{d}" for d in range(width)]])

    return sums


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one matrix of ``entries`` or fewer rows for each part, of the rows of ``quantised``.

    They start as the parts of the ``entries`` smallest vec_ids (null last) and
    are replaced ``rounds`` times by the floored means of the parts assigned to them.
    """
    spark = vectors.sparkSession
    first = np.array([r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    if not len(first):
        return []
    books = [b.copy() for b in np.split(first, parts, axis=1)]
    width = books[0].shape[1]
    schema = "part int, entry int, n long" + "".join(f", s{d} decimal(38,0)" for d in range(width))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([(b, tree(b)) for b in books])
        found = vectors.select("v").mapInArrow(_sums(sent, parts), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(width)])
        # at most parts x entries rows
        for r in found.collect():
            books[r["part"]][r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
        sent.unpersist()
    return books


def _coded(books, parts: int):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for batch in batches:
            x = _matrix(batch.column(2))
            if not len(x):
                continue
            found = [nearest(y, *own[p]) for p, y in enumerate(np.split(x, parts, axis=1))]
            error = sum(gap.astype(object) for _, gap in found)
            code = ["".join(f"{c:02x}" for c in row) for row in zip(*(index.tolist() for index, _ in found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array([int(e) for e in error], pa.decimal128(38, 0))], names=["vec_id", "label", "code", "error"])

    return coded


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def assign(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error decimal): every vector's code by the given codebooks."""
    kind = vectors.schema["label"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast([(b, tree(b)) for b in books])
    return vectors.select("vec_id", "label", "v").mapInArrow(_coded(sent, len(books)), f"vec_id long, label {kind}, code string, error decimal(38,0)")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that takes part.

    Components count as floor(SCALE * x). ``code`` has two hex digits for each
    part, ``error`` is the squared distance to the code's entries, ``label_error``
    the sum of errors of equal labels (nulls together). Vectors that are null or
    hold a null, a non-finite component or one of LIMIT or more take no part;
    lengths that differ are filled with zeros. Null and repeated ids are vectors
    like any other (null ids come last in the start), fewer vectors than
    ``entries`` make a smaller codebook, and an empty table gives an empty table.
    Sums that don't fit a long are null. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = quantised(rows, key, vector, label, parts)
    books = train(vectors, parts, entries, rounds)
    done = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error")).limit(0) if not books else assign(vectors, books)
    done = materialize(done, "codes-done")
    sums = materialize(done.groupBy("label").agg(F.try_sum("error").alias("label_error")), "codes-labels")
    of = sums.select(F.col("label").alias("_label"), "label_error")
    # few labels are sent to all tasks; many meet their rows by a shuffle, in which Spark can split a label
    of = F.broadcast(of) if sums.count() <= MOST_LABELS else of.hint("shuffle_merge")
    out = done.join(of, F.col("label").eqNullSafe(F.col("_label")))
    discard(vectors)
    return out.select("vec_id", "label", "code", *[F.col(c).try_cast("bigint").alias(c) for c in ("error", "label_error")], F.lit(digest(books)).alias("codebooks_sha256"))
