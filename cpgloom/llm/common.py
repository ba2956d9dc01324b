"""Helpers that the operators share: the shared folder, and word arithmetic on Arrow text.

A word is a maximal run of characters other than space and U+0009..U+000D.
Those separators are single ASCII bytes, so words are found on the UTF-8 bytes
of a whole Arrow batch at once, without decoding.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that the array kernels take at once; a longer document goes alone.
SLICE_BYTES = 1 << 18

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local default only on a local master, where they are one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends; what is kept of it is what it wrote."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more, since all that was made of them is written too."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (published splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    full = offsets[1:] > offsets[:-1]
    after[offsets[1:][full] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    at = np.arange(int(lengths.sum()), dtype=np.int64)
    picked = data[at + inside].astype(np.uint64) + np.uint64(1)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    picked *= powers(_BASE, longest)[at - np.repeat(firsts, lengths)]
    return mix64(np.add.reduceat(picked, firsts) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none (length max(0, len - n + 1))."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total, done, level, size, scale = np.uint64(0), 0, words, 1, int(_STEP)
    m, rest, weight = len(words) - n + 1, n, 1
    while rest:
        if rest & 1:
            total = total + level[done : done + m] * np.uint64(weight)
            done, weight = done + size, weight * scale % 2**64
        rest >>= 1
        if rest:
            level = level[:-size] + np.uint64(scale) * level[size:]
            size, scale = size * 2, scale * scale % 2**64
    return mix64(total + np.uint64(n))



#: Separators of plain words: all ASCII bytes but letters, digits and the underscore.
PLAIN = np.ones(256, dtype=bool)
PLAIN[128:] = False
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def meeting(taken: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether a span (start, end) meets any of ``taken``, by bisection in their union."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(taken):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def meets(s: int, e: int) -> bool:
        i = bisect_left(starts, e) - 1
        return i >= 0 and ends[i] > s

    return meets


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int) -> DataFrame:
    """(doc_id, text, label int): the texts of at most ``most`` labelled ids, chosen by a seeded hash.

    The chosen labels are bounded in number, so they are broadcast and only the
    sample's texts are shuffled. A label is 1 if it is above 0, else 0. Rows with
    a null id or label, or a null text, take no part; of repeated labels of an id
    the largest counts; of different texts of an id the one with the smallest
    hash; equal texts count once, with the largest label and the smallest id. So
    there are at most ``most`` rows.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), (F.col(label) > 0).cast("int").alias("label"))
    chosen = chosen.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("_id"), F.lit(seed)), "_id").limit(most)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    found = found.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("t"), F.max("label").alias("label"))
    return one.groupBy(F.col("t.key"), F.col("t.text").alias("text")).agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "text", "label")
