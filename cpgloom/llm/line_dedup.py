"""Line dedup through a sharded minimal perfect hash.

Index. Each line's key (stripped, A-Z lower-cased) is hashed to 128 bits, and
occurrences are summed up for each key, first in the batch and then by a grouped
sum. Keys found in one document only can never be dropped and go here. The
others are dealt to shards of bounded size, and each shard becomes one row: a
minimal perfect hash (published cascade of bit arrays: a key stays at the first
level where no other key has its bit; its slot is the rank of that bit) and, by
slot, a 64-bit fingerprint, the number of documents, and the largest doc_id.

Probe. Documents send the hashes of their lines to the shards, a few numbers a
line, and meet the arrays there, one shard in memory at a time; lines are never
joined with lines. Only line numbers to drop come back to the documents. Lines
with more than one in HOT of all occurrences are fewer than HOT by counting;
their verdicts go to every task, so no shard gets a large part of the probes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import discard, materialize, mix64, text_or_empty

#: Code points that a key must have, and documents that must hold it.
LEAST, DOCS = 20, 3
#: Keys of a shard on average.
SHARD_KEYS = 1 << 16
#: A line is hot above one in HOT of all occurrences, if these are more than HOT_FLOOR.
HOT, HOT_FLOOR = 1 << 14, 1000

_BLANK = b" \t\n\x0b\x0c\r"
_KNOWN = "hi long, lo long, n long, last long"
_SHARD = "shard int, n int, sizes array<int>, bits binary, prints binary, counts binary, last binary, known binary"


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The hash of a line's key; None if the key has fewer than ``least`` code points."""
    key = line.strip(_BLANK).lower()  # bytes.lower() changes A-Z alone
    if len(key) < least or not (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _numbers(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _counted(least: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of a batch's documents, each with its documents and their largest id."""
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for key in {line_key(x, least) for x in text.split(b"\n")}:
                    if key is not None:
                        had = found.setdefault(key, [0, None])
                        had[0] += 1
                        if doc is not None and (had[1] is None or doc > had[1]):
                            had[1] = doc
            if found:
                hi, lo = _numbers(list(found))
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["hi", "lo", "n", "last"])

    return counted


def place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key at a level of ``size`` bits."""
    a, b = (np.uint64(0x9E3779B97F4A7C15 * (2 * level + k) % 2**64) for k in (1, 2))
    return (mix64(mix64(hi ^ a) + (lo ^ b)) % np.uint64(size)).astype(np.int64)


def build(hi: np.ndarray, lo: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits in words of 64, slot of each key) of different keys (uint64 pairs)."""
    sizes: list[int] = []
    words: list[np.ndarray] = []
    bit_of = np.zeros(len(hi), np.int64)
    left, begun = np.arange(len(hi)), 0
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = place(hi[left], lo[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        fits = alone[at]
        bit_of[left[fits]] = begun + at[fits]
        left, begun = left[~fits], begun + size
        sizes.append(size)
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return sizes, bits, rank(bits, bit_of)


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each place."""
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
    inside = bits[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return before[at >> 6] + np.bitwise_count(inside)


def slots(sizes: list[int], bits: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that isn't in the index gets any slot, or -1."""
    out, left, begun = np.full(len(hi), -1), np.arange(len(hi)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = begun + place(hi[left], lo[left], level, size)
        here = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        out[left[here]] = rank(bits, at[here])
        left, begun = left[~here], begun + size
    return out


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard, from (shard, hi, lo, n, last) in the order of shards."""
    shard, parts = None, []

    def made() -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        hi, lo, n = (t.column(c).to_numpy() for c in ("hi", "lo", "n"))
        last = t.column("last").combine_chunks()
        sizes, bits, slot = build(hi.view(np.uint64), lo.view(np.uint64))
        columns = [np.empty(len(hi), kind) for kind in (np.uint64, np.uint32, np.int64, np.bool_)]
        for to, values in zip(columns, (hi.view(np.uint64), np.minimum(n, 2**32 - 1), last.fill_null(0).to_numpy(zero_copy_only=False), last.is_valid().to_numpy(zero_copy_only=False))):
            to[slot] = values
        row = [pa.array([shard], pa.int32()), pa.array([len(hi)], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), *[pa.array([x.tobytes()], pa.binary()) for x in (bits, *columns)]]
        return pa.RecordBatch.from_arrays(row, names=["shard", "n", "sizes", "bits", "prints", "counts", "last", "known"])

    for batch in batches:
        of = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if parts and of[a] != shard:
                yield made()
                parts = []
            shard = int(of[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield made()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, text as bytes): tkey tells rows of one doc_id apart by their texts."""
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.cast("binary").alias("text"))


def known_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(hi, lo, n, last), written: the keys found in two documents or more, their documents and the largest doc_id."""
    every = keyed(docs).mapInArrow(_counted(least), _KNOWN).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return materialize(every.where(F.col("n") > 1), "line-keys")


def index(known: DataFrame) -> tuple[DataFrame, int]:
    """The shards' arrays, written, one row for each shard that has keys; and the number of shards."""
    spark = known.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = max(8 * parts, -(-known.count() // SHARD_KEYS))
    dealt = known.select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "hi", "lo", "n", "last")
    return materialize(dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_arrays, _SHARD), "line-index"), shards


def _sent(shards: int, least: int, docs: int, hot):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A probe for each line with a key; lines whose verdict is known here come only if they go, without a hash."""
        verdicts = hot.value
        for batch in batches:
            rows: list[tuple] = []
            keys: list[bytes] = []
            for doc, tkey, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for i, line in enumerate(text.split(b"\n")):
                    key = line_key(line, least)
                    if key is None:
                        continue
                    if key in verdicts:
                        n, last = verdicts[key]
                        if n >= docs and last != doc:
                            rows.append((doc, tkey, i, True))
                            keys.append(key)
                    else:
                        rows.append((doc, tkey, i, False))
                        keys.append(key)
            if rows:
                hi, lo = _numbers(keys)
                doc, tkey, line, gone = zip(*rows)
                gone = np.array(gone)
                # a verdict needs no shard: it goes wherever a hash of its row says, so that copies of a text part
                own = [np.array([0 if x is None else x for x in v], np.int64).view(np.uint64) for v in (doc, tkey, line)]
                spread = mix64(mix64(own[0] + own[2]) + own[1]).view(np.int64)
                at = np.where(gone, spread, hi) % shards
                arrays = [pa.array(at.astype(np.int32)), pa.array(hi, mask=gone), pa.array(lo, mask=gone), pa.array(doc, pa.int64()), pa.array(tkey, pa.int64()), pa.array(line, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "hi", "lo", "doc_id", "tkey", "line"])

    return sent


def _probed(docs: int):
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, tkey, line) to drop, from the rows of arrays and probes in the order of shards, arrays first."""
        shard, own = None, None
        for batch in batches:
            of, arrays = batch.column("shard").to_numpy(), batch.column("n").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.unique(np.concatenate(([0, len(of)], np.flatnonzero(np.diff(of)) + 1, np.flatnonzero(arrays), np.flatnonzero(arrays) + 1)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if arrays[a]:
                    r = part.to_pylist()[0]
                    shard = r["shard"]
                    own = (r["sizes"], *(np.frombuffer(r[c], kind) for c, kind in (("bits", np.uint64), ("prints", np.uint64), ("counts", np.uint32), ("last", np.int64), ("known", np.bool_))))
                    continue
                told = part.column("hi").is_null().to_numpy(zero_copy_only=False)
                gone = told.copy()
                if of[a] == shard and own is not None:
                    sizes, bits, prints, counts, last, known = own
                    ask = np.flatnonzero(~told)
                    hi, lo = (part.column(c).fill_null(0).to_numpy()[ask] for c in ("hi", "lo"))
                    slot = slots(sizes, bits, hi.view(np.uint64), lo.view(np.uint64))
                    ask, hi, slot = ask[slot >= 0], hi[slot >= 0], slot[slot >= 0]
                    doc = part.column("doc_id")
                    there, doc = doc.is_valid().to_numpy(zero_copy_only=False)[ask], doc.fill_null(0).to_numpy()[ask]
                    final = (known[slot] == there) & (last[slot] == doc)
                    gone[ask] = (prints[slot] == hi.view(np.uint64)) & (counts[slot] >= docs) & ~final
                keep = pa.array(gone)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("doc_id", "tkey", "line")], names=["doc_id", "tkey", "line"])

    return probed


def dropped(docs: DataFrame, least: int = LEAST, least_docs: int = DOCS) -> DataFrame:
    """(doc_id, tkey, lines array<int>), written: the numbers of the lines that go, from 0, of each document that loses any."""
    spark = docs.sparkSession
    known = known_lines(docs, least)
    shards, n = index(known)
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    # fewer than HOT rows, since each has more than one in HOT of all occurrences
    hot = known.where((F.col("n") > HOT_FLOOR) & (F.col("n") > F.lit(total / HOT))).collect()
    verdicts = spark.sparkContext.broadcast({np.array([r["hi"], r["lo"]], np.int64).tobytes(): (r["n"], r["last"]) for r in hot})
    probes = keyed(docs).mapInArrow(_sent(n, least, least_docs, verdicts), "shard int, hi long, lo long, doc_id long, tkey long, line int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = shards.unionByName(probes, allowMissingColumns=True).repartition(parts, "shard").sortWithinPartitions("shard", F.col("n").isNull())
    gone = both.mapInArrow(_probed(least_docs), "doc_id long, tkey long, line int")
    # a set, so that repeated rows of one text are one here
    out = materialize(gone.groupBy("doc_id", "tkey").agg(F.collect_set("line").alias("lines")), "line-drops")
    discard(known, shards)
    return out


def _apply(keep_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                n, gone, digests, texts = [], [], [], []
                for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    lines, away = text.split(b"\n"), set(drop or ())
                    kept = b"\n".join(x for i, x in enumerate(lines) if i not in away) if away else text
                    n.append(len(lines))
                    gone.append(len(away))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(kept)
                arrays, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
                if keep_text:
                    arrays, names = [*arrays, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return apply


def dedup(docs: DataFrame, least: int = LEAST, least_docs: int = DOCS, keep_text: bool = True) -> DataFrame:
    """Every document without its repeated lines: (doc_id, n_lines, n_dropped, kept_sha256[, kept]).

    A line goes if its key has ``least`` code points or more, ``least_docs``
    documents or more (at least 2) hold the key, and the document isn't the one
    with the largest doc_id among them; n_lines is counted before. All lines with
    that key stay there, however often it repeats it. Null and empty texts have
    one empty line. Each row counts as a document; a null doc_id is smaller than
    any other, and rows that share the largest doc_id all keep the line. Each
    input row gives one row, an empty table an empty table; columns other than
    doc_id and text are not read.
    """
    if least_docs < 2:
        raise ValueError("a line of one document only is never dropped: least_docs must be 2 or more")
    found = dropped(docs, least, least_docs).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), "lines")
    rows = keyed(docs)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")), "left").select("doc_id", "text", "lines")
    return joined.mapInArrow(_apply(keep_text), "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if keep_text else ""))
