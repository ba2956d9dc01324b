"""Substring dedup by relative Lempel-Ziv parsing against every reference block of the corpus.

Index. Every document is cut at content-defined anchors: the anchor of a window
of ``window`` words is its smallest hashed ``gram``-word run. Neighbouring
windows with the same anchor form a block, so equal passages are cut alike
wherever they stand, about one block for each 20 words. The reference is the set
of distinct blocks of all documents, each with its first place (smallest doc_id,
then the place in that document); it is built by a grouped minimum and is never
in one place.

Parsing. A document's blocks are looked up in the reference by a join, and a
block that an earlier document holds is a copy of the reference from a known
place on. Where a block isn't copied whole, a factor may still end inside it: if
blocks of other content share its anchor, its windows are looked up one by one
among those of such blocks' first copies. (Windows of a block whose first copy
is elsewhere need no such look, since that copy's windows stand for them.)

A block's first place needn't be the one that goes on longest, so runs of 2, 4,
8, ... neighbouring blocks are looked up too, each with its own first place: a
block has as many known places as runs begin in it. What a block that isn't
copied whole shares of its windows counts as a block here. Runs whose blocks'
first places already follow one another say nothing new and are left out; that
depends on their content only, so whoever looks a run up finds it wherever it stands.
From left to right, a factor takes, of all known places that its first window is
a copy of, the one that goes on longest, and ends where that one's copy ends. A
factor is (reference document, place in it, length in words). Where a factor
begins with a block and some earlier document holds the next b whole blocks, it
gets more than b / 2 of them, as the longest run of a power of two is among the
known places. Factors are made of whole windows, so all are long enough, and the
words that they cover are the duplicate spans.

Keys are pairs of 64-bit hashes, so they behave as 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import discard, gram_hashes, materialize, mix64, powers, slices, text_or_empty, word_hashes, word_spans

WINDOW, GRAM = 50, 12
_ROLL = np.uint64(0xA24BAED4963EE407)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of values[i : i + width], for every full i."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    at, best, size = np.arange(len(values)), values, 1

    def join(shift: int) -> None:
        nonlocal at, best
        right = best[shift:] < best[: len(best) - shift]
        at = np.where(right, at[shift:], at[: len(at) - shift])
        best = np.where(right, best[shift:], best[: len(best) - shift])

    while size * 2 <= width:
        join(size)
        size *= 2
    if size < width:
        join(width - size)
    return at


def blocks_of(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row's words, windows, anchor hash, content hash) of all blocks; ``first`` as of word_spans."""
    empty = np.zeros(0, np.int64)
    if len(words) < window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams, whole = gram_hashes(words, gram), gram_hashes(words, window)
    anchor = sliding_argmin(grams, window - gram + 1)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)[: len(whole)]
    start = np.arange(len(whole))
    inside = np.flatnonzero(start + window <= first[1:][row])
    if not len(inside):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    row, anchor = row[inside], anchor[inside]
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    begin = np.flatnonzero(fresh)
    size = np.diff(np.concatenate((begin, [len(inside)])))
    rel = np.arange(len(inside)) - np.repeat(begin, size)
    content = mix64(np.add.reduceat(whole[inside] * powers(_ROLL, int(size.max()))[rel], begin) + size.astype(np.uint64))
    return row[begin], inside[begin] - first[row[begin]], size, grams[anchor[begin]], content


def origins(row: np.ndarray, start: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For each block, where the first block of the same content starts in its row."""
    order = np.lexsort((start, content, anchor, row))
    same = np.zeros(len(order), dtype=bool)
    for x in (row, anchor, content):
        x = x[order]
        same[1:] |= x[1:] != x[:-1]
    same[:1] = True
    lead = np.maximum.accumulate(np.where(same, np.arange(len(order)), 0))
    out = np.empty_like(start)
    out[order] = start[order][lead]
    return out


def _index(window: int, gram: int):
    names = ["doc_id", "tkey", "anchor", "block", "start", "origin", "n"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = (np.asarray(batch.column(i)) for i in (0, 1))
            for a, b, data, offsets in slices(batch.column(2)):
                starts, ends, first = word_spans(data, offsets)
                row, start, n, anchor, content = blocks_of(word_hashes(data, starts, ends), first, window, gram)
                if len(row):
                    columns = (doc[a:b][row], key[a:b][row], anchor.view(np.int64), content.view(np.int64), start.astype(np.int32), origins(row, start, anchor, content).astype(np.int32), n.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return index


def _windows(window: int):
    names = ["doc_id", "tkey", "anchor", "content", "place", "part"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = (np.asarray(batch.column(i)) for i in (0, 1))
            marks = batch.column(3)
            for a, b, data, offsets in slices(batch.column(2)):
                starts, ends, first = word_spans(data, offsets)
                held = gram_hashes(word_hashes(data, starts, ends), window)
                part = marks.slice(a, b - a)
                flat = part.flatten()
                sizes = np.diff(np.asarray(part.offsets))
                row = np.repeat(np.arange(b - a), sizes)
                start, n, anchor = (np.asarray(flat.field(f)) for f in ("start", "n", "anchor"))
                whole = np.asarray(flat.field("shared"))
                if not len(row):
                    continue
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                rel = np.arange(int(n.sum())) - np.repeat(begin, n)
                at = np.repeat(start, n) + rel
                row = np.repeat(row, n)
                yield pa.RecordBatch.from_arrays([pa.array(doc[a:b][row]), pa.array(key[a:b][row]), pa.array(np.repeat(anchor, n)), pa.array(held[first[row] + at].view(np.int64)), pa.array(at.astype(np.int32)), pa.array(np.repeat(~whole.astype(bool), n))], names=names)

    return look


def runs_of(row: np.ndarray, start: np.ndarray, n: np.ndarray, ref: np.ndarray, at: np.ndarray, keys: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first block, windows, keys) of the runs of 2, 4, 8, ... neighbouring blocks whose first places don't follow one another.

    Blocks are in order of row and start; ``keys`` are hashes of each.
    """
    if len(row) < 2:
        return
    follows = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + n[:-1])
    turns = (ref[1:] != ref[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1])
    chain, turn = (np.concatenate(([0], np.cumsum(x))) for x in (~follows, turns))
    size = 1
    while size < len(row):
        scale = powers(_ROLL, size + 1)[-1]
        keys = [mix64(k[:-size] * scale + k[size:]) for k in keys]
        size *= 2
        last = np.arange(size - 1, len(row))
        first = last - size + 1
        whole = chain[last] == chain[first]
        if not whole.any():
            return
        told = np.flatnonzero(whole & (turn[last] > turn[first]))
        yield told, start[told + size - 1] + n[told + size - 1] - start[told], [k[told] for k in keys]


def _run_keys(ref: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two hashes of a place and a length: what stands there is known by them."""
    ref, at, n = (x.astype(np.int64).view(np.uint64) for x in (ref, at, n))
    return [mix64(mix64(mix64(ref + np.uint64(salt)) + at) + n) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]


def _fields(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The row of each struct in the lists, and its fields."""
    lists = lists.fill_null([])
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), *(np.asarray(flat.field(f)) for f in names)


def parts_of(row: np.ndarray, start: np.ndarray, ref: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, windows, ref, at) of the longest runs of windows of one block that are copied from places that follow one another."""
    order = np.lexsort((start, row))
    row, start, ref, at, anchor = (x[order] for x in (row, start, ref, at, anchor))
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(fresh)
    return row[begin], start[begin], np.diff(np.concatenate((begin, [len(row)]))), ref[begin], at[begin]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tkey", "key", "key2", "start", "n"]
    for batch in batches:
        doc, key = (np.asarray(batch.column(i)) for i in (0, 1))
        blocks = _fields(batch.column(2), ("start", "n", "ref", "at"))
        parts = parts_of(*_fields(batch.column(3), ("start", "ref", "at", "anchor")))
        row, start, n, ref, at = (np.concatenate(x) for x in zip(blocks, parts))
        order = np.lexsort((start, row))
        row, start, n, ref, at = (x[order] for x in (row, start, n, ref, at))
        for told, size, keys in runs_of(row, start, n, ref, at, _run_keys(ref, at, n)):
            if len(told):
                columns = (doc[row[told]], key[row[told]], *(k.view(np.int64) for k in keys), start[told].astype(np.int32), size.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, text): tkey tells rows of one doc_id apart by their texts."""
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, tkey, copies array<struct<start, n, ref, at>>): n windows from ``start`` on that document ``ref``, an earlier one, holds from its word ``at`` on.

    Copies may overlap: a block's own, those of the runs that it is part of, and windows looked up one by one.

    Aggregates are written before they are joined: a join of plain exchanges lets Spark split a block, anchor or text that many rows share.
    """
    keyed = _keyed(docs)
    blocks = materialize(keyed.where(F.col("doc_id").isNotNull()).mapInArrow(_index(window, gram), "doc_id long, tkey long, anchor long, block long, start int, origin int, n int"), "rlz-blocks")
    reference = blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min_by("origin", "doc_id").alias("at"))
    reference = materialize(reference, "rlz-reference")
    shared = reference.groupBy("anchor").agg(F.count("*").alias("blocks"), F.min("ref").alias("low"), F.max("last").alias("high"))
    shared = materialize(shared.where((F.col("blocks") > 1) & (F.col("low") < F.col("high"))).select("anchor", F.lit(True).alias("varies")), "rlz-anchors")
    useful = reference.join(shared, "anchor", "left").where((F.col("ref") < F.col("last")) | F.col("varies"))
    useful = materialize(useful.select("anchor", "block", "ref", "at", (F.col("ref") < F.col("last")).alias("shared"), F.coalesce("varies", F.lit(False)).alias("varies")), "rlz-useful")
    discard(reference, shared)
    copied = F.col("ref") < F.col("doc_id")
    found = blocks.join(useful, ["anchor", "block"]).where(F.col("shared") | F.col("varies"))
    # sets, so that repeated rows of one text are one here
    per_doc = found.groupBy("doc_id", "tkey").agg(
        F.collect_set(F.when(F.col("shared"), F.struct("start", "n", "ref", "at"))).alias("chain"), F.collect_set(F.when(~copied & F.col("varies"), F.struct("start", "n", "anchor", "shared"))).alias("edges")
    )
    per_doc = materialize(per_doc, "rlz-copies")
    discard(blocks, useful)
    edges = per_doc.where(F.size("edges") > 0).select("doc_id", "tkey", "edges")
    texts = keyed.join(edges, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "edges")
    look = materialize(texts.mapInArrow(_windows(window), "doc_id long, tkey long, anchor long, content long, place int, part boolean"), "rlz-windows")
    early = look.groupBy("anchor", "content").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "place"))["place"].alias("at"))
    early = materialize(early.where(F.col("ref") < F.col("last")).select("anchor", "content", "ref", "at"), "rlz-early")
    single = look.join(early, ["anchor", "content"]).groupBy("doc_id", "tkey").agg(
        F.collect_set(F.when(copied, F.struct(F.col("place").alias("start"), F.lit(1).alias("n"), "ref", "at"))).alias("places"),
        F.collect_set(F.when(F.col("part"), F.struct(F.col("place").alias("start"), "ref", "at", "anchor"))).alias("parts"),
    )
    known = per_doc.select("doc_id", "tkey", "chain").join(single, ["doc_id", "tkey"], "left")
    known = materialize(known.where((F.size("chain") > 0) | F.col("places").isNotNull()), "rlz-known")
    discard(per_doc, look, early)
    runs = known.where((F.size("chain") > 1) | F.col("parts").isNotNull()).select("doc_id", "tkey", "chain", "parts")
    runs = materialize(runs.mapInArrow(_runs, "doc_id long, tkey long, key long, key2 long, start int, n int"), "rlz-runs")
    origin = runs.groupBy("key", "key2").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "start"))["start"].alias("at"))
    origin = materialize(origin.where(F.col("ref") < F.col("last")).select("key", "key2", "ref", "at"), "rlz-run-origins")
    # a start's longest run, so that there are at most as many as blocks; a text is one row of known, so no text comes twice
    longer = runs.join(origin, ["key", "key2"]).where(copied).repartition("doc_id", "tkey").groupBy("doc_id", "tkey", "start").agg(F.max_by(F.struct("n", "ref", "at"), "n").alias("m"))
    longer = materialize(longer.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "m.n", "m.ref", "m.at")).alias("longer")), "rlz-longer")
    discard(runs, origin)
    none = F.array().cast("array<struct<start:int,n:int,ref:bigint,at:int>>")
    own = F.filter("chain", lambda c: c["ref"] < F.col("doc_id"))
    both = known.join(longer, ["doc_id", "tkey"], "left").select("doc_id", "tkey", F.concat(own, F.coalesce("places", none), F.coalesce("longer", none)).alias("copies"))
    both = materialize(both.where(F.size("copies") > 0), "rlz-marks")
    discard(known, longer)
    return both


def factors(copies: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The greedy parse, as (first word, end word, reference document, its first word), from copies (start, n, ref, at) of windows.

    Copies of one document that lie at the same distance from it and meet are one
    stretch. A factor begins at the first window that is left and takes the
    stretch around it that goes on longest, of equal ones that of the smallest
    (document, place).
    """
    stretches: list[list[int]] = []
    for ref, shift, start, end in sorted((ref, at - start, start, start + n) for start, n, ref, at in copies):
        if stretches and stretches[-1][1:3] == [ref, shift] and start <= stretches[-1][3]:
            stretches[-1][3] = max(stretches[-1][3], end)
        else:
            stretches.append([start, ref, shift, end])
    stretches.sort()
    out, left, at = [], 0, 0
    best: tuple[int, int, int] | None = None  # (-end, ref, shift) of the longest stretch that begins at ``at`` or before
    while True:
        while left < len(stretches) and stretches[left][0] <= at:
            start, ref, shift, end = stretches[left]
            best = (-end, ref, shift) if best is None else min(best, (-end, ref, shift))
            left += 1
        if best is not None and -best[0] > at:
            end, ref, shift = -best[0], *best[1:]
            out.append((at, end - 1 + window, ref, at + shift))
            at = end
        elif left < len(stretches):
            at, best = stretches[left][0], None
        else:
            return out


def covered(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The words that factors, in order of their places, cover: spans that touch are one."""
    out: list[list[int]] = []
    for a, b, *_ in parts:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(words: list, spans: list[tuple[int, int]]) -> list:
    """The words outside all spans."""
    kept, at = [], 0
    for a, b in spans:
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def _apply(window: int, keep_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                out: list[tuple] = []
                for text, copies in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = text.encode().split()  # bytes.split() takes exactly the separators of a word
                    parts = factors([(c["start"], c["n"], c["ref"], c["at"]) for c in copies], window) if copies else []
                    kept = cut(words, covered(parts)) if parts else words
                    joined = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if keep_text else None, [{"start": s, "end": e, "ref": r, "at": t} for s, e, r, t in parts]))
                n, gone, digest, kept_text, parts_of = zip(*out) if out else ((), (), (), (), ())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref", pa.int64()), ("at", pa.int32())]))
                arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    arrays += [pa.array(kept_text, pa.string()), pa.array(parts_of, kind)]
                    names += ["kept", "factors"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return apply


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """Every document without the words of its duplicate spans: (doc_id, n_words, n_removed, kept_sha256[, kept, factors]).

    A word goes if it is covered by ``window`` consecutive words that also stand
    in a document with a smaller doc_id; spans are judged on the input. ``kept``
    joins the other words by one space. ``factors`` are the copies (start, end,
    ref, at): words start to end, exclusive, are those of document ``ref`` from
    its word ``at`` on, of the known places the one that goes on longest (of
    several rows with that doc_id, any).
    Null text has no words. A row with a null doc_id is neither searched nor a
    source and stays whole; rows with equal doc_id are no sources for each
    other. Each input row gives one row; an empty table gives an empty table;
    columns other than doc_id and text are not read. ``gram`` must be at most ``window``.
    """
    found = marks(docs, window, gram)
    joined = _keyed(docs).join(found, ["doc_id", "tkey"], "left").select("doc_id", "text", "copies")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, factors array<struct<start:int,end:int,ref:bigint,at:int>>" if keep_text else "")
    return joined.mapInArrow(_apply(window, keep_text), schema)
