"""Importance resampling towards a target text collection, by hashed n-gram features.

Postings. A text's features are counted by bucket, and the postings (bucket,
document, count) are written in packs: one row for a slice of documents and a
group of buckets. Sums of each bucket come from the packs of both corpora, first
in the task and then by a grouped sum.

Gains. Packs are shuffled by group of buckets (and a salt, so that a group, which
takes part in nearly every document, is as many tasks as needed). Before the
packs, a task gets the sums of its own group's buckets in both corpora, computes
the gains of these buckets there, and emits one contribution for each document of
a pack. Contributions are reduced by document.

Draw. Scores are weights with Gumbel noise seeded by the document's id, so the
highest scores are a sample without replacement. Ranks are places in a range
partition of the scores plus the sizes of the partitions before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.llm.common import LOWER, discard, gram_hashes, materialize, mix64, slices, text_or_empty, word_hashes, word_spans

BUCKETS, WORDS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Groups of buckets.
GROUPS = 16

#: Separators: all ASCII bytes but digits and small letters; texts are lower-cased first.
_SEP = np.ones(256, dtype=bool)
_SEP[128:] = False
_SEP[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

_PACK = "corpus int, grp int, ids binary, known binary, tkeys binary, rows binary, buckets binary, counts binary"


def features(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of the texts in ``data`` (lower-cased), and the words of each row."""
    starts, ends, first = word_spans(data, offsets, _SEP)
    hashes, row = word_hashes(data, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
    raw, rows, found = data.tobytes(), [], []
    for k in range(1, most + 1):
        if len(hashes) < k:
            break
        whole = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        grams = (hashes if k == 1 else gram_hashes(hashes, k))[whole]
        _, at, back = np.unique(grams, return_index=True, return_inverse=True)
        crc = [zlib.crc32(b" ".join(raw[starts[i + j] : ends[i + j]] for j in range(k))) % buckets for i in whole[at].tolist()]
        rows.append(row[whole])
        found.append(np.array(crc, np.int64)[back] if crc else np.zeros(0, np.int64))
    empty = np.zeros(0, np.int64)
    return np.concatenate(rows or [empty]), np.concatenate(found or [empty]), np.diff(first)


def _postings(corpus: int, most: int, buckets: int, groups: int):
    width = -(-buckets // groups)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of slices of (doc_id, tkey, text); group -1 has every document once, with its words and its features."""
        for batch in batches:
            ids = batch.column(0)
            known, ids, tkeys = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in slices(batch.column(2)):
                row, bucket, words = features(LOWER[data], offsets, most, buckets)
                key, count = np.unique(row * buckets + bucket, return_counts=True)
                row, bucket = key // buckets, key % buckets
                own, out = bucket // width, []
                out.append((-1, ids[a:b], known[a:b], tkeys[a:b], np.arange(b - a), words, np.bincount(row, count, b - a).astype(np.int64)))
                for g in np.unique(own).tolist():
                    here = own == g
                    used, place = np.unique(row[here], return_inverse=True)
                    out.append((g, ids[a:b][used], known[a:b][used], tkeys[a:b][used], place, bucket[here], count[here]))
                grp, *arrays = zip(*out)
                kinds = (np.int64, np.bool_, np.int64, np.uint32, np.uint32, np.uint32)
                columns = [pa.array([x.astype(kind).tobytes() for x in v], pa.binary()) for v, kind in zip(arrays, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([corpus] * len(grp), pa.int32()), pa.array(grp, pa.int32()), *columns], names=["corpus", "grp", "ids", "known", "tkeys", "rows", "buckets", "counts"])

    return postings


def _sums(buckets: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(corpus, bucket, n): a task's features of each bucket."""
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for corpus, b, n in zip(*(batch.column(c).to_pylist() for c in ("corpus", "buckets", "counts"))):
                np.add.at(total[corpus], np.frombuffer(b, np.uint32), np.frombuffer(n, np.uint32))
        corpus, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(corpus.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[corpus, bucket])], names=["corpus", "bucket", "n"])

    return sums


def gains(own: np.ndarray, aim: np.ndarray, all_own: int, all_aim: int, buckets: int) -> np.ndarray:
    """Each bucket's gain, in thousandths, from its features in the corpus and in the target."""
    ratio = (aim + 1.0) * (all_own + float(buckets)) / ((own + 1.0) * (all_aim + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _contributions(buckets: int, groups: int):
    width = -(-buckets // groups)

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, tkey, weight): what a group's buckets add to each document of a pack; rows come by part, sums first."""
        gain, part = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["sums"] is not None:
                    part, own, aim = r["part"], np.zeros(width), np.zeros(width)
                    for s in r["sums"]:
                        own[s["bucket"] - r["grp"] * width], aim[s["bucket"] - r["grp"] * width] = s["own"], s["aim"]
                    gain = gains(own, aim, r["all_own"], r["all_aim"], buckets)
                    continue
                if r["part"] != part:
                    raise RuntimeError("postings without the sums of their buckets")
                ids, known, tkeys = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], np.bool_), np.frombuffer(r["tkeys"], np.int64)
                rows, bucket, count = (np.frombuffer(r[c], np.uint32) for c in ("rows", "buckets", "counts"))
                add = np.zeros(len(ids), np.int64)
                np.add.at(add, rows, gain[bucket - r["grp"] * width] * count.astype(np.int64))
                out.append((ids, known, tkeys, add))
            if out:
                ids, known, tkeys, add = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(tkeys), pa.array(add)], names=["doc_id", "tkey", "weight"])

    return contributions


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, known, tkeys = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], np.bool_), np.frombuffer(r["tkeys"], np.int64)
            words, n = (np.frombuffer(r[c], np.uint32).astype(np.int64) for c in ("buckets", "counts"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(tkeys), pa.array(words), pa.array(n)], names=["doc_id", "tkey", "n_words", "n_features"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def weigh(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """(doc_id, tkey, copies, n_words, n_features, weight), written: one row for each different (doc_id, text); ``target`` needs a column text."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tkey"), text_or_empty(F.col("text")).alias("text"))
    packs = materialize(_keyed(docs).mapInArrow(_postings(0, most, buckets, groups), _PACK).unionByName(aims.mapInArrow(_postings(1, most, buckets, groups), _PACK)), "resample-postings")
    own, aim = (F.sum(F.when(F.col("corpus") == c, F.col("n")).otherwise(0)) for c in (0, 1))
    sums = packs.where("grp >= 0").mapInArrow(_sums(buckets), "corpus int, bucket int, n long").groupBy("bucket").agg(own.alias("own"), aim.alias("aim"))
    sums = materialize(sums, "resample-sums")
    whole = sums.agg(F.sum("own").alias("own"), F.sum("aim").alias("aim")).first()
    # a row of sums for each group and salt; 4 keys for each partition, so that hashing them deals evenly
    salts = max(-(-4 * parts // groups), 1)
    width = -(-buckets // groups)
    first = sums.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("grp")).agg(F.collect_list(F.struct("bucket", "own", "aim")).alias("sums"))
    first = first.select("grp", "sums", F.lit(whole["own"] or 0).cast("long").alias("all_own"), F.lit(whole["aim"] or 0).cast("long").alias("all_aim"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    own_packs = packs.where("corpus = 0")
    dealt = own_packs.where("grp >= 0").select("grp", F.pmod(F.xxhash64("ids", "tkeys", "rows"), F.lit(salts)).cast("int").alias("salt"), "ids", "known", "tkeys", "rows", "buckets", "counts")
    both = first.unionByName(dealt, allowMissingColumns=True).withColumn("part", F.col("grp") * salts + F.col("salt"))
    both = both.repartition(parts, "part").sortWithinPartitions("part", F.col("sums").isNull())
    added = both.mapInArrow(_contributions(buckets, groups), "doc_id long, tkey long, weight long")
    heads = own_packs.where("grp < 0").mapInArrow(_heads, "doc_id long, tkey long, n_words long, n_features long")
    zero = F.lit(0).cast("long")
    heads = heads.select("doc_id", "tkey", F.lit(1).cast("long").alias("copies"), "n_words", "n_features", zero.alias("weight"))
    added = added.select("doc_id", "tkey", zero.alias("copies"), zero.alias("n_words"), zero.alias("n_features"), "weight")
    total = heads.unionByName(added).groupBy("doc_id", "tkey").agg(*[F.sum(c).alias(c) for c in ("copies", "n_words", "n_features", "weight")])
    # equal rows were summed up, each with the same numbers
    out = materialize(total.select("doc_id", "tkey", "copies", *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")]), "resample-weights")
    discard(packs, sums)
    return out


def _ranked(docs: DataFrame, target: DataFrame, most: int, buckets: int, percent: int, least_words: int, seed: int) -> DataFrame:
    """``resample`` with tkey and the copy's number."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    weighed = weigh(docs, target, most, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = weighed.select("doc_id", "tkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tkey"), F.col("copy")]
    able = rows.where(F.col("n_words") >= least_words).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # this id is the partition's number in its upper bits, the row's place in the partition in the lower 33
    able = materialize(able.withColumn("at", F.monotonically_increasing_id()), "resample-order")
    sizes = able.groupBy(F.shiftright("at", 33).alias("of")).agg(F.count("*").alias("n"))
    # one row for each partition of the order
    before = sizes.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("able"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1
    drawn = F.floor(F.col("able") * percent / 100)
    able = able.join(F.broadcast(before), F.shiftright("at", 33) == F.col("of")).withColumn("rank", F.when(rank <= drawn, rank))
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "tkey", "copy"]
    return able.select(*columns).unionByName(others.select(*columns))


def resample(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's place in the draw: (doc_id, n_features, weight, score, rank), all long.

    Features are runs of 1 to ``most`` words, hashed to ``buckets``; ``weight``
    is the sum of their gains towards ``target`` (a table with a column text), and
    ``score`` adds the seeded noise. Of the documents with ``least_words`` words or
    more, the ``percent`` in a hundred with the highest scores get a rank, ties
    going to the smaller doc_id; rank is null for all others. A null or wordless
    text has no features and the weight 0. A null doc_id has the noise of an empty
    id and comes last in ties; rows with one doc_id share its noise, and those
    that are equal in doc_id and text each have a place. Each input row gives
    one row, an empty table an empty table, and an empty target counts as one of
    no features; columns other than doc_id and text are not read.
    """
    return _ranked(docs, target, most, buckets, percent, least_words, seed).drop("tkey", "copy")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns.

    Rows equal in doc_id and text share one score, so at most one such group is
    drawn in part; any of its rows are taken.
    """
    defaults = {"most": WORDS, "buckets": BUCKETS, "percent": PERCENT, "least_words": LEAST_WORDS, "seed": SEED}
    ranks = _ranked(docs, target, **{**defaults, **options})
    groups = materialize(ranks.groupBy("doc_id", "tkey").agg(F.count("rank").alias("n"), F.count("*").alias("all")).where("n > 0"), "resample-drawn")
    # whole rows travel as one struct, so that no column of theirs can meet one of these names
    text = text_or_empty(F.col("row")["text"])
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row")["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"))
    whole = groups.where("n = all").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"))
    out = rows.join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")), "left_semi")
    part = groups.where("n < all").first()
    if part is not None:
        same = F.col("doc_id").eqNullSafe(F.lit(part["doc_id"])) & (F.col("tkey") == part["tkey"])
        out = out.unionByName(rows.where(same).limit(part["n"]))
    return out.select("row.*")
