"""Near-duplicate join of word n-gram sets by exact Jaccard similarity.

Rare-first prefix filtering: a set's n-grams are ordered by how often their
hash cell occurs in the whole corpus (a count table whose size follows the
corpus up to a bound, summed over all tasks), then by hash; any such order is
valid, and this one puts common n-grams last. Of two sets that reach the
threshold t, the larger one shares an n-gram among its first n - ceil(t n) + 1
with the first n - ceil(t (n + m) / (1 + t)) + 1 of the smaller one, m being the
larger one's size. So lists are kept by n-gram and by a band of sizes: a set
stands in the list of its own band with its whole prefix, and in the lists of
the bands of its possible larger partners with the shorter prefix that such
partners leave it. A list without a set in its short prefix has no pairs and
goes. This keeps what all pages of a template share out of the join unless the
pages are near the threshold. Sets of a list are then subject to the length and
the positional filter; each pair is verified once, first by the suffix filter
(counts in equal hash ranges bound the overlap), then exactly.

Equal sets are one node, so copies cost one row each. Sets are told apart by two
64-bit hashes. In a long list, not all pairs are made: first all meet the list's
most central set, and only sets that the found links leave in different
components meet each other. No link between components can be missed, as every
pair that shares a list is then either verified or inside one component.
So links inside a component are not all verified: classes are exact, but neither
the links nor a document's number of links can be told.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import discard, gram_hashes, materialize, mix64, slices, text_or_empty, word_hashes, word_spans
from cpgloom.llm.components import components

#: Words of an n-gram; threshold in hundredths.
NGRAM, PERCENT = 4, 85
#: Cells of the count table: one for CELL_BYTES of input within bounds, as every task holds the table; cells in a part of it.
FEWEST_CELLS, MOST_CELLS, CELL_BYTES, PART = 1 << 20, 1 << 24, 256, 1 << 14
#: Bands of sizes between a size and the largest that a partner may have.
BANDS = 4
#: Lists up to this long are joined in full at once.
SHORT = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each row; fewer than n words are one n-gram as a whole."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, n)
    bounds = first.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def cells_for(docs: DataFrame) -> int:
    """Cells of the count table for this input, a power of two; the fewest where the size isn't known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return FEWEST_CELLS if size >= 1 << 60 else min(max(1 << (size // CELL_BYTES).bit_length(), FEWEST_CELLS), MOST_CELLS)


def _count_cells(n: int, cells: int):
    part = min(PART, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                data = _LOWER[data]
                starts, ends, first = word_spans(data, offsets)
                grams = gram_hashes(word_hashes(data, starts, ends), n)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(grams)]
                grams = grams[np.arange(len(grams)) + n <= first[1:][row]]
                np.add.at(table, (grams & np.uint64(cells - 1)).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        for k in range(0, cells, part):
            yield pa.RecordBatch.from_arrays([pa.array([k // part], pa.int32()), pa.array([task // 256], pa.int32()), pa.array([zlib.compress(table[k : k + part].astype(np.int64).tobytes(), 1)], pa.binary())], names=["part", "salt", "counts"])

    return count


def _total(df: pd.DataFrame) -> np.ndarray:
    return sum(np.frombuffer(zlib.decompress(c), np.int64) for c in df["counts"])


def _sum_cells(df: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": df["part"].iloc[:1], "salt": [0], "counts": [zlib.compress(_total(df).tobytes(), 1)]})


def _rank_cells(df: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": df["part"].iloc[:1], "ranks": [zlib.compress(_ranks(_total(df)).tobytes(), 1)]})


def rank_table(texts: DataFrame, n: int, cells: int) -> np.ndarray:
    """For each hash cell, a rank of how often its n-grams occur in all texts. Counts are summed in two steps of bounded groups."""
    schema = "part int, salt int, counts binary"
    rows = texts.mapInArrow(_count_cells(n, cells), schema)
    rows = rows.groupBy("part", "salt").applyInPandas(_sum_cells, schema).groupBy("part").applyInPandas(_rank_cells, "part int, ranks binary")
    part = min(PART, cells)
    table = np.zeros(cells, dtype=np.uint16)
    for r in rows.collect():  # cells / part rows of two bytes a cell: bounded
        table[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(zlib.decompress(r["ranks"]), np.uint16)
    return table


def _ranks(table: np.ndarray) -> np.ndarray:
    """A count's place among 65,536 steps, finer for small counts."""
    return np.minimum(np.where(table < 4096, table * 8, 32768 + np.log2(np.maximum(table, 1)) * 512), 65535).astype(np.uint16)


def _sets(n: int, percent: int, ranks):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        mask = np.uint64(len(rank) - 1)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                sid, sid2, size, prefix = [], [], [], []
                for grams in shingles(data, offsets, n):
                    size.append(len(grams))
                    for ids, salt in ((sid, 0), (sid2, 0x5851F42D4C957F2D)):
                        ids.append(int(mix64(mix64(grams ^ np.uint64(salt)).sum(keepdims=True) + np.uint64(len(grams)))[0]) if len(grams) else 0)
                    if len(grams):
                        order = np.argsort((rank[grams & mask].astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16)), kind="stable")
                        prefix.append(grams[order[: prefix_length(len(grams), percent)]].view(np.int64))
                    else:
                        prefix.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sid, sid2)), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["place", "tkey", "sid", "sid2", "n", "prefix"],
                )

    return make


def _whole_sets(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([g.tobytes() for g in shingles(data, offsets, n)], pa.binary())], names=["node", "grams"])

    return make


def overlap_bound(x: np.ndarray, y: np.ndarray, parts: int = 8) -> int:
    """At most so many common elements: in each range between splitters, the smaller count (suffix filter)."""
    cuts = x[np.arange(1, parts) * len(x) // parts]
    in_x = np.diff(np.concatenate(([0], np.searchsorted(x, cuts), [len(x)])))
    in_y = np.diff(np.concatenate(([0], np.searchsorted(y, cuts), [len(y)])))
    return int(np.minimum(in_x, in_y).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 |x & y| >= percent |x | y| for sorted distinct arrays."""
    both = len(x) + len(y)
    need = -(-percent * both // (100 + percent))
    if overlap_bound(x, y) < need:
        return False
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            yes = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y)]
            mask = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return verify


def _near(percent: int):
    """Length and positional filter of two rows ``x`` and ``y`` of a shared n-gram."""
    nx, ny = F.col("x.n"), F.col("y.n")
    length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    rest = 1 + F.least(nx - F.col("x.pos") - 1, ny - F.col("y.pos") - 1)
    return length & ((100 + percent) * rest >= percent * (nx + ny))


def _pair():
    return F.least(F.col("x.node"), F.col("y.node")).alias("a"), F.greatest(F.col("x.node"), F.col("y.node")).alias("b")


def banded(listed: DataFrame, percent: int) -> DataFrame:
    """(token, band, node, n, pos, index, probe): the lists that each row (node, n, pos, token) stands in.

    ``probe``: as the larger set, in its own band. ``index``: as the smaller
    one, with the prefix that the least size of the band's sets leaves it.
    """
    step = math.log(100 / percent) / BANDS
    n = F.col("n")

    def band(size):
        return F.floor(F.log(size) / F.lit(step)).cast("int")

    own = band(n)
    rows = listed.select("*", own.alias("own"), F.explode(F.sequence(own, band(F.floor(n * 100 / percent)))).alias("band"))
    least = F.greatest(n, F.floor(F.exp(F.col("band") * F.lit(step)) * F.lit(1 - 1e-9)))
    short = n - F.ceil(percent * (n + least) / (100 + percent)) + 1
    rows = rows.select("token", "band", "node", "n", "pos", (F.col("pos") < short).alias("index"), (F.col("band") == F.col("own")).alias("probe"))
    return rows.where(F.col("index") | F.col("probe"))


def candidate_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, band, node, n, pos, index, probe, df, rank): all lists that can hold a pair.

    ``df`` is the list's length, ``rank`` how much of its prefix a set shares with no other.
    Aggregates are written before they are joined: a join of plain exchanges lets
    Spark split a list that many sets share.
    """
    listed = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    n = F.col("n")
    short = n - F.ceil(percent * 2 * n / (100 + percent)) + 1
    common = listed.groupBy("token").agg(F.count("*").alias("sets"), F.count_if(F.col("pos") < short).alias("short")).where(F.col("sets") > 1)
    common = materialize(common.select("token", (F.col("short") > 0).alias("paired")), "join-common")
    both = materialize(listed.join(common, "token"), "join-tokens")
    alone = F.first("n") - F.ceil(F.first("n") * percent / 100) + 1 - F.count("*")
    centre = materialize(both.groupBy("node").agg(alone.alias("rank")), "join-centre")
    shared = materialize(banded(both.where("paired").drop("paired"), percent), "join-shared")
    useful = shared.groupBy("token", "band").agg(F.count("*").alias("df"), F.count_if("index").alias("short"), F.count_if("probe").alias("own")).where((F.col("df") > 1) & (F.col("short") > 0) & (F.col("own") > 0))
    useful = materialize(useful.select("token", "band", "df"), "join-useful")
    kept = materialize(shared.join(useful, ["token", "band"]), "join-kept")
    lists = materialize(kept.join(centre, "node"), "join-lists")
    discard(common, both, shared, useful, kept, centre)
    return lists


#: Stands for a null doc_id in joins.
NOWHERE = -(2**63)
#: All characters between words.
SPACE = " \t\n\v\f\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """(place, tkey, text): doc_id with NOWHERE for null, and a key that tells rows of one doc_id apart by their texts."""
    text = text_or_empty(F.col("text"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOWHERE)).alias("place"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def _classed(docs: DataFrame, ngram: int, percent: int, cells: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows (place, tkey, sid, sid2, n), and for each distinct set (sid, sid2, owner) its class's first row.

    ``owner`` is a struct (unnamed, place, tkey): null doc_ids come last. Rows with n = 0 have no n-grams and no set.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    # two bytes a cell, MOST_CELLS at most
    ranks = spark.sparkContext.broadcast(rank_table(keyed.select("text"), ngram, cells or cells_for(docs)))
    sets = materialize(keyed.mapInArrow(_sets(ngram, percent, ranks), "place long, tkey long, sid long, sid2 long, n int, prefix array<long>"), "join-sets")

    # equal sets are one node
    owner = F.struct((F.col("place") == NOWHERE).alias("unnamed"), "place", "tkey")
    nodes = sets.where(F.col("n") > 0).groupBy("sid", "sid2").agg(F.min(owner).alias("owner"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "join-nodes")
    owners = nodes.select("node", "owner.place", "owner.tkey")
    shared = candidate_lists(nodes, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold; whole sets are made of the pairs' texts alone."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(owners, "node")
        texts = keyed.join(wanted, ["place", "tkey"]).dropDuplicates(["place", "tkey"]).select("node", "text")
        whole = materialize(texts.mapInArrow(_whole_sets(ngram), "node long, grams binary"), "join-grams")
        both = pairs.join(whole.withColumnsRenamed({"node": "b", "grams": "y"}), "b").join(whole.withColumnsRenamed({"node": "a", "grams": "x"}), "a")
        links = materialize(both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "join-links")
        discard(whole)
        return links

    x, y = shared.alias("x"), shared.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
    # x is the smaller set of a pair
    before = F.col("x.index") & F.col("y.probe") & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))) & _near(percent)
    short = x.where(F.col("x.df") <= SHORT).join(y.where(F.col("y.df") <= SHORT), same & before).select(*_pair())
    hubs = materialize(shared.where(F.col("df") > SHORT).groupBy("token", "band").agg(F.min(F.struct("rank", "node", "n", "pos")).alias("h")).select("token", "band", "h.*"), "join-hubs")
    long = x.where(F.col("x.df") > SHORT).join(hubs.alias("y"), same & (F.col("x.node") != F.col("y.node")) & _near(percent)).select(*_pair())
    tried = materialize(short.unionByName(long).distinct(), "join-pairs")
    links = verified(tried)
    found = components(links)

    # lists whose sets are still in different components: the others are done
    placed = shared.where(F.col("df") > SHORT).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = materialize(placed.groupBy("token", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") < F.col("hi")).select("token", "band"), "join-open")
    rest = materialize(placed.join(open_, ["token", "band"]), "join-rest")
    x, y = rest.alias("x"), rest.alias("y")
    cross = x.join(y, same & (F.col("x.component") != F.col("y.component")) & before).select(*_pair()).distinct()
    cross = materialize(cross.join(tried, ["a", "b"], "left_anti"), "join-pairs")
    if cross.limit(1).count():
        found = components(links.unionByName(verified(cross)))

    of = materialize(nodes.select("node", "sid", "sid2", "owner").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-components")
    first = materialize(of.groupBy("component").agg(F.min("owner").alias("owner")), "join-first")
    discard(shared, hubs, tried, open_, rest, cross, nodes)
    return sets, of.drop("owner").join(first, "component").select("sid", "sid2", "owner")


def classes(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, cells: int | None = None) -> DataFrame:
    """Near-duplicate classes: (doc_id, tkey, n_shingles, component_id), one row for each input row.

    ``component_id`` is the smallest doc_id among all documents that links lead
    to. Null and wordless texts have no n-grams, link with nothing and are their
    own component. Rows with a null doc_id take part as documents; a component of
    such rows alone has a null id. Repeated rows come as often as they are. An empty
    table gives an empty table; columns other than doc_id and text are not read.
    ``tkey`` tells rows of one doc_id apart by their texts. ``cells`` sizes the
    count table, which affects speed only.
    """
    sets, of = _classed(docs, ngram, percent, cells)
    # written, so that a set which many documents have can be split in the join
    of = materialize(of.select("sid", "sid2", F.when(~F.col("owner.unnamed"), F.col("owner.place")).alias("least")), "join-classes")
    worded = sets.where(F.col("n") > 0).join(of, ["sid", "sid2"]).select("place", "tkey", "n", "least")
    bare = sets.where(F.col("n") == 0).select("place", "tkey", "n", F.col("place").alias("least"))
    doc_id, least = (F.when(F.col(c) != NOWHERE, F.col(c)) for c in ("place", "least"))
    return worded.unionByName(bare).select(doc_id.alias("doc_id"), "tkey", F.col("n").cast("long").alias("n_shingles"), least.alias("component_id"))


def keep_one(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: that of the smallest doc_id, a null one being the last.

    Documents without words are in no class and stay, all that have a null
    doc_id included. Of rows with equal doc_id (not null) and text one stays.
    """
    kept = _classed(docs, ngram, percent, None)[1].select("owner.place", "owner.tkey").distinct()
    # whole rows travel as one struct, so that no column of theirs can meet one of these names
    text, place = F.col("row")["text"], F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(NOWHERE))
    rows = docs.select(F.struct("*").alias("row")).select("row", place.alias("place"), F.xxhash64(text_or_empty(text)).alias("tkey"), (F.ltrim(text_or_empty(text), F.lit(SPACE)) == "").alias("wordless"))
    worded = rows.where(~F.col("wordless")).join(kept, ["place", "tkey"], "left_semi").dropDuplicates(["place", "tkey"])
    wordless = rows.where("wordless").withColumn("null", text.isNull()).withColumn("own", F.when(F.col("row")["doc_id"].isNull(), F.monotonically_increasing_id()))
    return worded.select("row.*").unionByName(wordless.dropDuplicates(["place", "tkey", "null", "own"]).select("row.*"))
