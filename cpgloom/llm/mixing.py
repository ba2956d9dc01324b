"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix has as many equal-token blocks as the corpus holds. Blocks go to the
sources by highest quotients of their targets, each source's blocks to its
groups of shards likewise, and each group's to its shards, so every shard has an
integer quota and no task ranks more than a group. In a shard the documents
stand one after another in a seeded order and form one stream of words, cut into
blocks: all blocks are taken as often as the quota allows in whole, and the rest
of the quota is a seeded choice of blocks. A document's share is the overlap of
its words with the blocks taken, which needs no row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.llm.common import WORD, materialize

#: Words in a block; times a source may be repeated; documents in a shard, roughly; shards in a group, roughly.
BLOCK, REPEATS, SHARD_DOCS, GROUP_SHARDS = 16, 3, 256, 4096
SEED = 17


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words in each text, 0 for null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def default_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight``: 1, 2, 3, 1, ... by code point of the source, null last. One row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", (1 + F.pmod(F.row_number().over(order) - 1, F.lit(3))).cast("double"))


def targets(totals: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    Sources share all words by weight; a target stops at ``repeats`` times its
    source's size and the excess is shared by weight among the others, until
    none is above. In order of size / weight, the first k sources stop where the
    share left for the others is beyond them.
    """
    full = Window.partitionBy()
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = totals.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0)).alias("_stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("_gone"),
        F.sum("source_size").over(full).alias("_all"),
        F.sum("weight").over(full).alias("_weights"),
    )
    share = (F.col("_all") - F.col("_stopped")) / (F.col("_weights") - F.col("_gone"))
    # the first source that its share does not fill sets the share of all after it
    t = t.withColumn("_share", share).withColumn("_fits", F.col("source_size") * repeats >= F.col("_share") * F.col("weight"))
    level = F.min(F.when(F.col("_fits"), F.struct((F.col("source_size") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), F.col("_share").alias("share")))).over(full)
    t = t.withColumn("_level", level["share"])
    most = (F.col("source_size") * repeats).cast("double")
    target = F.when(F.col("_level").isNull(), most).otherwise(F.least(most, F.col("weight") * F.col("_level")))
    return t.select(*totals.columns, target.alias("target"))


def apportion(rows: DataFrame, by: list[str], weight: str, seats: str, key: str, most: str) -> DataFrame:
    """Adds ``quota``: the seats of each group ``by``, given to its rows by highest quotients weight / (2 s + 1).

    Ties go to the smaller ``key``; no row gets more than ``most``. With n rows
    and T seats a row of exact share x gets between x - x n / 2T - 1/2 and
    x + x n / 2T + 1/2 seats, as the common divisor cannot move further. Only the
    quotients in that range are ranked: about three for each row.
    """
    group = Window.partitionBy(*by)
    share = F.col(weight) * F.col(seats) / F.nullif(F.col("_sum"), F.lit(0.0))
    slack = share * F.col("_n") / F.nullif(2 * F.col(seats), F.lit(0)) + 1
    t = rows.withColumn("_sum", F.sum(F.col(weight).cast("double")).over(group)).withColumn("_n", F.count("*").over(group))
    t = t.withColumn("_low", F.coalesce(F.greatest(F.lit(0), F.floor(share - slack)), F.lit(0)).cast("long"))
    t = t.withColumn("_high", F.coalesce(F.ceil(share + slack), F.lit(0)).cast("long"))
    t = t.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    span = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<bigint>"))
    q = t.select("*", F.explode_outer(span).alias("_s"))
    q = q.withColumn("_rank", F.row_number().over(group.orderBy((F.col(weight) / (2 * F.col("_s") + 1)).desc_nulls_last(), F.col(key).asc_nulls_last(), F.col("_s"))))
    won = F.sum(F.when(F.col("_s").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in rows.columns]
    return q.groupBy(*keep, "_low").agg(won.alias("_won")).select(*keep, F.least(F.col("_low") + F.col("_won"), F.col(most)).cast("long").alias("quota"))


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """What a mix takes of every document: (doc_id, source, size, source_size, target, taken, whole, parts).

    ``taken`` counts words with repeats: ``whole`` times the full text, and the
    words of ``parts`` (start, n) once more.
    Null text has size 0; a null source is a source of its own, last in order; a
    null doc_id is a document like any other. Rows with equal doc_id and size are
    ordered arbitrarily among themselves but get their shares independently.
    An empty table gives an empty table; columns other than doc_id, source and
    text are not read. Reruns give the same rows.
    """
    return _shares(materialize(sizes(docs), "mixing-sizes"), seed, block, repeats)


def _shares(base: DataFrame, seed: int, block: int, repeats: int) -> DataFrame:
    """``mix`` of the written rows (doc_id, source, size), which keep their other columns."""
    own = [c for c in base.columns if c not in ("doc_id", "source", "size")]
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    aims = targets(default_weights(totals), repeats)
    aims = aims.withColumn("_shards", F.ceil(F.col("_docs") / SHARD_DOCS).cast("long"))
    aims = aims.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")).withColumn("_most", (repeats * F.ceil(F.col("source_size") / block)).cast("long"))
    aims = aims.withColumn("_one", F.lit(1))
    aims = apportion(aims, ["_one"], "target", "_seats", "source", "_most").withColumnRenamed("quota", "_source_quota").select("source", "source_size", "target", "_shards", "_source_quota")
    aims = materialize(aims, "mixing-targets")
    dealt = base.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("_key", _seeded(seed, F.col("doc_id"), F.col("size")))
    dealt = dealt.withColumn("_shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.col("_shards")))
    shards = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_source_quota").alias("_source_quota"), F.first("_shards").alias("_shards"))
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / block)).withColumn("_most", repeats * F.col("_blocks"))
    shards = shards.withColumn("_group", F.pmod(F.col("_shard"), F.ceil(F.col("_shards") / GROUP_SHARDS).cast("long"))).drop("_shards")
    groups = shards.groupBy("source", "_group").agg(F.sum("_words").alias("_words"), F.first("_source_quota").alias("_source_quota"), F.sum("_most").alias("_most"))
    groups = apportion(groups, ["source"], "_words", "_source_quota", "_group", "_most").select(F.col("source").alias("_source"), F.col("_group").alias("_g"), F.col("quota").alias("_seats"))
    shards = shards.drop("_source_quota").join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_g"))).drop("_source", "_g")
    quotas = apportion(shards, ["source", "_group"], "_words", "_seats", "_shard", "_most")
    quotas = quotas.select(F.col("source").alias("_source"), F.col("_shard").alias("_s"), "_words", "_blocks", "quota")
    stream = Window.partitionBy("source", "_shard").orderBy("_key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_s")))
    n = F.nullif(F.col("_blocks"), F.lit(0))
    placed = placed.withColumn("whole", F.coalesce(F.floor(F.col("quota") / n), F.lit(0))).withColumn("_extra", F.coalesce(F.col("quota") % n, F.lit(0)))
    first = F.coalesce(F.pmod(F.conv(F.substring(_seeded(seed, F.lit("start"), F.col("source"), F.col("_shard")), 1, 8), 16, 10).cast("long"), n), F.lit(0))
    placed = placed.withColumn("_first", first)

    def overlap(lo: Column, hi: Column) -> Column:
        """Start in the document and number of its words in the stream's words lo .. hi."""
        a = F.greatest(lo, F.col("_at"))
        b = F.least(hi, F.col("_at") + F.col("size"))
        return F.struct((a - F.col("_at")).alias("start"), F.greatest(b - a, F.lit(0)).alias("n"))

    end = F.least((F.col("_first") + F.col("_extra")) * block, F.col("_words"))
    placed = placed.withColumn("_p", overlap(F.col("_first") * block, end))
    placed = placed.withColumn("_q", overlap(F.lit(0), F.greatest(F.col("_first") + F.col("_extra") - F.col("_blocks"), F.lit(0)) * block))
    parts = F.filter(F.array("_q", "_p"), lambda x: x["n"] > 0)
    taken = F.col("whole") * F.col("size") + F.col("_p")["n"] + F.col("_q")["n"]
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("whole").cast("int").alias("whole"), parts.alias("parts"), *own)


#: Stands for a null doc_id in joins.
NOWHERE = -(2**63)


def materialise_mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document comes once for each time that its whole text is taken and once
    for each part; a part's text is its words joined by a space, and n_chars, if
    there, is counted anew. Rows that are equal in all columns (but maps, which
    have no hash) are one document for this, taken as often as the mix takes all of them.
    """
    told = [c for c, t in docs.dtypes if "map<" not in t]
    key = F.xxhash64(*[F.col(f"row.`{c}`") for c in told])
    # whole rows travel as one struct, so that no column of theirs can meet one of these names
    text = F.col("row")["text"]
    rows = docs.select(F.struct("*").alias("row")).select("row", F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(NOWHERE)).alias("place"), key.alias("tkey"))
    base = rows.select(F.col("row")["doc_id"].cast("long").alias("doc_id"), F.col("row")["source"].cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "tkey")
    plan = _shares(materialize(base, "mixing-sizes"), seed, block, repeats)
    plan = plan.where((F.col("whole") > 0) | (F.size("parts") > 0)).select(F.coalesce("doc_id", F.lit(NOWHERE)).alias("p_place"), F.col("tkey").alias("p_tkey"), "size", "whole", "parts")
    # written, so that a row which very often repeats can be split in the join
    plan = materialize(plan, "mixing-plan")
    both = rows.dropDuplicates(["place", "tkey"]).join(plan, (F.col("place") == F.col("p_place")) & (F.col("tkey") == F.col("p_tkey")))
    whole = F.array_repeat(F.struct(F.lit(True).alias("all"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n")), F.col("whole"))
    part = F.transform("parts", lambda p: F.struct((p["n"] == F.col("size")).alias("all"), p["start"].cast("long").alias("start"), p["n"].cast("long").alias("n")))
    takes = both.select("row", F.explode(F.concat(whole, part)).alias("take"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    taken = F.when(F.col("take")["all"], text).otherwise(F.concat_ws(" ", F.slice(words, (F.col("take")["start"] + 1).cast("int"), F.col("take")["n"].cast("int"))))
    out = takes.select(F.col("row").withField("text", taken).alias("row")).select("row.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
