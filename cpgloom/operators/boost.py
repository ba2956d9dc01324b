"""Boosted trees for several classes, grown level by level on histograms.

Each feature is cut into bins once, at its distinct values or, if these are too
many, at quantiles, and packed by thousands of rows. A level is one job: every task
adds up gradients and second derivatives by (class, node, feature, bin) in arrays.
While the arrays of all tasks are few numbers the driver adds them up and finds each
node's best cut; else a shuffle does so node by node, and only one row for each open
node comes to the driver. All labelled cells train. Splits are those of the
published second-order method; cells without a value take the better side. Without
bins every value stays a cut, whatever the cells: gradients are then summed by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.sources import artifacts as A

NODES = "round int, class_idx int, label string, node int, feature int, cut double, missing_left boolean, yes int, no int, value double"
#: Bins of a feature at most; scores are written after so many rounds; numbers of all histograms of a task at most, and of all tasks that the driver adds up.
BINS, KEEP, MOST, MOST_HERE = 256, 8, 1 << 25, 1 << 22
#: Rows that are worth a task of their own, and bytes of a task's rows at most.
ROWS, BYTES = 1 << 15, 1 << 26
_MISSING = 65_535
_BINNED = "y binary, bins binary, score binary"
_SPLIT = "k int, node int, gs double, hs double, best struct<loss:double,f:int,right:boolean,bin:double,next:double,a:double,b:double>"


def _value(c: str) -> Column:
    """A feature as single precision, in double; null if missing."""
    x = F.col(f"`{c}`").cast("float").cast("double")
    return F.when(~F.isnan(x), x)


def bounds(train: DataFrame, columns: list[str], bins: int = BINS) -> list[tuple[np.ndarray, bool]]:
    """For each feature the lower bounds of its bins, and whether they are all its values."""
    guess = train.agg(*[F.approx_count_distinct(_value(c)) for c in columns]).first()
    # a set is collected only where the sketch, which is a few in 100 off, says that it is small
    few = [i for i in range(len(columns)) if guess[i] <= 2 * bins]
    sets = dict(zip(few, train.agg(*[F.array_sort(F.collect_set(_value(columns[i]))) for i in few]).first())) if few else {}
    out = {i: (np.array(v, float), True) for i, v in sets.items() if len(v) <= bins}
    many = [i for i in range(len(columns)) if i not in out]
    if many:
        at = F.array(*[F.lit(k / bins) for k in range(bins)])
        row = train.agg(*[F.percentile_approx(_value(columns[i]), at, 100 * bins) for i in many]).first()
        out |= {i: (np.unique(np.array(v if v is not None else [], float)), False) for i, v in zip(many, row)}
    return [out[i] for i in range(len(columns))]


def _packed(packs: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*packs)], names=["y", "bins", "score"])


def _bin(cuts: list[tuple[np.ndarray, bool]], classes: int, exact: bool):
    """Packs of rows, one for each batch: classes, bins by feature, or with ``exact`` the values themselves, and scores by class."""
    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.full((len(cuts), batch.num_rows), _MISSING, np.uint16) if not exact else np.empty((len(cuts), batch.num_rows))
            for f, (low, _) in enumerate(cuts):
                x = batch.column(1 + f).to_numpy(zero_copy_only=False).astype(float)
                if exact:
                    cells[f] = x
                    continue
                seen = ~np.isnan(x)
                cells[f, seen] = np.maximum(np.searchsorted(low, x[seen], side="right") - 1, 0)
            yield _packed([(batch.column(0).to_numpy().astype(np.int32), cells, np.full((classes, batch.num_rows), 0.5))])

    return bin_rows


def _route(tree: dict, cells: np.ndarray) -> np.ndarray:
    """The node of each row; children have greater numbers than parents."""
    node = np.zeros(cells.shape[1], np.int32)
    for at in sorted(k for k, v in tree.items() if v["feature"] is not None):
        v = tree[at]
        x = cells[v["feature"]]
        left = x <= v["bin"]
        if v["left"]:
            left |= np.isnan(x) if x.dtype.kind == "f" else x == _MISSING
        node = np.where(node == at, 2 * at + 2 - left.astype(np.int32), node)
    return node


def _leaf_values(tree: dict, node: np.ndarray) -> np.ndarray:
    values = np.zeros(max(tree) + 1)
    for at, v in tree.items():
        if v["feature"] is None:
            values[at] = v["value"]
    return values[node]


def _read(batches: Iterator[pa.RecordBatch], features: int, classes: int, later: list[list[dict]], exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, bins by feature, scores by class) of each pack, with the trees that its scores don't hold yet."""
    for batch in batches:
        for y, cells, score in zip(*batch.columns):
            cells = np.frombuffer(cells.as_buffer(), float if exact else np.uint16).reshape(features, -1)
            score = np.frombuffer(score.as_buffer()).reshape(classes, -1).copy()
            for own in later:
                for k, tree in enumerate(own):
                    score[k] += _leaf_values(tree, _route(tree, cells))
            yield np.frombuffer(y.as_buffer(), np.int32), cells, score


def _probabilities(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(0))
    return p / p.sum(0)


def _histograms(sent, features: int, classes: int, some: list[int], bins: int):
    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, grown = sent.value
        open_ = {k: sorted(at for at, v in grown[k].items() if v["open"]) for k in some}
        total = {k: np.zeros((2, len(v) * features * (bins + 1))) for k, v in open_.items() if v}
        for y, cells, score in _read(batches, features, classes, later):
            p, x = _probabilities(score), np.where(cells == _MISSING, bins, cells).astype(np.int64)
            for k, sums in total.items():
                place = np.full(max(open_[k]) + 1, -1)
                place[open_[k]] = np.arange(len(open_[k]))
                node = _route(grown[k], cells)
                own = np.where(node < len(place), place[np.minimum(node, len(place) - 1)], -1)
                here = np.flatnonzero(own >= 0)
                own_p = p[k, here]
                g, h = own_p - (y[here] == k), np.maximum(2 * own_p * (1 - own_p), 1e-16)
                base, added = own[here] * (bins + 1), sums.reshape(2, -1, features, bins + 1)
                for f in range(features):
                    at = base + (x[f] if len(here) == len(y) else x[f][here])
                    for s, values in enumerate((g, h)):
                        added[s, :, f] += np.bincount(at, values, added.shape[1] * (bins + 1)).reshape(-1, bins + 1)
        for k, sums in total.items():
            g, h = (x.reshape(-1, features, bins + 1) for x in sums)
            for i, node in enumerate(open_[k]):
                f = np.flatnonzero(h[i].any(1))
                columns = [np.full(len(f), k, np.int32), np.full(len(f), node, np.int32), f.astype(np.int32)]
                columns = [pa.array(c) for c in columns] + [pa.array([v.tobytes() for v in x[i, f]], pa.binary()) for x in (g, h)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "node", "f", "g", "h"])

    return histograms


def _best_cut(g: np.ndarray, h: np.ndarray, gs: float, hs: float, ridge: float, least: float) -> tuple | None:
    """(loss, feature, right, bin, next, a, b) of the best cut of features' sums by bin, the last place being missing values; the order is that of ``best_splits``."""
    there = h[:, :-1] > 0
    # bins with values, but for each feature's last one
    there &= there[:, ::-1].cumsum(1)[:, ::-1] > 1
    if hs < 2 * least or not there.any():
        return None
    gl, hl = g[:, :-1].cumsum(1), h[:, :-1].cumsum(1)
    a, b = (np.stack([s + x[:, -1:], s], 1) for s, x in ((gl, g), (hl, h)))
    able = there[:, None] & (b >= least) & (hs - b >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a**2 / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs**2 / (hs + ridge)
    gain = np.where(able & (gain > 1e-6), np.round(gain, 9), -1.0)
    f, right, i = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, right, i] < 0:
        return None
    after = i + 1 + int((h[f, i + 1 : -1] > 0).argmax())
    return -float(gain[f, right, i]), int(f), bool(right), float(i), float(after), float(a[f, right, i]), float(b[f, right, i])


def _best_of_nodes(ridge: float, least: float):
    """Adds up the tasks' histograms of a feature as they pass, sorted by class, node and feature, and finds each node's best cut."""
    kinds = pa.struct([("loss", pa.float64()), ("f", pa.int32()), ("right", pa.bool_()), ("bin", pa.float64()), ("next", pa.float64()), ("a", pa.float64()), ("b", pa.float64())])

    def end(own: tuple[int, int], sums: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        g, h = (np.stack(x) for x in zip(*sums.values()))
        whole = float(g[0].sum()), float(h[0].sum())
        cut = _best_cut(g, h, *whole, ridge, least)
        found = None if cut is None else dict(zip(kinds.names, (cut[0], [*sums][cut[1]], *cut[2:])))
        return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([whole[0]]), pa.array([whole[1]]), pa.array([found], kinds)], names=["k", "node", "gs", "hs", "best"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = None, {}
        for batch in batches:
            # sums are read where they are
            for k, node, f, g, h in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:]):
                g, h = np.frombuffer(g.as_buffer()), np.frombuffer(h.as_buffer())
                if (k, node) != own:
                    if own is not None:
                        yield end(own, sums)
                    own, sums = (k, node), {}
                if f in sums:
                    sums[f][0] += g
                    sums[f][1] += h
                else:
                    sums[f] = [g.copy(), h.copy()]
        if own is not None:
            yield end(own, sums)

    return best


def _by_value(sent, features: int, classes: int, some: list[int], quantiles: list[np.ndarray]):
    """(k, node, f, part, bin, g, h) of each row, open node and feature; bin is the value, part its place among the quantiles."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, grown = sent.value
        for y, cells, score in _read(batches, features, classes, later, True):
            p = _probabilities(score)
            parts = [np.searchsorted(q, cells[f], side="right").astype(np.int32) for f, q in enumerate(quantiles)]
            for k in some:
                node = _route(grown[k], cells)
                here = np.flatnonzero(np.isin(node, [at for at, v in grown[k].items() if v["open"]]))
                own_p = p[k, here]
                g, h = own_p - (y[here] == k), np.maximum(2 * own_p * (1 - own_p), 1e-16)
                for f in range(features):
                    columns = [pa.array(np.full(len(here), k, np.int32)), pa.array(node[here].astype(np.int32)), pa.array(np.full(len(here), f, np.int32)), pa.array(parts[f][here]), pa.array(cells[f, here], from_pandas=True), pa.array(g), pa.array(h)]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "node", "f", "part", "bin", "g", "h"])

    return values


def best_splits(sums: DataFrame, ridge: float = 1.0, least: float = 1.0) -> DataFrame:
    """(k, node, gs, hs, best) from (k, node, f, part, bin, g, h), a null bin being missing values: each node's sums and its best cut, null if none gains.

    Of cuts whose gains agree to nine digits the first feature's counts, then missing to the left, then the lowest cut.
    Values are added up within parts, in whose order they are, and parts are shifted by the sums before them: no task has a feature's values whole.
    """
    keys = ["k", "node", "f"]
    there, absent = F.col("bin").isNotNull(), F.col("bin").isNull()

    def added(c: str, rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, F.col(c))), F.lit(0.0))

    parts = sums.groupBy(*keys, F.when(there, F.col("part")).alias("part")).agg(*[added(c, rows).alias(f"{c}{n}") for c in "gh" for n, rows in (("m", absent), ("t", there))], F.min("bin").alias("low"))
    own = Window.partitionBy(*keys)
    before, after = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), own.orderBy("part")
    parts = parts.select(*keys, "part", *[(F.sum(f"{c}m").over(own) + F.sum(f"{c}t").over(own)).alias(f"{c}s") for c in "gh"], *[F.sum(f"{c}m").over(own).alias(f"{c}m") for c in "gh"], *[F.coalesce(F.sum(f"{c}t").over(before), F.lit(0.0)).alias(f"{c}b") for c in "gh"], F.lead("low").over(after).alias("after"))
    up = Window.partitionBy(*keys, "part").orderBy("bin")
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sums.where(there).select(*keys, "part", "bin", F.sum("g").over(so_far).alias("gl"), F.sum("h").over(so_far).alias("hl"), F.lead("bin").over(up).alias("next"))
    # new names for the columns of the sums tell the two sides apart
    parts = parts.select(*[F.col(c).alias(c) for c in parts.columns])
    whole = parts.groupBy("k", "node").agg(F.min(F.struct("f", "part", "gs", "hs")).alias("w")).select("k", "node", "w.gs", "w.hs")
    rows = rows.join(F.broadcast(parts), [*keys, "part"]).withColumn("next", F.coalesce("next", "after"))
    rows = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("left"))
    rows = rows.withColumn("a", F.col("gb") + F.col("gl") + F.when(F.col("left"), F.col("gm")).otherwise(0.0)).withColumn("b", F.col("hb") + F.col("hl") + F.when(F.col("left"), F.col("hm")).otherwise(0.0))
    gain = F.pow("a", 2) / (F.col("b") + ridge) + F.pow(F.col("gs") - F.col("a"), 2) / (F.col("hs") - F.col("b") + ridge) - F.pow("gs", 2) / (F.col("hs") + ridge)
    able = F.col("next").isNotNull() & (F.col("hs") >= 2 * least) & (F.col("b") >= least) & (F.col("hs") - F.col("b") >= least) & (gain > 1e-6)
    cut = F.struct((-F.round(gain, 9)).alias("loss"), "f", (~F.col("left")).alias("right"), "bin", "next", "a", "b")
    best = rows.where(able).groupBy("k", "node").agg(F.min(cut).alias("best"))
    return whole.join(best, ["k", "node"], "left")


def _kept(rows: DataFrame) -> RDD:
    """The packs as batches that Spark keeps between levels: a level's job then takes half the time of one that is planned and reads files."""
    return rows.rdd.map(lambda r: pa.RecordBatch.from_arrays([pa.array([bytes(v)], pa.binary()) for v in r], names=["y", "bins", "score"])).persist(StorageLevel.MEMORY_AND_DISK)


def _scored(sent, features: int, classes: int, exact: bool):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _read(batches, features, classes, sent.value, exact):
            yield _packed([pack])

    return scored


def fit_boosted(train: DataFrame, columns: list[str], rounds: int | None = None, depth: int = 6, eta: float = 0.3, ridge: float = 1.0, least: float = 1.0, bins: int | None = BINS) -> DataFrame:
    """Boosted trees as a table of nodes (round, class_idx, label, node, feature, cut, missing_left, yes, no, value), which ``artifacts`` can keep.

    ``train`` is wide: label and one column for each pattern; rows without a label
    take no part, and a table without labelled rows gives no nodes. Rounds are by
    default the rounded square root of the cells. Without ``bins`` every value is a
    cut, however many there are. Fewer than two classes are an error.
    """
    spark = train.sparkSession
    train = train.where(F.col("label").isNotNull())
    counts = train.groupBy("label").count().orderBy("label").collect()  # one row for each class
    labels, cells = [r["label"] for r in counts], sum(r["count"] for r in counts)
    if not labels:
        return spark.createDataFrame([], NODES)
    if len(labels) < 2:
        raise ValueError("need at least two classes")
    classes, features = len(labels), len(columns)
    exact = bins is None
    cuts = bounds(train, columns, BINS if exact else bins)
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    parts = max(min(-(-cells // ROWS), spark.sparkContext.defaultParallelism), -(-cells * (features * (8 if exact else 2) + 8 * classes + 4) // BYTES))
    wide = train.select(index.cast("int").alias("y"), *[_value(c).alias(f"c{i}") for i, c in enumerate(columns)]).repartition(parts)
    rows = A.stage(wide.mapInArrow(_bin(cuts, classes, exact), _BINNED), "boosted-rows")
    out: list[tuple] = []
    later: list[list[dict]] = []
    kept = None
    for t in range(rounds or max(1, int(cells**0.5 + 0.5))):
        grown: list[dict] = [{0: {"feature": None, "open": True, "value": 0.0}} for _ in labels]
        for level in range(depth + 1):
            open_ = sum(v["open"] for tree in grown for v in tree.values())
            if not open_ or level == depth and depth:
                break
            # as many classes in a job as a task has room for
            widest = 0 if exact else 2 * features * (bins + 1) * max(sum(v["open"] for v in tree.values()) for tree in grown)
            most = classes if exact else max(1, MOST // max(widest, 1))
            found = []
            for a in range(0, classes, most):
                sent, some = spark.sparkContext.broadcast((later, grown)), list(range(a, min(a + most, classes)))
                if exact:
                    sums = rows.mapInArrow(_by_value(sent, features, classes, some, [low for low, _ in cuts]), "k int, node int, f int, part int, bin double, g double, h double")
                    sums = A.stage(sums.groupBy("k", "node", "f", "part", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")), "boosted-sums")
                    found += best_splits(sums, ridge, least).collect()  # one row for each open node
                    A.discard(sums)
                else:
                    histograms = _histograms(sent, features, classes, some, bins)
                    if parts * widest * len(some) <= MOST_HERE:
                        kept = kept or _kept(rows)
                        by_node = pa.Table.from_batches(kept.mapPartitions(histograms).collect()).sort_by([(c, "ascending") for c in ("k", "node", "f")])
                        found += [r for b in _best_of_nodes(ridge, least)(iter(by_node.to_batches())) for r in b.to_pylist()]
                    else:
                        sums = rows.mapInArrow(histograms, "k int, node int, f int, g binary, h binary")
                        sums = sums.repartition("k", "node").sortWithinPartitions("k", "node", "f")
                        found += sums.mapInArrow(_best_of_nodes(ridge, least), _SPLIT).collect()  # one row for each open node
                sent.unpersist()
            for r in found:
                tree, at, best = grown[r["k"]], r["node"], r["best"]
                tree[at] = {"feature": None, "open": False, "value": -eta * r["gs"] / (r["hs"] + ridge)}
                if best is None or not depth:
                    continue
                low, all_values = cuts[best["f"]]
                low = {v: v for v in (best["bin"], best["next"])} if exact else {v: low[int(v)] for v in (best["bin"], best["next"])}
                cut = (low[best["bin"]] + low[best["next"]]) / 2 if exact or all_values else low[best["next"]]
                tree[at] = {"feature": best["f"], "open": False, "bin": best["bin"], "left": not best["right"], "cut": float(cut)}
                for child, g, h in ((2 * at + 1, best["a"], best["b"]), (2 * at + 2, r["gs"] - best["a"], r["hs"] - best["b"])):
                    tree[child] = {"feature": None, "open": True, "value": -eta * g / (h + ridge)}
        later.append(grown)
        for k, tree in enumerate(grown):
            for at, v in sorted(tree.items()):
                inner = v["feature"] is not None
                out.append((t, k, str(labels[k]), at, *((v["feature"], v["cut"], v["left"], 2 * at + 1, 2 * at + 2, None) if inner else (None, None, None, None, None, v["value"]))))
        if len(later) == KEEP:
            old, sent = rows, spark.sparkContext.broadcast(later)
            rows, later = A.stage(old.mapInArrow(_scored(sent, features, classes, exact), _BINNED), "boosted-rows"), []
            if kept is not None:
                kept.unpersist()
                kept = None
            A.discard(old)
    if kept is not None:
        kept.unpersist()
    A.discard(rows)
    return spark.createDataFrame(out, NODES)


def predict_boosted(model: DataFrame, query: DataFrame, columns: list[str], probs: bool = False) -> DataFrame:
    """(cell_id, label, confidence[, probs]) of wide ``query`` rows by a model of ``fit_boosted``; ``probs`` has a probability for each class in order.

    The model is a bounded number of trees; every task gets them. Without a model labels are null.
    """
    rows = model.select(*[x.split()[0] for x in NODES.split(", ")]).collect()
    schema = "cell_id long, label string, confidence double" + (", probs array<double>" if probs else "")
    if not rows:
        return query.select("cell_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])])
    names = [r[1] for r in sorted({(r["class_idx"], r["label"]) for r in rows})]
    trees: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault((r["round"], r["class_idx"]), {})[r["node"]] = tuple(r[4:])

    def score(x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), len(names)), 0.5)
        for (_, k), tree in sorted(trees.items()):
            node = np.zeros(len(x), np.int64)
            for at in sorted(tree):  # children come after their parents
                f, cut, left, yes, no, value = tree[at]
                here = np.flatnonzero(node == at)
                if f is None:
                    out[here, k] += value
                else:
                    v = x[here, f]
                    node[here] = np.where(np.where(np.isnan(v), left, v < cut), yes, no)
        return out

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            s = score(df[columns].to_numpy(dtype=np.float32).astype(float)) if len(df) else np.zeros((0, len(names)))
            p = np.exp(s - s.max(1, keepdims=True)) if len(df) else s
            p = p / p.sum(1, keepdims=True)
            best = p.shape[1] - 1 - p[:, ::-1].argmax(1) if len(df) else []
            entropy = -(p * np.log(p + 1e-10)).sum(1)
            confidence = np.clip(1 - entropy / np.log(len(names)), 0, 1) if len(names) > 1 else np.ones(len(df))
            out = pd.DataFrame({"cell_id": df["cell_id"], "label": [str(names[i]) for i in best], "confidence": confidence})
            yield out.assign(probs=p.tolist()) if probs else out

    return query.select("cell_id", *columns).mapInPandas(apply, schema)
