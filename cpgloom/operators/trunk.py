"""Training of the residual trunk that all units share, with a head for each pattern and an embedding for each CpG.

CpGs are cut into blocks by position. In a round every block starts from the
shared weights (trunk and pattern heads), takes its steps on its own drawn
batches, and keeps its own CpGs' embeddings; then the shared weights of all
blocks are averaged (the published scheme of local steps with averaging).

Blocks are dealt to a fixed number of tasks. A task reads the shared weights
once, works through its blocks one after another, and adds up their weights, so
what a round moves is two models for each task, however many blocks there are;
the tasks' sums meet in a tree of two levels, piece by piece. The model is a table of
pieces and never comes to the driver. Each round is kept until the next one is
whole, and a run that was stopped goes on from there.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.operators import train as T
from cpgloom.operators.upscale import trunk
from cpgloom.sources import artifacts as A
from cpgloom.sources.artifacts import stage

#: Numbers of the shared weights that are averaged in one group.
PIECE = 8192
STATE = "unit int, cpgs array<long>, groups array<int>, net binary, sse double, sae double, n long"
#: What comes to a task, in this order: the shared weights, then for each block its state and its rows.
SHARED, BLOCK, ROW = 0, 1, 2
FROM_TASK = "kind int, task int, at int, piece binary, " + STATE
ROWS = "unit int, split string, step int, cell_id long, rep int, local array<int>, y array<double>, x array<double>, round int"


@dataclass(frozen=True)
class Options:
    """``steps`` are those of a block in a round; ``fraction`` of a batch comes from the CpGs of ``easy`` groups (from 1 on), if there are any.

    ``tasks`` is how many tasks a round's blocks are dealt to, 0 for as many as shuffle partitions.
    """

    patterns: int = 1000
    hidden: int = 512
    rank: int = 16
    rounds: int = 100
    steps: int = 20
    batch: int = 1024
    checks: int = 4
    easy: tuple[int, ...] = ()
    fraction: float = 0.1
    lr: float = 3e-4
    decay: float = 1e-5
    seed: int = 1
    block: int = 65_536
    tasks: int = 0


def places(members: DataFrame, options: Options) -> DataFrame:
    """(unit, dest, cpg_idx, group): the CpGs of the first ``patterns`` ranks, in blocks of positions; ``members`` is (cpg_idx, rank)."""
    rows = members.where(F.col("rank") < options.patterns)
    return rows.select(F.floor(F.col("cpg_idx") / options.block).cast("int").alias("unit"), F.col("cpg_idx").alias("dest"), "cpg_idx", F.col("rank").cast("int").alias("group"))


def check(placed: DataFrame, options: Options) -> None:
    """Options that don't fit the CpGs are an error: no active CpG, a batch above all of them, easy groups out of range or twice, or none or all CpGs easy."""
    easy = [g for g in options.easy]
    if any(not 1 <= g <= options.patterns for g in easy) or len(set(easy)) != len(easy):
        raise ValueError("easy groups must be different ones from 1 to the number of patterns")
    if not 0 <= options.fraction <= 1 or min(options.patterns, options.hidden, options.rank, options.steps, options.batch, options.block) < 1 or options.rounds < 0:
        raise ValueError("sizes must be 1 or more and the fraction a share")
    found = placed.agg(F.count("*").alias("n"), F.count_if(F.col("group").isin([g - 1 for g in easy])).alias("easy")).first()
    if not found["n"]:
        raise ValueError("no active CpG")
    if options.batch > found["n"]:
        raise ValueError("the batch is larger than all active CpGs")
    if easy and not 0 < found["easy"] < found["n"]:
        raise ValueError("the easy groups leave a stratum empty")


def batches(placed: DataFrame, codes: DataFrame, sampled: DataFrame, split: DataFrame, reps: int, options: Options) -> DataFrame:
    """(unit, split, step, cell_id, rep, local, y): the drawn batches of each block, of easy and other CpGs in their shares."""
    units = placed.select("unit").distinct().withColumn("output_offset", F.col("unit").cast("long") * options.block)
    draw = T.Options(batch=options.batch, max_steps=options.rounds * options.steps, checks=options.checks, seed=options.seed)
    held = stage(T.held(codes, placed, units), "trunk-held")
    drawn = stage(T.schedule(held.select("unit", "cell_id").join(split, "cell_id"), reps, draw), "trunk-drawn")
    observed = T.seen(sampled, placed, units)
    if not options.easy:
        return T.batches(drawn, held, observed, draw)
    share = int(options.batch * options.fraction + 0.5)
    easy = F.col("group").isin([g - 1 for g in options.easy])
    pools = [T.batches(drawn, T.held(codes, placed.where(pool), units), observed, replace(draw, batch=size)) for pool, size in ((easy, share), (~easy, options.batch - share)) if size]
    both = pools[0] if len(pools) == 1 else pools[0].unionByName(pools[1])
    both = both.groupBy("unit", "split", "step", "cell_id", "rep").agg(F.collect_list(F.struct("local", "y")).alias("v"))
    return both.select("unit", "split", "step", "cell_id", "rep", F.flatten("v.local").alias("local"), F.flatten("v.y").alias("y"))


def shapes(width: int, options: Options) -> dict[str, tuple[int, ...]]:
    h, zs = options.hidden, options.patterns * options.rank
    return {"w1": (h, width), "b1": (h,), "w2": (h, h), "b2": (h,), "heads": (zs, h), "head_bias": (zs,)}


def unpack(flat: np.ndarray, width: int, options: Options) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(width, options).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(width: int, options: Options) -> np.ndarray:
    """The shared weights as one row: uniform within the usual bound of each layer, biases 0."""
    rng = np.random.default_rng(options.seed)
    bounds = {"w1": 6 / (width + options.hidden), "w2": 6 / (2 * options.hidden), "heads": 6 / (options.hidden + options.rank)}
    parts = [rng.uniform(-np.sqrt(bounds[k]), np.sqrt(bounds[k]), int(np.prod(s))) if k in bounds else np.zeros(int(np.prod(s))) for k, s in shapes(width, options).items()]
    return np.concatenate(parts)


def forward(net: dict, own: dict, groups: np.ndarray, x: np.ndarray, at: np.ndarray, rank: int) -> tuple[np.ndarray, ...]:
    """(p, z, top, s, h): predictions of one batch, and the layers below them."""
    h = net["w1"] @ x + net["b1"]
    h = np.where(h > 0, h, 0.01 * h)
    s = net["w2"] @ h + net["b2"]
    top = h + np.where(s > 0, s, 0.01 * s)
    z = (net["heads"] @ top + net["head_bias"]).reshape(-1, rank)
    p = 1 / (1 + np.exp(-np.clip((own["E"][at] * z[groups[at]]).sum(1) + own["b"][at], -700, 700)))
    return p, z, top, s, h


def slopes(net: dict, own: dict, groups: np.ndarray, x: np.ndarray, at: np.ndarray, y: np.ndarray, rank: int) -> tuple[np.ndarray, dict, dict]:
    """Predictions of one batch, and the gradients of its mean squared error in the shared weights and in the block's own (E, b)."""
    p, z, top, s, h = forward(net, own, groups, x, at, rank)
    of = groups[at]
    d = 2 * (p - y) * p * (1 - p) / len(y)
    dz, de, db = np.zeros_like(z), np.zeros_like(own["E"]), np.zeros_like(own["b"])
    np.add.at(dz, of, d[:, None] * own["E"][at])
    np.add.at(de, at, d[:, None] * z[of])
    np.add.at(db, at, d)
    dtop = net["heads"].T @ dz.ravel()
    ds = dtop * np.where(s > 0, 1.0, 0.01)
    dh = (net["w2"].T @ ds + dtop) * np.where(h > 0, 1.0, 0.01)
    shared = {"w1": np.outer(dh, x), "b1": dh, "w2": np.outer(ds, h), "b2": ds, "heads": np.outer(dz.ravel(), top), "head_bias": dz.ravel()}
    return p, shared, {"E": de, "b": db}


def _adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, lr: float) -> None:
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def start(placed: DataFrame, bias: DataFrame, options: Options) -> DataFrame:
    """The blocks before training: embeddings within 0.02, biases at the CpGs' prior, no moments yet."""
    rows = placed.join(bias.select("cpg_idx", "logit"), "cpg_idx").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("cpg_idx", "group", "logit"))).alias("v"))

    def make(batches):
        for df in batches:
            for r in df.itertuples():
                e = np.random.default_rng([options.seed, int(r.unit)]).uniform(-0.02, 0.02, (len(r.cpgs), options.rank))
                net = np.zeros((3, len(r.cpgs), options.rank + 1))
                net[0, :, :-1], net[0, :, -1] = e, r.logit
                yield pd.DataFrame({"unit": [r.unit], "cpgs": [r.cpgs], "groups": [r.groups], "net": [net.tobytes()], "sse": [0.0], "sae": [0.0], "n": [0]})

    return rows.select("unit", F.col("v.cpg_idx").alias("cpgs"), F.col("v.group").alias("groups"), F.col("v.logit").alias("logit")).mapInPandas(make, STATE)


def _pieces(numbers: np.ndarray) -> list[bytes]:
    return [numbers[i : i + PIECE].tobytes() for i in range(0, len(numbers), PIECE)]


def _first(spark: SparkSession, width: int, options: Options) -> DataFrame:
    """(at, piece): the shared weights as drawn, and their moments, all 0."""
    def make(batches):
        for df in batches:
            flat = initial(width, options)
            for at, piece in enumerate(_pieces(np.concatenate([flat, np.zeros(2 * len(flat))])) if len(df) else ()):
                yield pd.DataFrame({"at": [at], "piece": [piece]})

    return spark.range(1, numPartitions=1).mapInPandas(make, "at int, piece binary")


class _Block:
    """The training of one block in one round."""

    def __init__(self, state, flat: np.ndarray, width: int, options: Options):
        self.options, self.unit = options, int(state.unit)
        self.cpgs, self.groups = np.asarray(state.cpgs), np.asarray(state.groups)
        self.net = np.frombuffer(state.net).reshape(3, len(self.cpgs), options.rank + 1).copy()
        self.e, self.b = self.net[:, :, :-1], self.net[:, :, -1]
        self.flat, self.learned, self.off = flat.copy(), 0, []
        self.weights = [unpack(x, width, options) for x in self.flat]

    def take(self, r) -> None:
        """One row: a step, or a validation row after all steps."""
        o, own = self.options, {"E": self.e[0], "b": self.b[0]}
        at = np.searchsorted(self.cpgs, np.asarray(r.local, dtype=np.int64) + self.unit * o.block)
        x, y = np.asarray(r.x, float), np.asarray(r.y, float)
        if r.split == "val":
            self.off.append(forward(self.weights[0], own, self.groups, x, at, o.rank)[0] - y)
            return
        self.learned += 1
        _, shared, mine = slopes(self.weights[0], own, self.groups, x, at, y, o.rank)
        w, m, v = self.weights
        for name, value in shared.items():
            kept = 0 if name in ("b1", "b2", "head_bias") else o.decay * w[name]
            _adam(w[name], m[name], v[name], value + kept, r.step, o.lr)
        # only the CpGs of the batch move; their moments are corrected by the step's number, as the shared ones
        hit = np.unique(at)
        for part, grad, decay in ((self.e, mine["E"], o.decay), (self.b, mine["b"], 0.0)):
            w, m, v = (part[i][hit] for i in range(3))
            _adam(w, m, v, grad[hit] + decay * w, r.step, o.lr)
            part[0][hit], part[1][hit], part[2][hit] = w, m, v

    def row(self) -> pd.DataFrame:
        off = np.concatenate(self.off) if self.off else np.zeros(0)
        return pd.DataFrame({"kind": [BLOCK], "task": [None], "at": [None], "piece": [None], "unit": [self.unit], "cpgs": [self.cpgs], "groups": [self.groups], "net": [self.net.tobytes()], "sse": [float((off**2).sum())], "sae": [float(np.abs(off).sum())], "n": [len(off)]}).astype({"task": "Int32", "at": "Int32"})


def _round(width: int, options: Options):
    """A task's blocks one after another, and the sum of the weights of those that took a step."""
    def run(batches):
        task, pieces, block, flat, total, n = None, [], None, None, None, 0

        def end_block():
            nonlocal block, total, n
            if block is not None:
                if block.learned:
                    total = block.flat if total is None else np.add(total, block.flat, out=total)
                    n += 1
                yield block.row()
                block = None

        def end_task():
            nonlocal pieces, flat, total, n
            yield from end_block()
            if n:
                for at, piece in enumerate(_pieces(total.ravel())):
                    yield pd.DataFrame({"kind": [SHARED], "task": [task], "at": [at], "piece": [piece], "unit": [None], "cpgs": [None], "groups": [None], "net": [None], "sse": [None], "sae": [None], "n": [n]}).astype({"unit": "Int32", "sse": "float64", "sae": "float64"})
            pieces, flat, total, n = [], None, None, 0

        for df in batches:
            for r in df.itertuples():
                if r.task != task:
                    yield from end_task()
                    task = r.task
                if r.kind == SHARED:
                    pieces.append(r.piece)
                elif r.kind == BLOCK:
                    yield from end_block()
                    if flat is None:
                        flat, pieces = np.frombuffer(b"".join(pieces)).reshape(3, -1), []
                    block = _Block(r, flat, width, options)
                elif block is not None and block.unit == r.unit:
                    block.take(r)
        yield from end_task()

    return run


def _added(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("task")  # one order of summands, whatever order they come in
    return pd.DataFrame({"task": df["task"].iloc[:1], "at": df["at"].iloc[:1], "piece": [sum(np.frombuffer(p) for p in df["piece"]).tobytes()], "n": [df["n"].sum()]})


def _mean(df: pd.DataFrame) -> pd.DataFrame:
    """The mean of a piece over all blocks that learned; the last round's piece (of n 0) if there are none."""
    new = df[df["n"] > 0].sort_values("task")
    piece = (sum(np.frombuffer(p) for p in new["piece"]) / new["n"].sum()).tobytes() if len(new) else df["piece"].iloc[0]
    return pd.DataFrame({"at": df["at"].iloc[:1], "piece": [piece]})


def averaged(sums: DataFrame, last: DataFrame, tasks: int) -> DataFrame:
    """(at, piece): means of the tasks' sums (task, at, piece, n), by groups of about the square root of the tasks, then of these."""
    some = max(int(tasks**0.5), 1)
    first = sums.groupBy("at", F.pmod("task", F.lit(some)).alias("group")).applyInPandas(_added, "task int, at int, piece binary, n long")
    both = first.unionByName(last.select(F.lit(-1).alias("task"), "at", "piece", F.lit(0).cast("long").alias("n")))
    return both.groupBy("at").applyInPandas(_mean, "at int, piece binary")


def _dealt(rows: DataFrame, blocks: DataFrame, shared: DataFrame, tasks: int) -> DataFrame:
    """Everything that a round's tasks take, in their order."""
    of = F.pmod("unit", F.lit(tasks)).alias("task")
    parts = [
        shared.select(F.lit(SHARED).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "at", "piece"),
        blocks.select(F.lit(BLOCK).alias("kind"), of, "unit", "cpgs", "groups", "net"),
        rows.select(F.lit(ROW).alias("kind"), of, "unit", "split", "step", "x", "local", "y"),
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.repartition(tasks, "task").sortWithinPartitions("task", F.col("kind") != SHARED, "unit", "kind", "at", "split", "step")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a kept round."""
    return spark.read.schema(FROM_TASK).parquet(f"{path}/blocks").where(F.col("kind") == BLOCK).select(*[c.split()[0] for c in STATE.split(", ")])


def _advance(rows: DataFrame, path: str, k: int, width: int, options: Options, tasks: int) -> None:
    """Round ``k`` from the kept round before it; whole when its weights are."""
    spark, here, last = rows.sparkSession, f"{path}/round-{k}", f"{path}/round-{k - 1}"
    A.remove(spark, here)  # what a stopped run left of it
    shared = spark.read.schema("at int, piece binary").parquet(f"{last}/weights")
    blocks = _kept(spark, last)
    _dealt(rows, blocks, shared, tasks).mapInPandas(_round(width, options), FROM_TASK).write.partitionBy("kind").parquet(f"{here}/blocks")
    done = spark.read.schema(FROM_TASK).parquet(f"{here}/blocks")
    score = done.where(F.col("kind") == BLOCK).agg(F.sum("sse").alias("sse"), F.sum("sae").alias("sae"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    score.select(F.lit(k).alias("round"), F.sqrt(F.try_divide("sse", "n")).alias("rmse"), F.try_divide("sae", "n").alias("mae"), "n").write.mode("overwrite").parquet(f"{path}/scores/round-{k}")
    averaged(done.where(F.col("kind") == SHARED).select("task", "at", "piece", "n"), shared, tasks).write.parquet(f"{here}/weights")
    # the round is whole: nothing reads its sums or the round before it any more
    A.remove(spark, f"{here}/blocks/kind={SHARED}")
    A.remove(spark, last)


def train(rows: DataFrame, inputs: DataFrame, blocks: DataFrame, width: int, options: Options, path: str | None = None, data: str = "") -> dict[str, DataFrame]:
    """Tables that ``artifacts`` can keep: ``trunk`` (one row of arrays), ``sites`` (unit, cpgs, groups, E, b) and ``scores`` (round, rmse, mae, n).

    ``rows`` are ``batches``, ``inputs`` (rep, cell_id, x) with x of ``width``
    numbers, ``blocks`` those of ``start``. Rows are written once, by round, and a
    round reads its own. Under ``path`` (default: a new folder) the last whole
    round is kept, and a call with the same ``path`` goes on after it; a folder of
    other options, another width or another ``data`` (a key of the tables that the
    rows are made from, as ``train.content`` gives it) is an error. Without any
    training row the weights stay as drawn.
    """
    spark = rows.sparkSession
    path = path or A.scratch(spark, "trunk")
    tasks = options.tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    run = hashlib.md5(repr((sorted(asdict(options).items()), tasks, width, data)).encode()).hexdigest()
    if A.finished(spark, f"{path}/run"):
        found = spark.read.parquet(f"{path}/run").first()["run"]
        if found != run:
            raise ValueError("the folder holds a run with other options or data")
    else:
        spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{path}/run")
    whole = [k for k in range(options.rounds + 1) if A.finished(spark, f"{path}/round-{k}/weights")]
    if not whole:
        blocks.select(F.lit(BLOCK).alias("kind"), *blocks.columns).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/round-0/blocks")
        _first(spark, width, options).write.mode("overwrite").parquet(f"{path}/round-0/weights")
    if not A.finished(spark, f"{path}/rows"):
        own = F.when(F.col("split") == "val", 0).otherwise(F.floor((F.col("step") - 1) / options.steps).cast("int") + 1)
        full = rows.join(inputs.select("rep", "cell_id", "x"), ["rep", "cell_id"]).withColumn("round", own)
        full.repartition("round", F.pmod("unit", F.lit(tasks))).write.mode("overwrite").partitionBy("round").parquet(f"{path}/rows")
    full = spark.read.schema(ROWS).parquet(f"{path}/rows")
    for k in range(max(whole, default=0) + 1, options.rounds + 1):
        _advance(full.where(F.col("round").isin(0, k)), path, k, width, options, tasks)
    return tables(spark, path, options.rounds, width, options)


def tables(spark: SparkSession, path: str, k: int, width: int, options: Options) -> dict[str, DataFrame]:
    """The tables of ``train`` from its kept round ``k``."""
    names = list(shapes(width, options))

    def joined(df: pd.DataFrame) -> pd.DataFrame:
        flat = np.frombuffer(b"".join(df.sort_values("at")["piece"])).reshape(3, -1)[0]
        net = unpack(flat, width, options)
        return pd.DataFrame({"n_input": [width], "hidden": [options.hidden], "rank": [options.rank], "patterns": [options.patterns], **{c: [net[c].ravel()] for c in names}})

    def split(batches):
        for df in batches:
            for r in df.itertuples():
                own = np.frombuffer(r.net).reshape(3, len(r.cpgs), -1)[0]
                yield pd.DataFrame({"unit": [r.unit], "cpgs": [r.cpgs], "groups": [r.groups], "E": [own[:, :-1].ravel()], "b": [own[:, -1].copy()]})

    pieces = spark.read.schema("at int, piece binary").parquet(f"{path}/round-{k}/weights")
    state = _kept(spark, f"{path}/round-{k}")
    # one model, of a size set by the options
    model = pieces.groupBy().applyInPandas(joined, "n_input int, hidden int, rank int, patterns int, " + ", ".join(f"{c} array<double>" for c in names))
    sites = state.mapInPandas(split, "unit int, cpgs array<long>, groups array<int>, E array<double>, b array<double>")
    scores = spark.createDataFrame([], "round int, rmse double, mae double, n long") if not k else spark.read.schema("round int, rmse double, mae double, n long").parquet(*[f"{path}/scores/round-{i}" for i in range(1, k + 1)])
    return {"trunk": model, "sites": sites, "scores": scores}


def weights(table: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w1, b1, w2, b2) of a kept trunk, as ``upscale`` takes them; one for inputs of another width is an error."""
    r = table.first()
    if r["n_input"] != width:
        raise ValueError(f"a trunk for {r['n_input']} inputs, not {width}")
    h = r["hidden"]
    return np.array(r["w1"]).reshape(h, width), np.array(r["b1"]), np.array(r["w2"]).reshape(h, h), np.array(r["b2"])


def raised(inputs: DataFrame, shared: tuple) -> DataFrame:
    """``inputs`` (rep, cell_id, x) with the trunk applied to x, for the training of units on a frozen trunk."""
    def apply(batches):
        for df in batches:
            yield df.assign(x=list(trunk(np.stack(df["x"].to_numpy()), *shared))) if len(df) else df

    return inputs.select("rep", "cell_id", "x").mapInPandas(apply, "rep int, cell_id long, x array<double>")
