"""Training of per-unit decoders on drawn batches, with results that are kept and reused.

A unit's trainer gets what it trains on and no more: which cell and replicate a
step takes is drawn first, and only those targets are cut from the truth. So the
size of a task follows the steps and the batch, not the cells or the replicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace  # noqa: F401

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cpgloom.functions import scalars as S
from cpgloom.operators.upscale import unit_forward

UNITS = "unit int, class string, mode string, rank int, a array<double>, head array<double>, E array<double>, b array<double>, cpgs array<long>, best_step int, best_mae double, first_mae double, prior_mae double, checked long, run string"


@dataclass(frozen=True)
class Options:
    """Heads and schedule: ``direct`` gives units other than pure ones a head without a bottleneck; ``checks`` validation rows for each unit; ``last`` keeps a unit as it is after its last step, not at its best."""

    pure_rank: int = 16
    mixed_rank: int = 32
    direct: bool = False
    linear: bool = True
    batch: int = 1024
    min_steps: int = 2000
    max_steps: int = 8000
    evaluate: int = 200
    patience: int = 8
    checks: int = 32
    lr: float = 1e-3
    decay: float = 1e-5
    seed: int = 1
    last: bool = False

    def run(self) -> str:
        """A key of these options: units trained with others are not reused."""
        return hashlib.md5(repr(sorted(asdict(self).items())).encode()).hexdigest()


def held(codes: DataFrame, places: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, cell_id, local array<int>, code array<int>): each cell's true values of each unit, by place in the unit."""
    local = places.join(units.select("unit", "output_offset"), "unit").select("unit", "cpg_idx", (F.col("dest") - F.col("output_offset")).cast("int").alias("local"))
    pairs = F.array_sort(F.collect_list(F.struct("local", "code")))
    rows = codes.join(local, "cpg_idx").groupBy("unit", "cell_id").agg(pairs.alias("v"))
    return rows.select("unit", "cell_id", F.col("v.local").alias("local"), F.col("v.code").alias("code"))


def seen(sampled: DataFrame, places: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, cell_id, rep, seen array<int>): the places that a replicate observes."""
    local = places.join(units.select("unit", "output_offset"), "unit").select("unit", "cpg_idx", (F.col("dest") - F.col("output_offset")).cast("int").alias("local"))
    return sampled.join(local, "cpg_idx").groupBy("unit", "cell_id", "rep").agg(F.collect_set("local").alias("seen"))


def schedule(pairs: DataFrame, reps: int, options: Options) -> DataFrame:
    """(unit, split, step, cell_id, rep, start): the drawn rows of each unit, for training and for validation.

    ``pairs`` is (unit, cell_id, split): the cells that have values in a unit.
    Draws are stateless, so a unit's rows are the same in every run.
    """
    pairs = pairs.where(F.col("split").isin("train", "val"))
    order = Window.partitionBy("unit", "split").orderBy("cell_id")
    numbered = pairs.select("unit", "split", "cell_id", (F.row_number().over(order) - 1).cast("long").alias("i"))
    sizes = pairs.groupBy("unit", "split").agg(F.count("*").alias("n"))
    rows = sizes.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("split") == "train", options.max_steps).otherwise(options.checks))).alias("step"))

    def drawn(what: str):
        return S.uniform(options.seed, F.lit(what), F.col("unit"), F.col("split"), F.col("step"))

    rows = rows.select("unit", "split", "step", F.floor(drawn("cell") * F.col("n")).cast("long").alias("i"), F.floor(drawn("rep") * reps).cast("int").alias("rep"), drawn("start").alias("start"))
    return rows.join(numbered, ["unit", "split", "i"]).drop("i")


def batches(drawn: DataFrame, truth: DataFrame, observed: DataFrame, options: Options) -> DataFrame:
    """(unit, split, step, cell_id, rep, local array<int>, y array<double>): of the unobserved targets the first ``batch`` from the drawn start on, going round.

    A unit's values of a cell come before its draws, so they are read once, and a
    task holds one such row at a time. Draws without targets are left out.
    """
    size = options.batch

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, local, code = None, None, None
        for part in parts:
            out = []
            for r in part.to_pylist():
                if r["code"] is not None:
                    own, local, code = (r["unit"], r["cell_id"]), np.array(r["local"], np.int64), np.array(r["code"], np.int64)
                elif own == (r["unit"], r["cell_id"]):
                    free = np.flatnonzero(~np.isin(local, r["seen"])) if r["seen"] is not None else np.arange(len(local))
                    if len(free):
                        at = np.roll(free, -int(r["start"] * len(free)))[:size]
                        out.append((r["unit"], r["split"], r["step"], r["cell_id"], r["rep"], local[at], code[at] / 65534.0))
            if out:
                columns = zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns], names=["unit", "split", "step", "cell_id", "rep", "local", "y"])

    rows = drawn.join(observed, ["unit", "cell_id", "rep"], "left")
    # only cells that are drawn; they come from the truth's own keys, so new names for its columns tell the two sides apart
    truth = truth.select(*[F.col(c).alias(c) for c in truth.columns]).join(drawn.select("unit", "cell_id").distinct(), ["unit", "cell_id"], "left_semi")
    both = truth.select("unit", "cell_id", "local", "code").unionByName(rows, allowMissingColumns=True)
    both = both.repartition("unit", "cell_id").sortWithinPartitions("unit", "cell_id", F.col("code").isNull(), "split", "step")
    return both.mapInArrow(cut, "unit int, split string, step int, cell_id long, rep int, local array<int>, y array<double>")


def layout(places: DataFrame, units: DataFrame, bias: DataFrame) -> DataFrame:
    """(unit, class, cpgs array<long>, b array<double>): each unit's CpGs in order, with their prior."""
    rows = places.join(units.select("unit", "class"), "unit").join(bias.select("cpg_idx", "logit"), "cpg_idx")
    rows = rows.groupBy("unit", "class").agg(F.array_sort(F.collect_list(F.struct("dest", "cpg_idx", "logit"))).alias("v"))
    return rows.select("unit", "class", F.col("v.cpg_idx").alias("cpgs"), F.col("v.logit").alias("b"))


class Head:
    """E f(A x + a) + b, or A x + b in direct mode, through a sigmoid; trained by Adam with a plain L2 term, biases undecayed."""

    def __init__(self, width: int, rank: int, bias: np.ndarray, linear: bool, rng: np.random.Generator):
        self.rank, self.linear, o = rank, linear, len(bias)
        rows = rank or o
        bound = np.sqrt(6 / (width + rows)) if rank else 0.02
        self.net = {"A": rng.uniform(-bound, bound, (rows, width)), "b": bias.astype(float).copy()}
        if rank:
            self.net |= {"a": np.zeros(rank), "E": rng.uniform(-0.02, 0.02, (o, rank))}
        self.first = {k: np.zeros_like(v) for k, v in self.net.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.net.items()}
        self.steps = 0

    def predict(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        n = self.net
        if not self.rank:
            z, f = n["A"][at] @ x + n["b"][at], None
        else:
            h = n["A"] @ x + n["a"]
            f = h if self.linear else np.where(h < 0, 0.01 * h, h)
            z = n["E"][at] @ f + n["b"][at]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700))), f

    def slopes(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Gradient of the mean squared error of a batch, with the decay of the weights that it touches."""
        n = self.net
        p, f = self.predict(x, at)
        dz = 2 * (p - y) * p * (1 - p) / len(y)
        g = {k: np.zeros_like(v) for k, v in n.items()}
        np.add.at(g["b"], at, dz)
        if not self.rank:
            np.add.at(g["A"], at, np.outer(dz, x) + decay * n["A"][at])
            return g
        df = n["E"][at].T @ dz
        dh = df if self.linear else df * np.where(f < 0, 0.01, 1.0)
        g["A"], g["a"] = np.outer(dh, x) + decay * n["A"], dh
        np.add.at(g["E"], at, np.outer(dz, f) + decay * n["E"][at])
        return g

    def step(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, lr: float, decay: float) -> None:
        self.steps += 1
        for k, g in self.slopes(x, at, y, decay).items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g**2
            self.net[k] = self.net[k] - lr * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


def fit_unit(rows: list[tuple], kind: str, bias: np.ndarray, unit: int, options: Options) -> dict:
    """The best head of one unit. ``rows``: (split, x, local, y) in the order of their steps; without validation rows the first training rows serve."""
    learn = [r[1:] for r in rows if r[0] == "train"]
    check = [r[1:] for r in rows if r[0] == "val"] or learn[: options.checks]
    rank = options.pure_rank if kind == "pure" else 0 if options.direct else options.mixed_rank
    head = Head(len(rows[0][1]), rank, bias, options.linear, np.random.default_rng([options.seed, unit]))

    def error() -> float:
        parts = [np.abs(head.predict(x, at)[0] - y) for x, at, y in check]
        return float(np.concatenate(parts).mean())

    prior = float(np.concatenate([np.abs(1 / (1 + np.exp(-bias[at])) - y) for _, at, y in check]).mean())
    best, best_step, kept, bad = error(), 0, {k: v.copy() for k, v in head.net.items()}, 0
    first = best
    for t, (x, at, y) in enumerate(learn, 1):
        head.step(x, at, y, options.lr, options.decay)
        if t % options.evaluate == 0:
            now = error()
            if now + 1e-7 < best:
                best, best_step, kept, bad = now, t, {k: v.copy() for k, v in head.net.items()}, 0
            elif t >= options.min_steps:
                bad += 1
            if t >= options.min_steps and bad >= options.patience:
                break
    if options.last:
        best, best_step, kept = error(), head.steps, head.net
    return {"mode": "factor" if rank else "direct", "rank": rank, "net": kept, "best_step": best_step, "best_mae": best, "first_mae": first, "prior_mae": prior, "checked": sum(len(y) for _, _, y in check)}


def train_units(rows: DataFrame, inputs: DataFrame, places: DataFrame, options: Options, runs: DataFrame | None = None) -> DataFrame:
    """Trained units, in the columns that ``upscale`` reads and more: (unit, class, mode, rank, a, head, E, b, cpgs, best_step, best_mae, first_mae, prior_mae, checked, run).

    ``rows`` are ``batches``, ``inputs`` (rep, cell_id, x), ``places`` a
    ``layout``, ``runs`` the units' ``identity`` (default: a key of the options).
    One group is one unit: at most max_steps + checks rows of one input vector
    and one batch. A unit without any training row is left out. prior_mae is the
    error of the prior alone, first_mae that of the head as drawn.
    """
    places = places.withColumn("run", F.lit(options.run())) if runs is None else places.join(runs, "unit")

    def fit(df: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if not len(info) or not (df["split"] == "train").any():
            return pd.DataFrame(columns=[c.split()[0] for c in UNITS.split(", ")])
        df, own = df.sort_values(["split", "step"]), info.iloc[0]
        drawn = [(s, np.asarray(x, float), np.asarray(at), np.asarray(y, float)) for s, x, at, y in zip(df["split"], df["x"], df["local"], df["y"])]
        got = fit_unit(drawn, own["class"], np.asarray(own["b"], float), int(own["unit"]), options)
        net = {k: got["net"].get(k, np.zeros(0)).ravel().tolist() for k in ("a", "A", "E", "b")}
        return pd.DataFrame([(own["unit"], own["class"], got["mode"], got["rank"], net["a"], net["A"], net["E"], net["b"], list(own["cpgs"]), got["best_step"], got["best_mae"], got["first_mae"], got["prior_mae"], got["checked"], own["run"])], columns=[c.split()[0] for c in UNITS.split(", ")])

    full = rows.join(inputs, ["rep", "cell_id"])
    places = places.select(*[F.col(c).alias(c) for c in places.columns])
    return full.groupBy("unit").cogroup(places.groupBy("unit")).applyInPandas(fit, UNITS)


def errors(units: DataFrame, rows: DataFrame, inputs: DataFrame, linear: bool = True) -> DataFrame:
    """(unit, n, mae) of kept heads on ``rows`` of ``batches``, by the forward pass alone.

    A group is one unit and its rows, so a head meets the cells of these and no others.
    """
    def apply(df: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if not len(df) or not len(heads):
            return pd.DataFrame({"unit": pd.Series(dtype="int32"), "n": pd.Series(dtype="int64"), "mae": pd.Series(dtype="float64")})
        r, x = heads.iloc[0], np.stack([np.asarray(v, float) for v in df["x"]])
        unit = {"mode": r["mode"], "b": np.asarray(r["b"], float), "A": np.asarray(r["head"], float).reshape(-1, x.shape[1])}
        if r["mode"] != "direct":
            unit |= {"a": np.asarray(r["a"], float), "E": np.asarray(r["E"], float).reshape(len(unit["b"]), -1)}
        off = np.concatenate([np.abs(unit_forward(v[None], unit, linear)[0][np.asarray(at)] - np.asarray(y, float)) for v, at, y in zip(x, df["local"], df["y"])])
        return pd.DataFrame({"unit": [int(r["unit"])], "n": [len(off)], "mae": [off.mean()]})

    full = rows.select("rep", "cell_id", "unit", "local", "y").join(inputs.select("rep", "cell_id", "x"), ["rep", "cell_id"])
    heads = units.select(*[F.col(c).alias(c) for c in ("unit", "mode", "a", "head", "E", "b")])
    return full.groupBy("unit").cogroup(heads.groupBy("unit")).applyInPandas(apply, "unit int, n long, mae double")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """(by, sums): a checksum of each group's rows, whatever their order; equal rows don't cancel out."""
    key = F.xxhash64(*[F.array_sort(c) if c == "seen" else F.col(c) for c in sorted(rows.columns)])
    parts = [F.count("*"), F.bit_xor(key), F.sum(key.cast("decimal(38,0)")), F.sum(F.xxhash64(key).cast("decimal(38,0)"))]
    return rows.groupBy(*by).agg(F.concat_ws(",", *[x.cast("string") for x in parts]).alias("sums"))


def content(*tables: DataFrame) -> str:
    """A key of tables' names of columns and rows, whatever the rows' order."""
    return hashlib.md5(repr([(sorted(t.columns), _sums(t).first()["sums"]) for t in tables]).encode()).hexdigest()


def identity(places: DataFrame, truth: DataFrame, observed: DataFrame, drawn: DataFrame, inputs: DataFrame, options: Options, trunk: str = "") -> DataFrame:
    """(unit, run): a key of all that a unit's training depends on.

    That is the options, the unit's class, CpGs and priors (``layout``), its true
    values (``held``), the places that replicates observe (``seen``), its draws
    (``schedule``: seed, split, replicates), all inputs (their values, number and standardisation), and
    ``trunk``, a key of the frozen trunk that was applied to them.
    """
    whole = F.lit("|".join((options.run(), content(inputs.select("rep", "cell_id", "x")), trunk)))
    out = _sums(places.select("unit", "class", "cpgs", "b"), "unit").withColumnRenamed("sums", "s0")
    for k, t in enumerate((truth.select("unit", "cell_id", "local", "code"), observed.select("unit", "cell_id", "rep", "seen"), drawn.select("unit", "split", "step", "cell_id", "rep", "start")), 1):
        out = out.join(_sums(t, "unit").withColumnRenamed("sums", f"s{k}"), "unit", "left")
    return out.select("unit", F.md5(F.concat_ws("|", whole, *[F.coalesce(f"s{k}", F.lit("none")) for k in range(4)])).alias("run"))


def resume(spark: SparkSession, path: str, drawn: DataFrame, train, options: Options, runs: DataFrame | None = None) -> DataFrame:
    """All units of this run under ``path``: those without a row there are trained by ``train(drawn rows)`` and added first.

    ``runs`` is the units' ``identity``: a unit whose key has changed is trained
    again, while others are reused. Without it the key is one of the options
    alone. Units of other runs stay there and are not reused.
    """
    runs = drawn.select("unit").distinct().withColumn("run", F.lit(options.run())) if runs is None else runs.select("unit", "run")

    def own() -> DataFrame:
        kept = spark.read.schema(UNITS).parquet(path)
        return kept.join(runs, ["unit", "run"], "left_semi").select(*kept.columns)

    try:
        drawn = drawn.join(own().select("unit"), "unit", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    train(drawn).write.mode("append").parquet(path)
    return own()


def exported(kept: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(unit, mode, rank, input_dim, cpg_count, param_floats, best_step, best_mae, run) of kept units, of those in ``units`` (unit) if given."""
    rows = kept if units is None else kept.join(units.select("unit").distinct(), "unit", "left_semi")
    sizes = [F.size(c) for c in ("a", "head", "E", "b")]
    width = F.size("head") / F.when(F.col("mode") == "direct", F.size("cpgs")).otherwise(F.col("rank"))
    return rows.select("unit", "mode", "rank", width.cast("int").alias("input_dim"), F.size("cpgs").alias("cpg_count"), sum(sizes[1:], sizes[0]).cast("long").alias("param_floats"), "best_step", "best_mae", "run")
