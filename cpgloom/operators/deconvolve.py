"""Deconvolution: non-negative least squares of each cell on the signature's cell types."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.features import usable


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The solution of ``solved``."""
    return solved(a, b, rounds)[0]


def solved(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, bool]:
    """(x, converged): smallest ||a x - b|| with x >= 0, by the published active-set method; the free columns are solved as they are, not by normal equations."""
    n, done = a.shape[1], False
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds or 3 * n):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if n == free.sum() or w.max() <= 1e-12 * scale:
            done = True
            break
        free[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
        x = s
    w = a.T @ (b - a @ x)
    return x, done or n == free.sum() or bool(w[~free].max() <= 1e-12 * scale)


def deconvolve(sig: DataFrame, feat: DataFrame, least: int = 1, status: bool = False) -> DataFrame:
    """(cell_id, cell_type, proportion[, n_used, converged]): a cell is solved alone, so batches give the same as single cells.

    The signature is types x patterns and bounded by them; each cell's rows are
    joined with it and one group is one cell. Cells without usable patterns get
    zeros; otherwise proportions sum to 1, or are 0 if no type explains anything.
    ``status`` adds the patterns that a cell is solved with, and whether the
    solver came to its end (null without patterns).
    """
    types = sorted(r[0] for r in sig.select("cell_type").distinct().collect())
    packed = sig.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", F.col("beta").alias("s")))).alias("by"))
    packed = packed.select("pattern", F.array(*[F.try_element_at("by", F.lit(t)) for t in types]).alias("s"))
    rows = usable(sig, feat, least).join(packed, "pattern").select("cell_id", "pattern", "beta", "s")

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pattern")
        x, done = solved(np.stack(df["s"].to_numpy()).astype(float), df["beta"].to_numpy(dtype=float))
        x = np.maximum(x, 0)
        return pd.DataFrame({"cell_id": df["cell_id"].iloc[0], "cell_type": types, "proportion": x / x.sum() if x.sum() > 0 else x, "n_used": len(df), "converged": done})

    out = rows.groupBy("cell_id").applyInPandas(solve, "cell_id long, cell_type long, proportion double, n_used long, converged boolean")
    grid = feat.select("cell_id").distinct().select("cell_id", F.explode(F.array(*map(F.lit, types)).cast("array<bigint>")).alias("cell_type"))
    more = [F.coalesce("n_used", F.lit(0).cast("long")).alias("n_used"), "converged"] if status else []
    return grid.join(out, ["cell_id", "cell_type"], "left").select("cell_id", "cell_type", F.coalesce("proportion", F.lit(0.0)).alias("proportion"), *more)
