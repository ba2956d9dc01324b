"""The published 64-bit permuted congruential generator (32 bits out), whole streams at once, and splits drawn with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values: the generator's multiplier and the increment of a stream that only a seed chooses
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
_WRAP = 1 << 64


def advanced(state: int, steps: int, inc: int = INCREMENT) -> int:
    """The state after so many steps, by squaring the step."""
    a, c, mult, plus = 1, 0, MULTIPLIER, inc
    while steps:
        if steps & 1:
            a, c = a * mult % _WRAP, (c * mult + plus) % _WRAP
        plus, mult = (mult + 1) * plus % _WRAP, mult * mult % _WRAP
        steps >>= 1
    return (a * state + c) % _WRAP


def seeded(seed: int, inc: int = INCREMENT) -> int:
    """The state from which a seed's numbers come."""
    return advanced((inc + seed) % _WRAP, 1, inc)


def numbers(state: int, n: int, inc: int = INCREMENT) -> np.ndarray:
    """The next ``n`` numbers (uint32) from ``state`` on."""
    if not n:
        return np.zeros(0, np.uint32)
    a = np.full(n, MULTIPLIER, np.uint64)
    a[0] = 1
    a = np.multiply.accumulate(a)  # powers of the multiplier, modulo 2**64
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a[:-1], dtype=np.uint64))) * np.uint64(inc)
    old = a * np.uint64(state) + c
    x = (((old >> np.uint64(18)) ^ old) >> np.uint64(27)) & np.uint64(0xFFFFFFFF)
    turn = old >> np.uint64(59)
    return (((x >> turn) | (x << ((np.uint64(32) - turn) & np.uint64(31)))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shuffled(n: int, seed: int) -> np.ndarray:
    """0 .. n - 1 in a seed's order: from the last place on, each is exchanged with one at or before it."""
    order = np.arange(n)
    last = np.arange(n, 1, -1)
    for q, j in zip(last, numbers(seeded(seed), len(last)) % last.astype(np.uint32)):
        order[q - 1], order[j] = order[j], order[q - 1]
    return order


def split(cells: DataFrame, seed: int = 1) -> DataFrame:
    """(cell_id, split): 70, 15 and 15 in 100 of the cells, numbered in their order and shuffled by the seed.

    Too few cells for all three are an error. The exchange of places goes one
    after another, so it is one task over the cells' numbers, 16 bytes a cell;
    for tables without bound there is ``simulate.split``, whose draws have no order.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.sort(np.concatenate([df["cell_id"].to_numpy(np.int64) for df in batches] or [np.zeros(0, np.int64)]))
        train, val = len(ids) * 70 // 100, len(ids) * 15 // 100
        if not train or not val or train + val >= len(ids):
            raise ValueError("too few cells for a split")
        order = shuffled(len(ids), seed)
        yield pd.DataFrame({"cell_id": ids[order], "split": np.repeat(["train", "val", "test"], [train, val, len(ids) - train - val])})

    return cells.select("cell_id").distinct().coalesce(1).mapInPandas(cut, "cell_id long, split string")
