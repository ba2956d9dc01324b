"""Boosted trees with every cut tried, in one place: what the distributed trainer is held against."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Second-order boosted trees for several classes, by the published algorithm; missing values take the better side."""

    def __init__(self, rounds: int | None = None, eta: float = 0.3, depth: int = 6, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.eta, self.depth, self.ridge, self.least = rounds, eta, depth, ridge, least
        self.trees: list[list[tuple]] = []

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        def grow(rows: np.ndarray, depth: int) -> tuple:
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if depth < self.depth and hs >= 2 * self.least:
                for f in range(x.shape[1]):
                    v = x[rows, f]
                    seen = ~np.isnan(v)
                    order = np.argsort(v[seen], kind="stable")
                    own = rows[seen][order]
                    if len(own) < 2:
                        continue
                    cut = np.flatnonzero(np.diff(x[own, f]) > 0)
                    gl, hl = g[own].cumsum()[cut], h[own].cumsum()[cut]
                    gm, hm = gs - g[own].sum(), hs - h[own].sum()
                    for left in (True, False):
                        a, b = (gl + gm, hl + hm) if left else (gl, hl)
                        ok = (b >= self.least) & (hs - b >= self.least)
                        gain = np.round(np.where(ok, a**2 / (b + self.ridge) + (gs - a) ** 2 / (hs - b + self.ridge) - gs**2 / (hs + self.ridge), -1), 9)  # equal to nine digits is a tie
                        if len(gain) and gain.max() > best[0]:
                            k = int(gain.argmax())
                            best = (float(gain[k]), (f, (x[own[cut[k]], f] + x[own[cut[k] + 1], f]) / 2, left))
            if best[1] is None:
                return (-self.eta * gs / (hs + self.ridge),)
            f, at, left = best[1]
            v = x[rows, f]
            go = np.where(np.isnan(v), left, v < at)
            return (f, at, left, grow(rows[go], depth + 1), grow(rows[~go], depth + 1))

        return grow(np.arange(len(x)), 0)

    @staticmethod
    def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        f, at, left, yes, no = tree
        go = np.where(np.isnan(x[:, f]), left, x[:, f] < at)
        out = np.empty(len(x))
        out[go], out[~go] = Boosted._value(yes, x[go]), Boosted._value(no, x[~go])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> Boosted:
        score = np.full((len(x), classes), 0.5)
        for _ in range(self.rounds or max(1, int(np.sqrt(len(x)) + 0.5))):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            own = [self._tree(x, p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)) for k in range(classes)]
            for k, t in enumerate(own):
                score[:, k] += self._value(t, x)
            self.trees.append(own)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full((len(x), len(self.trees[0])), 0.5)
        for own in self.trees:
            for k, t in enumerate(own):
                score[:, k] += self._value(t, x)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
