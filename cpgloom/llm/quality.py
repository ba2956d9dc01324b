"""Quality rules: fixed rules, and a hashed n-gram logistic regression with calibrated probabilities.

Features are hashed word 1- and 2-grams and character 3-, 4- and 5-grams, each
as its share of the text's n-grams of that kind. A bounded sample of labelled
rows (TRAIN_ROWS) is featurised where it lies, and one task fits the weights on
four fifths of it and a logistic calibration of the scores on the last fifth.
The weights are a vector of fixed size; scoring is a map over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import LOWER, gram_hashes, labelled, mix64, slices, text_or_empty, word_hashes, word_spans

#: Labelled rows that the model is fitted on at most; bits of the feature hash; rounds; step; shrinkage.
TRAIN_ROWS, BITS, EPOCHS, RATE, SHRINK = 4000, 16, 30, 0.5, 1e-6
#: A text is kept from this calibrated probability of good quality on.
THRESHOLD = 0.2
LEAST_WORDS, REPEAT_WORDS, MOST_REPEATED = 10, 5, 20
CHAR_GRAMS, WORD_GRAMS = (3, 4, 5), (1, 2)
SEED = 4

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STEP32 = np.uint32(0x01000193)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty ranges give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.concatenate((np.zeros(1, kind), np.cumsum(values, dtype=kind)))
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    out = {"n_words": np.diff(first)}
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out["word_chars"] = per_row(inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = per_row(_SYMBOL[data], offsets)
    # lines: cut after every newline and at the row bounds; equal lines of a row beyond the first
    cuts = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offsets)))
    cuts = cuts[cuts <= len(data)]
    a, b = cuts[:-1], cuts[1:]
    b = np.where((b > a) & (data[np.maximum(b - 1, 0)] == 10), b - 1, b) if len(data) else b
    real = per_row(inside, np.concatenate((a, b[-1:])) if len(a) else np.zeros(1, np.int64)) > 0 if len(a) else np.zeros(0, bool)
    a, b = a[real], b[real]
    row = np.searchsorted(offsets, a, side="right") - 1
    out["n_dup_lines"] = repeats(word_hashes(data, a, b), row, rows)[0]
    grams = gram_hashes(words, REPEAT_WORDS)
    of = np.repeat(np.arange(rows), np.diff(first))[: len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + REPEAT_WORDS <= first[1:][of])
    twice = at[repeats(grams[at], of[at], rows)[1]]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[twice] += 1
    cover[twice + REPEAT_WORDS] -= 1
    out["n_repeat_words"] = per_row(np.cumsum(cover[:-1]) > 0, first)
    return out


def repeats(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many keys repeat an earlier one; and which keys occur twice or more in their row."""
    if not len(keys):
        return np.zeros(rows, np.int64), np.zeros(0, bool)
    own = keys ^ mix64(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = np.concatenate(([False], own[order][1:] == own[order][:-1]))
    many = np.zeros(len(keys), dtype=bool)
    many[order] = same | np.concatenate((same[1:], [False]))
    return np.bincount(row[order[same]], minlength=rows), many


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the feature of each n-gram, and the bounds of the rows among them."""
    shift = np.uint32(32 - bits)
    code = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    for n in CHAR_GRAMS:
        if len(data) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        m = len(data) - n + 1
        h = np.full(m, np.uint32(n), dtype=np.uint32)
        for i in range(n):
            h = (h ^ code[i : i + m]) * _STEP32
            h ^= h >> np.uint32(15)
        # grams over a row's end belong to the next row's text too: they are left out
        ok = np.ones(m, dtype=bool)
        for i in range(1, n):
            ok[offsets[1:-1][(offsets[1:-1] - i >= 0) & (offsets[1:-1] - i < m)] - i] = False
        count = np.concatenate(([0], np.cumsum(ok)))
        yield ((h * np.uint32(0x85EBCA6B)) >> shift)[ok].astype(np.int64), count[np.minimum(offsets, m)]
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    for n in WORD_GRAMS:
        grams = gram_hashes(words, n)
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(grams)]
        ok = np.arange(len(grams)) + n <= first[1:][of]
        count = np.concatenate(([0], np.cumsum(ok)))
        yield ((grams[ok] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64), count[np.minimum(first, len(grams))]


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Linear score of each row: the mean weight of its n-grams of each kind, summed."""
    total = np.full(len(offsets) - 1, float(weights[-1]))
    bits = (len(weights) - 1).bit_length() - 1
    for feature, bounds in features(data, offsets, bits):
        total += per_row(weights[feature].astype(np.float64), bounds) / np.maximum(np.diff(bounds), 1)
    return total


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            parts = list(features(data, offsets))
            ids, shares = [], []
            for r in range(b - a):
                own = [f[bounds[r] : bounds[r + 1]] for f, bounds in parts]
                share = np.concatenate([np.full(len(x), 1 / max(len(x), 1)) for x in own])
                u, at = np.unique(np.concatenate(own), return_inverse=True)
                ids.append(u.astype("<u2" if BITS <= 16 else "<u4").tobytes())
                shares.append(np.bincount(at, share, len(u)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "label", "ids", "shares"])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights (bias last) and the calibration (slope, offset) of the log-odds of good quality."""
    n = len(rows)
    w = np.zeros((1 << bits) + 1)
    if n < 20 or len(np.unique(y)) < 2:
        w[-1] = 20.0  # nothing to learn from: every text is good
        return w.astype(np.float32), (1.0, 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(n)
    hold, learn = order[: n // 5], order[n // 5 :]
    square = np.full(len(w), 1e-8)
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for a in range(0, len(learn), 32):
            part = learn[a : a + 32]
            ids = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(of, w[ids] * x, len(part)) + w[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            u, at = np.unique(ids, return_inverse=True)
            grad = np.bincount(at, error[of] * x, len(u)) / len(part) + SHRINK * w[u]
            square[u] += grad**2
            w[u] -= RATE * grad / np.sqrt(square[u])
            bias = error.mean()
            square[-1] += bias**2
            w[-1] -= RATE * bias / np.sqrt(square[-1])
    z = np.array([w[rows[i][0]] @ rows[i][1] + w[-1] for i in hold])
    # published sigmoid calibration with smoothed targets, on standardised scores; a step is halved while it doesn't help
    good, bad = (y[hold] == 1).sum(), (y[hold] == 0).sum()
    target = np.where(y[hold] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    centre, spread = z.mean(), z.std() or 1.0
    x = np.stack(((z - centre) / spread, np.ones(len(z))), 1)
    ab = np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        t = x @ ab
        return float((np.logaddexp(0, t) - target * t).sum() + 1e-3 * (ab[0] - 1) ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        g = x.T @ (p - target) + [2e-3 * (ab[0] - 1), 0]
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag([2e-3, 1e-6]), g)
        while loss(ab - step) > loss(ab) and np.abs(step).max() > 1e-10:
            step = step / 2
        ab = ab - step
        if np.abs(step).max() < 1e-9:
            break
    slope, offset = ab[0] / spread, ab[1] - ab[0] * centre / spread
    return w.astype(np.float32), (float(max(slope, 1e-3)), float(offset))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, y, key = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            rows.append((np.frombuffer(r["ids"], "<u2" if BITS <= 16 else "<u4").astype(np.int64), np.frombuffer(r["shares"], "<f4").astype(np.float64)))
            y.append(r["label"])
            key.append((r["doc_id"], len(r["ids"]), r["ids"]))
    order = sorted(range(len(rows)), key=lambda i: key[i])
    w, (slope, offset) = fit([rows[i] for i in order], np.array([y[i] for i in order], dtype=float))
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([slope], pa.float64()), pa.array([offset], pa.float64())], names=["weights", "slope", "offset"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, tuple[float, float]]:
    """Fits the model on at most ``rows`` labelled documents, in one task."""
    sample = labelled(docs, labels, label, rows, SEED).mapInArrow(_featurise, "doc_id long, label int, ids binary, shares binary")
    model = sample.repartition(1).mapInArrow(_fit_rows, "weights binary, slope double, offset double").collect()
    if not model:
        return fit([], np.zeros(0))
    return np.frombuffer(model[0]["weights"], np.float32), (model[0]["slope"], model[0]["offset"])


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """Counts and verdict of every text: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept).

    A text fails the base rules with fewer than 10 words, or with over 20 words
    in 100 in repeated five-word windows; otherwise it is kept if its calibrated
    probability of good quality reaches ``threshold``. Null text counts as empty
    and fails. Rows repeat as they come and doc_id may be null. Columns of
    ``docs`` other than doc_id and text, and of ``labels`` other than doc_id and
    quality, are not read. Without at least 20 labelled texts of both grades every text
    passes the model. An empty table gives an empty table.
    """
    weights, (slope, offset) = train(docs, labels, rows=rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 floats, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                base = base_counts(data, offsets)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                p = 1 / (1 + np.exp(-np.clip(slope * scores(data, offsets, w) + offset, -30, 30)))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                arrays = [pa.array(base[c].astype(np.int64)) for c in names]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays, pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=["doc_id", *names, "base_failed", "probability", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).mapInArrow(score, schema)
