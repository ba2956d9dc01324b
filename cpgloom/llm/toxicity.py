"""Toxicity as ordered severity: a cumulative-link regression on sparse text features.

Features are the hashed plain words of a text, each there or not: 2**BITS
columns, the whole vocabulary. The model P(grade > k) = sigmoid(w x - theta_k)
has one weight vector and ordered thresholds; its expected severity is the sum
of the three probabilities.

Labels say only whether a text is toxic. The severity grade of a toxic training
row comes from rows that it has no part in: the labelled sample is halved by a
hash of the text, a plain logistic model of each half scores the other half, and
the scored toxic rows of a half are cut in three by the thirds of their scores.
Grade 0 is a row that isn't toxic.

The labelled sample is bounded (TRAIN_ROWS). Its texts are turned into feature
rows where they lie, and one task fits the model on them; the penalty on the sum
of absolute weights leaves only words in it that tell grades apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import LOWER, PLAIN, labelled, mix64, slices, text_or_empty, word_hashes, word_spans

#: Labelled rows at most; bits of the feature hash.
TRAIN_ROWS, BITS = 12_000, 18
#: A text is toxic from this probability of a grade above 0 on.
THRESHOLD = 0.5
#: Grades; penalty on the absolute weights, in rows.
GRADES, PENALTY = 4, 1.0
#: Steps of a descent, descents of a fit, and columns that each adds.
STEPS, ROUNDS, COLUMNS = 100, 30, 256
SEED = 2


def row_words(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features of the plain words in lower case, and the bounds of the rows among them."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, PLAIN)
    return (word_hashes(low, starts, ends) >> np.uint64(64 - bits)).astype(np.int64), first


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            words, first = row_words(data, offsets)
            own = [np.unique(words[first[r] : first[r + 1]]).astype(np.int32).tobytes() for r in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(own, pa.binary())], names=["doc_id", "label", "words"])


class Rows:
    """Sparse rows of zeros and ones: for each one, its row and its column. 32-bit places keep a large sample small."""

    def __init__(self, n: int, width: int, of: np.ndarray, at: np.ndarray):
        self.n, self.width, self.of, self.at = n, width, of, at

    @staticmethod
    def of_lists(rows: list[np.ndarray], width: int) -> Rows:
        return Rows(len(rows), width, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int32), *rows], dtype=np.int32))

    def columns(self, chosen: np.ndarray) -> Rows:
        """The same rows with some of the columns."""
        place = np.full(self.width, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        at = place[self.at]
        kept = at >= 0
        return Rows(self.n, len(chosen), self.of[kept], at[kept])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n)

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, d[self.of], self.width)


def loss(score: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its slopes by score and by threshold."""
    n, k = len(score), len(theta)
    # a grade's probability is a difference of neighbouring cumulative probabilities
    p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))
    upper, lower = np.concatenate((np.ones((n, 1)), p), 1), np.concatenate((p, np.zeros((n, 1))), 1)
    each = np.arange(n)
    own = np.maximum(upper[each, grade] - lower[each, grade], 1e-12)
    slope = p * (1 - p) / own[:, None]
    d = np.zeros((n, k))
    up, down = grade > 0, grade < k
    d[up, grade[up] - 1] += slope[up, grade[up] - 1]
    d[down, grade[down]] -= slope[down, grade[down]]
    return float(-np.log(own).mean()), -d.sum(1) / n, d.sum(0) / n


def thresholds(v: np.ndarray) -> np.ndarray:
    """A first value and the logarithms of the gaps, so that the order holds throughout."""
    return v[0] + np.concatenate(([0.0], np.cumsum(np.exp(np.clip(v[1:], -20, 5)))))


def descend(x: Rows, grade: np.ndarray, v: np.ndarray, lam: float, steps: int) -> np.ndarray:
    """Weights and threshold parameters after accelerated proximal steps from ``v`` on.

    A step that does not lower the loss as its slopes promise is halved.
    """
    f = x.width

    def slopes(v: np.ndarray) -> tuple[float, np.ndarray]:
        value, by_score, by_theta = loss(x.dot(v[:f]), thresholds(v[f:]), grade)
        gaps = np.exp(np.clip(v[f + 1 :], -20, 5)) * by_theta[::-1].cumsum()[::-1][1:]
        return value, np.concatenate((x.back(by_score), [by_theta.sum()], gaps))

    look, momentum, step = v, 1.0, 1.0
    for _ in range(steps):
        value, g = slopes(look)
        while True:
            new = look - step * g
            new[:f] = np.sign(new[:f]) * np.maximum(np.abs(new[:f]) - step * lam, 0)
            moved = new - look
            if slopes(new)[0] <= value + g @ moved + moved @ moved / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        if (look - new) @ (new - v) > 0:  # the momentum leads uphill
            momentum = 1.0
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, gain = new + (momentum - 1) / after * (new - v), np.abs(new - v).max()
        v, momentum, step = new, after, step * 1.2
        if gain < 1e-5:
            break
    return v


def fit(x: Rows, grade: np.ndarray, grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds with the smallest loss + penalty / rows * sum |w|.

    Only weights that the penalty lets leave 0 need work: the fit goes on with
    the columns whose slope is steeper than the penalty, the steepest first,
    until no column is.
    """
    k = grades - 1
    lam = penalty / max(x.n, 1)
    share = np.clip([(grade > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    w, tail = np.zeros(x.width), np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    chosen = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        slope = np.abs(x.back(loss(x.dot(w), thresholds(tail), grade)[1]))
        slope[chosen] = 0
        steep = np.flatnonzero(slope > lam * 1.001)
        if not len(steep):
            break
        chosen = np.sort(np.concatenate((chosen[w[chosen] != 0], steep[np.argsort(-slope[steep], kind="stable")[:COLUMNS]])))
        v = descend(x.columns(chosen), grade, np.concatenate((w[chosen], tail)), lam, steps)
        w[:] = 0
        w[chosen], tail = v[: len(chosen)], v[len(chosen) :]
    return w, thresholds(tail)


def graded(rows: list[np.ndarray], toxic: np.ndarray, width: int) -> np.ndarray:
    """Severity grades 0 to GRADES - 1: of toxic rows by the score of a model that the row had no part in."""
    grade = toxic.astype(np.int64)
    half = np.array([int(mix64(mix64(r.astype(np.uint64)).sum(keepdims=True) + np.uint64(len(r)))[0] >> np.uint64(63)) for r in rows])
    for h in (0, 1):
        learn, judge = np.flatnonzero(half != h), np.flatnonzero((half == h) & toxic)
        if not len(judge) or len(np.unique(toxic[learn])) < 2:
            continue
        w, _ = fit(Rows.of_lists([rows[i] for i in learn], width), toxic[learn].astype(np.int64), 2)
        score = np.array([w[rows[i]].sum() for i in judge])
        cuts = np.quantile(score, np.arange(1, GRADES - 1) / (GRADES - 1))
        grade[judge] = 1 + (score[:, None] > cuts).sum(1)
    return grade


def _fit_rows(bits: int):
    def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic, key = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                rows.append(np.frombuffer(r["words"], np.int32))
                toxic.append(r["label"] > 0)
                key.append((r["doc_id"], r["words"]))
        order = sorted(range(len(rows)), key=lambda i: key[i])
        rows, y = [rows[i] for i in order], np.array([toxic[i] for i in order], dtype=bool)
        weights, theta = np.zeros(1 << bits), np.full(GRADES - 1, 30.0)
        if y.any() and not y.all():
            grade = graded(rows, y, 1 << bits)
            weights, theta = fit(Rows.of_lists(rows, 1 << bits), grade)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([theta.tobytes()], pa.binary())], names=["weights", "theta"])

    return fit_rows


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each feature, thresholds) from at most ``rows`` labelled texts, fitted in one task."""
    sample = labelled(docs, labels, label, rows, SEED).mapInArrow(_distinct, "doc_id long, label int, words binary")
    model = sample.repartition(1).mapInArrow(_fit_rows(BITS), "weights binary, theta binary").collect()
    if not model:
        return np.zeros(1 << BITS), np.full(GRADES - 1, 30.0)
    return np.frombuffer(model[0]["weights"]), np.frombuffer(model[0]["theta"])


def severities(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade > k) of each row, by k; a feature counts once in a row."""
    rows = len(offsets) - 1
    words, first = row_words(data, offsets, len(weights).bit_length() - 1)
    hit = np.flatnonzero(weights[words])
    row = np.searchsorted(first, hit, side="right") - 1
    once = np.unique(row * len(weights) + words[hit])
    score = np.bincount(once // len(weights), weights[once % len(weights)], rows)
    return 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """Severity of every text: (doc_id, tkey, expected_severity, grade, toxic).

    ``expected_severity`` lies between 0 and 3, ``grade`` is the most probable
    grade (the smaller of equals), ``toxic`` says whether a grade above 0 has at
    least probability ``threshold``. Null text counts as empty. Rows repeat as
    they come and doc_id may be null; ``tkey`` tells rows of one doc_id apart.
    Other columns are not read. Without labelled texts of both kinds nothing is
    toxic. An empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows))  # 2**BITS weights, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, theta = model.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                p = severities(data, offsets, weights, theta)
                each = -np.diff(np.concatenate((np.ones((b - a, 1)), p, np.zeros((b - a, 1))), 1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= threshold)],
                    names=["doc_id", "tkey", "expected_severity", "grade", "toxic"],
                )

    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tkey"), text.alias("text")).mapInArrow(score, "doc_id long, tkey long, expected_severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the toxic ones, judged in place so that no text is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows))
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, theta = model.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(at)):
                mask = severities(data, offsets, weights, theta)[:, 0] < threshold
                yield batch.slice(a, b - a).filter(pa.array(mask))

    out = docs.withColumn("text", F.col("text").cast("string"))
    return out.mapInArrow(clean, out.schema)
