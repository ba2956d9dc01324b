"""Scalar expressions; missing values are null, never NaN."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage(m="m", u="u") -> Column:
    return F.col(m) + F.col(u)


def beta(m="m", u="u") -> Column:
    """Methylated fraction, null without coverage."""
    return F.try_divide(F.col(m).cast("double"), F.col(m) + F.col(u))


def call(threshold: float = 0.5, mincov: int = 1) -> Column:
    """1 above the threshold, 0 below it, null at it or under the least coverage."""
    b = beta()
    return F.when(coverage() < mincov, None).when(b > threshold, 1).when(b < threshold, 0)


def label_of(rank: Column) -> Column:
    return F.concat(F.lit("P"), (rank + 1).cast("string"))


def group_of(state: Column, patterns: int) -> Column:
    """k of a state named P<k> up to ``patterns``, else 0."""
    digits = F.regexp_extract(state, "^[Pp]([0-9]+)$", 1)
    k = F.when(digits != "", digits.cast("long"))
    return F.when(k.isNotNull() & (k <= patterns), k).otherwise(F.lit(0).cast("long"))


def first_number(name: Column) -> Column:
    digits = F.regexp_extract(name, "([0-9]+)", 1)
    return F.when(digits != "", digits.cast("long"))


def significant(x: Column, digits: int = 6) -> Column:
    """x with that many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def entropy_confidence(p: Sequence[Column]) -> Column:
    """1 minus the normalised entropy of the class probabilities, in [0, 1]; 1 for one class."""
    if len(p) <= 1:
        return F.lit(1.0)
    h = -sum((x * F.log(x + F.lit(1e-10)) for x in p), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - h / F.lit(math.log(len(p)))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def u16(b: Column) -> Column:
    """The fraction as an integer code of 0..65534, null if missing."""
    return F.round(b * 65534).cast("int")


def logit(p: Column, low: float = 0.01, high: float = 0.99) -> Column:
    q = F.least(F.lit(high), F.greatest(F.lit(low), p))
    return F.log(q / (1 - q))


def key_of(*parts) -> Column:
    """A stateless random order: md5 over the parts, joined by |."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def share_of(key: Column) -> Column:
    """A key's place in the order of keys, as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return share_of(key_of(*parts))


def binomial_fraction(p: Column, depth: int, *parts) -> Column:
    """The methylated share of ``depth`` reads of a site with fraction p; a read's draw depends on the parts and its number alone; null for a null p."""
    reads = F.sequence(F.lit(1), F.lit(depth))
    return F.when(p.isNotNull(), F.size(F.filter(reads, lambda i: uniform(*parts, i) < p)) / F.lit(depth))
