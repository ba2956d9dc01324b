"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Any run of 20 or more token characters is a candidate. From its characters an
encoding is inferred (hex, base32 or base64), which gives symbol values, and
three tests of randomness are made: chi-squared uniformity over the alphabet,
the runs test above and below its middle, and the serial correlation of
neighbours. Fisher's method combines them into one score.

Secrets look random and ordinary text doesn't, so the null of the discovery step
is ordinary text as each encoding's alphabet has it: all letters outside the
candidates of every document (for base32 in upper case, for hex those that are
hex digits, with the digits) are cut into strings of each length class in turn
and scored likewise. Candidates and
null strings of all documents are counted in a histogram of fixed size (length
class x encoding x score bin); the Benjamini-Hochberg rule on it gives a score
limit for each length class and encoding.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import materialize, meeting, text_or_empty

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr]|[Tt][Oo][Kk][Ee]|[Aa][Pp][Ii]_?[Kk]")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Length classes (from each bound on), score bins, and the false-discovery rate.
CLASSES, BINS, BIN_STEP, RATE = (20, 32, 48), 48, 0.25, 0.01
#: Null strings that are scored at once.
SCORE_ROWS = 4096
ENCODINGS = {"hex": 16, "base32": 32, "base64": 64}

_BASE64 = np.full(128, -1, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _BASE64[ord(_c)] = _i
_BASE64[ord("-")], _BASE64[ord("_")], _BASE64[ord("=")] = 62, 63, 0
_BASE32 = np.full(128, -1, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
    _BASE32[ord(_c)] = _i
_HEX = np.full(128, -1, np.int64)
for _i, _c in enumerate("0123456789abcdef"):
    _HEX[ord(_c)] = _HEX[ord(_c.upper())] = _i
TABLES = {"hex": _HEX, "base32": _BASE32, "base64": _BASE64}

_erfc = np.frompyfunc(math.erfc, 1, 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Whole matches of each base kind, leftmost and non-overlapping within a kind."""
    assign = []
    if KEYWORDS.search(text):
        assign = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in HEX.finditer(text)]}


def encoding_of(run: str) -> str | None:
    """The narrowest encoding of a run; runs of digits alone or of one letter case alone have none."""
    body = run.rstrip("=")
    if not body or body.isdigit() or (body.isalpha() and (body.islower() or body.isupper())):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+", body):
        return "base32"
    return "base64"


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def scores(values: list[np.ndarray], alphabet: int) -> np.ndarray:
    """-log10 of the combined p-value under randomness of each symbol row: small for random strings."""
    if not values:
        return np.zeros(0)
    n = np.array([len(v) for v in values])
    grid = np.full((len(values), n.max()), -1, dtype=np.int64)
    for i, v in enumerate(values):
        grid[i, : len(v)] = v
    return battery(grid, n, alphabet)


def battery(grid: np.ndarray, n: np.ndarray, alphabet: int) -> np.ndarray:
    """The score of each row of ``grid``, whose first n symbols count; -1 fills the rest."""
    real = grid >= 0
    rows = len(grid)
    at = np.where(real, grid, alphabet) + np.arange(rows)[:, None] * (alphabet + 1)
    counts = np.bincount(at.ravel(), minlength=rows * (alphabet + 1)).reshape(rows, alphabet + 1)[:, :alphabet]
    chi = (counts.astype(float) ** 2).sum(1) * alphabet / n - n
    # published cube-root approximation of the chi-squared tail
    width = 2 / (9 * (alphabet - 1))
    uniform = _erfc((np.cbrt(chi / (alphabet - 1)) - (1 - width)) / math.sqrt(2 * width)).astype(float) / 2
    high = (grid * 2 >= alphabet) & real
    up = high.sum(1)
    down = n - up
    runs = 1 + ((high[:, 1:] != high[:, :-1]) & real[:, 1:]).sum(1)
    both = np.maximum(up * down, 1)
    mean = 1 + 2 * up * down / n
    var = np.maximum((2 * both * np.maximum(2 * both - n, 1)) / (n**2 * np.maximum(n - 1, 1)), 1e-9)
    z = np.where(up * down == 0, np.sqrt(n), np.abs(runs - mean) / np.sqrt(var))
    run = _erfc(z / math.sqrt(2)).astype(float)
    centred = np.where(real, grid - (alphabet - 1) / 2, 0.0)
    centred = np.where(real, centred - (centred.sum(1) / n)[:, None], 0.0)
    power = (centred**2).sum(1)
    lag = (centred[:, 1:] * centred[:, :-1]).sum(1) / np.maximum(power, 1e-9)
    serial = np.where(power < 1e-9, 1e-300, _erfc(np.abs(lag * np.sqrt(n)) / math.sqrt(2)).astype(float))
    x = -2 * sum(np.log(np.clip(p, 1e-300, 1)) for p in (uniform, run, serial))
    half = x / 2
    return (half - np.log1p(half + half**2 / 2)) / math.log(10)


def score_bin(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.maximum(score, 0) / BIN_STEP), 0, BINS - 1).astype(np.int64)


_KEPT = {enc: np.zeros(128, dtype=bool) for enc in ENCODINGS}
for _enc in ("base32", "base64"):
    _KEPT[_enc][[*range(65, 91), *range(97, 123)]] = True
_KEPT["hex"][[*range(48, 58), *range(97, 103)]] = True
_UPPER = np.arange(128)
_UPPER[97:123] -= 32
NULL_WIDTHS = tuple(n + n // 4 for n in CLASSES)


def null_strings(text: str, taken: list[tuple[int, int]]) -> dict[str, list[np.ndarray]]:
    """For each encoding and length class, rows of ordinary symbols: all of the text's outside ``taken``, dealt in order to the classes in turn."""
    if taken:
        bounds = [0, *(x for span in taken for x in span), len(text)]
        text = "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
    codes = np.frombuffer(text.encode("ascii", "ignore"), np.uint8)
    ends = np.cumsum(NULL_WIDTHS).tolist()
    out = {}
    for enc, kept in _KEPT.items():
        own = codes[kept[codes]]
        rounds = len(own) // ends[-1]
        whole, rest = own[: rounds * ends[-1]].reshape(rounds, ends[-1]), own[rounds * ends[-1] :]
        out[enc] = [np.concatenate((whole[:, e - w : e], rest[None, e - w : e])) if len(rest) >= e else whole[:, e - w : e] for w, e in zip(NULL_WIDTHS, ends)]
    return out


def null_symbols(enc: str, codes: np.ndarray) -> np.ndarray:
    """Symbol values of a null string's characters."""
    return TABLES[enc][_UPPER[codes] if enc == "base32" else codes]


def null_counts(drawn: list[dict[str, list[np.ndarray]]]) -> np.ndarray:
    """How many null strings of all texts fall into each histogram cell."""
    counts = np.zeros(len(CLASSES) * len(ENCODINGS) * BINS, dtype=np.int64)
    for e, (enc, size) in enumerate(ENCODINGS.items()):
        for k, width in enumerate(NULL_WIDTHS):
            rows = np.concatenate([np.zeros((0, width), np.uint8), *(own[enc][k] for own in drawn)])
            for a in range(0, len(rows), SCORE_ROWS):
                grid = null_symbols(enc, rows[a : a + SCORE_ROWS])
                np.add.at(counts, (k * len(ENCODINGS) + e) * BINS + score_bin(battery(grid, np.full(len(grid), width), size)), 1)
    return counts


_SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>, starts array<int>, ends array<int>, encodings array<string>, bins array<int>, nulls array<struct<cell:int,n:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("encodings", pa.list_(pa.string())), ("bins", pa.list_(pa.int32())), ("nulls", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())])))])
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            batch = whole.slice(a, 512)
            rows, pending, drawn = [], {k: [] for k in ENCODINGS}, []
            for i, text in enumerate(batch.column(1).to_pylist()):
                spans = base_spans(text)
                order = sorted((s, k, e) for k, kind in enumerate(KINDS[:3]) for s, e in spans[kind])
                base = [f"{KINDS[k]}:{s}:{e}" for s, k, e in order]
                row = {"n_assign": len(spans["assign"]), "n_access": len(spans["access"]), "n_hex": len(spans["hex"]), "base": base, "base_sha256": hashlib.sha256(",".join(base).encode()).hexdigest(), "starts": [], "ends": [], "encodings": [], "bins": [], "nulls": []}
                runs = list(CANDIDATE.finditer(text))
                for m in runs:
                    if enc := encoding_of(m.group()):
                        pending[enc].append((i, len(row["starts"]), TABLES[enc][np.frombuffer(m.group().rstrip("=").encode(), np.uint8)]))
                        row["starts"].append(m.start())
                        row["ends"].append(m.end())
                        row["encodings"].append(enc)
                        row["bins"].append(0)
                drawn.append(null_strings(text, [m.span() for m in runs]))
                rows.append(row)
            for enc, size in ENCODINGS.items():
                for (i, at, _), b in zip(pending[enc], score_bin(scores([x[2] for x in pending[enc]], size)).tolist()):
                    rows[i]["bins"][at] = b
            # the slice's counts stand in its first row
            counts = null_counts(drawn)
            rows[0]["nulls"] = [{"cell": int(c), "n": int(counts[c])} for c in np.flatnonzero(counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:])], schema=schema)


def cell(n: int, enc: str, b: int) -> int:
    return (length_class(n) * len(ENCODINGS) + list(ENCODINGS).index(enc)) * BINS + b


def limits(candidates: np.ndarray, nulls: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Largest accepted score bin of each length class and encoding by Benjamini-Hochberg; -1 for none.

    Both arguments: counts by [class * encodings + encoding, bin].
    """
    below, null = candidates.cumsum(1), nulls.cumsum(1)
    p = (1 + null) / (1 + null[:, -1:])
    ok = (p <= rate * below / np.maximum(below[:, -1:], 1)) & (below > 0)
    return np.where(ok.any(1), BINS - 1 - ok[:, ::-1].argmax(1), -1)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """All secrets of every text: (doc_id, n_assign, n_access, n_hex, base_sha256, spans array<string>).

    Spans are kind:start:end in code points, end exclusive, of whole matches,
    by start and then kind; kind ``random`` is what the battery adds, where it
    meets no base span. Base spans always stay. Null text counts as empty (no
    spans); rows repeat as they come, doc_id may be null; columns other than
    doc_id and text are not read; an empty table gives an empty table.
    """
    found = docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).mapInArrow(_scan, _SCAN)
    found = materialize(found, "secrets")
    seen = found.select(F.explode(F.transform(F.arrays_zip("starts", "ends", "encodings", "bins"), lambda x: _cell_column(x))).alias("cell"))
    drawn = found.select(F.inline("nulls")).groupBy("cell").agg(F.sum("n").alias("count"))
    counts = seen.groupBy("cell").count().withColumn("null", F.lit(False)).unionByName(drawn.withColumn("null", F.lit(True)))
    shape = (len(CLASSES) * len(ENCODINGS), BINS)
    tables = {False: np.zeros(shape), True: np.zeros(shape)}
    for r in counts.collect():  # at most classes x encodings x bins x 2 rows, whatever the input
        tables[r["null"]][divmod(r["cell"], BINS)] += r["count"]
    accepted = limits(tables[False], tables[True], rate).tolist()

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for base, starts, ends, encs, bins in zip(df["base"], df["starts"], df["ends"], df["encodings"], df["bins"]):
                kept = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base)]
                meets = meeting((s, e) for s, _, e in kept)
                for s, e, enc, b in zip(starts, ends, encs, bins):
                    c, _ = divmod(cell(int(e) - int(s), enc, int(b)), BINS)
                    if b <= accepted[c] and not meets(int(s), int(e)):
                        kept.append((int(s), 3, int(e)))
                out.append([f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(kept)])
            yield pd.DataFrame({"doc_id": df["doc_id"], "n_assign": df["n_assign"], "n_access": df["n_access"], "n_hex": df["n_hex"], "base_sha256": df["base_sha256"], "spans": out})

    return found.drop("nulls").mapInPandas(spans, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<string>")


def _cell_column(x):
    """Histogram cell of a candidate, as ``cell`` computes it."""
    n = x["ends"] - x["starts"]
    klass = sum((F.when(n >= c, 1).otherwise(0) for c in CLASSES[1:]), F.lit(0))
    enc = F.array_position(F.array(*map(F.lit, ENCODINGS)), x["encodings"]).cast("int") - 1
    return (klass * len(ENCODINGS) + enc) * BINS + x["bins"]
