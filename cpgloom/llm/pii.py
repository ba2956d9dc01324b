"""Personal data: weak-supervision labelers, expectation-maximisation, and a span classifier.

One map over the texts finds candidate spans and lets labelers vote on each:
fixed patterns, validity rules, gazetteers and context words. The corpus is then
counted by kind and vote pattern, a table of fixed size, on which
expectation-maximisation estimates each labeler's reliability and each pattern's
probability of being personal data; base spans count as true, and candidates
that break the rules of their kind as false. These soft labels, with the shape features
of the spans, train a logistic span classifier, again on counts by feature
pattern. Base spans always stay. Further candidates are matches of looser
patterns, and matches of the base patterns that failed their check, which the
pattern labeler votes against; a candidate becomes a span where the classifier
says so and it meets no base span.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import materialize, meeting, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns (a pattern's first character can only follow what cannot continue it backwards).
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser patterns for further candidates.
SPOKEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63})+")
LOCAL_PHONE = re.compile(r"(?<![A-Za-z0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
DIALLED_PHONE = re.compile(r"(?<![A-Za-z0-9+.-])00[1-9][0-9]?[ ()-][0-9 ()-]{5,16}[0-9](?![0-9-])")
LONG_IP = re.compile(r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:.])")
#: Words before a span, with which it is looked at in context.
CONTEXT = 48
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|reach|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|master|amex|credit|debit|payment|account)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact)\b"),
}
AGAINST = re.compile(r"(?i)(?:\b(?:isbn|version|build|release|order|invoice|doi|page|section|example)\b|[$€£#§])\W*$")
# Gazetteers of top-level domains and of country calling codes.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co ai dev app me de fr es it uk us ca au nl ch at be se no dk fi pl pt br mx ar jp cn in ru eu".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CARD_LEADS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "65", "35", "2")

LABELERS = ("pattern", "valid", "gazetteer", "context", "against")
PATTERN, VALID = 0, 1
#: Threshold of the classifier; rounds of expectation-maximisation.
THRESHOLD, ROUNDS = 0.5, 50
#: Odds that a pattern's votes are judged against at first: a labeler is right so often.
FIRST_RIGHT = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and dotted domain; each holds exactly one @, so the search goes from @ to @."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > low and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at)):
            out.append((a, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", low)
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base spans of each kind, and the matches that fail their check but are near enough to be looked at."""
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    failed: list[tuple[str, int, int]] = []
    for m in IP.finditer(text):
        sound = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        out["ip"].append(m.span()) if sound else failed.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19:
            if len(d) >= 16 and luhn(d):
                out["card"].append(m.span())
            elif len(d) >= 16 or luhn(d):
                failed.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        n = len(digits_of(m.group()))
        if 8 <= n <= 15:
            out["phone"].append(m.span())
        elif n == 7:
            failed.append(("phone", *m.span()))
    return out, failed


def votes(text: str, kind: str, s: int, e: int, pattern: int) -> tuple[int, ...]:
    """A vote of each labeler: 1 for, -1 against, 0 none; ``pattern`` is that of the base patterns."""
    span, before = text[s:e], text[max(0, s - CONTEXT) : s]
    digits = digits_of(span)
    if kind == "email":
        top = re.split(r"[.\s)\]]+", span.rstrip(" .)]"))[-1].lower()
        valid, known = (1 if ".." not in span and not span.startswith((".", "-")) else -1), (1 if top in TOP_LEVEL else -1)
    elif kind == "ip" and ":" in span:
        try:
            known = 1 if ipaddress.IPv6Address(span).is_global else 0
            valid = 1
        except ValueError:
            valid = known = -1
    elif kind == "ip":
        parts = span.split(".")
        valid = 1 if len(parts) == 4 and all(p == "0" or not p.startswith("0") and len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        known = -1 if parts[0] in ("0", "1", "2", "3") and len(span) < 9 else 1
    elif kind == "card":
        valid, known = (1 if luhn(digits) else -1), (1 if digits.startswith(CARD_LEADS) else -1)
    else:
        dialled = digits[2:] if span.startswith("00") else digits if span.startswith("+") else ""
        valid = 1 if 10 <= len(dialled or digits) <= 13 else -1
        known = 1 if dialled and any(dialled[:n] in CALLING for n in (1, 2)) else 0
    cue = 1 if CUES[kind].search(before) else 0
    return (pattern, valid, known, cue, -1 if AGAINST.search(before) else 0)


def features(kind: str, text: str, s: int, e: int, vote: tuple[int, ...]) -> str:
    """A categorical feature pattern: kind, votes, length class, separators and neighbours."""
    n = e - s
    length = "s" if n < 12 else "m" if n < 20 else "l"
    inner = text[s:e]
    joint = "".join(c for c in "-. (" if c in inner)
    edge = int(e < len(text) and text[e : e + 1].isalnum()) + 2 * int(s > 0 and text[s - 1].isalnum())
    return f"{kind}/{','.join(map(str, vote))}/{length}/{joint}/{edge}"


def candidates(text: str, base: dict[str, list[tuple[int, int]]], failed: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, feature pattern) of the base spans and of further candidates beside them."""
    out = [(kind, s, e, True, features(kind, text, s, e, votes(text, kind, s, e, 1))) for kind in KINDS for s, e in base[kind]]
    more = [(kind, s, e, -1) for kind, s, e in failed]
    if "(at)" in text or "[at]" in text:
        more += [("email", *m.span(), 0) for m in SPOKEN_EMAIL.finditer(text)]
    more += [("phone", *m.span(), 0) for m in LOCAL_PHONE.finditer(text)]
    if "00" in text:
        more += [("phone", *m.span(), 0) for m in DIALLED_PHONE.finditer(text)]
    if ":" in text:
        more += [("ip", *m.span(), 0) for m in LONG_IP.finditer(text)]
    if more:
        meets = meeting(span for kind in KINDS for span in base[kind])
        out += [(kind, s, e, False, features(kind, text, s, e, votes(text, kind, s, e, vote))) for kind, s, e, vote in more if not meets(s, e)]
    return out


_SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind:string,start:int,end:int,base:boolean,pattern:string>>"


def _scan_rows(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for text in texts:
        text = text or ""
        base, failed = base_spans(text)
        for kind in KINDS:
            out[f"n_{kind}"].append(len(base[kind]))
        out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k]).encode()).hexdigest())
        out["spans"].append([{"kind": k, "start": s, "end": e, "base": b, "pattern": p} for k, s, e, b, p in candidates(text, base, failed)])
    return out


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            rows = _scan_rows(part.column(1).to_pylist())
            arrays = [pa.array(rows[f"n_{k}"], pa.int64()) for k in KINDS] + [pa.array(rows["base_sha256"], pa.string()), pa.array(rows["spans"], _SPAN_TYPE)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def vote_pattern(pattern: str) -> tuple[str, tuple[int, ...]]:
    kind, vote = pattern.split("/")[:2]
    return kind, tuple(map(int, vote.split(",")))


def known(patterns: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """What needs no estimate: base spans (the pattern labeler votes for no others) are true, other candidates that break their kind's rules are not."""
    return {v: int(v[PATTERN] > 0) for v in patterns if v[PATTERN] > 0 or v[VALID] < 0}


def em(patterns: dict[tuple[int, ...], int], sure: dict[tuple[int, ...], int] | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """Reliabilities (chance that a vote is right, of each labeler) and the probability of each vote pattern.

    Latent class model: labelers vote independently given the truth. A labeler that
    votes both ways has a chance to be right on true and one on other spans, so a
    vote that it gives to everything says little; where it doesn't vote it says
    nothing. One that only ever votes for, or only against, has a rate of voting in
    either class. A vote for never counts against a span, nor the other way round.
    ``sure`` gives patterns that are known to be true (1) or not (0), as ``known``
    does. As one labeler's vote chose them, they don't count for its reliability,
    and their share says nothing of the others: without votes these are as likely
    true as not. Starts from FIRST_RIGHT.
    """
    rows = sorted(patterns)
    if not rows:
        return np.full(len(LABELERS), FIRST_RIGHT), {}
    v = np.array(rows)
    n = np.array([patterns[r] for r in rows], dtype=float)
    truth = np.array([(sure or {}).get(r, -1) for r in rows])
    counts = np.ones(v.shape, bool)
    counts[truth == 1, PATTERN] = counts[truth == 0, VALID] = False
    up, down = (v > 0) & counts, (v < 0) & counts
    lone = ~(up.any(0) & down.any(0))
    most, first = np.log(0.99 / 0.01), np.log(FIRST_RIGHT / (1 - FIRST_RIGHT))
    odds_up, odds_down = np.full(v.shape[1], first), np.full(v.shape[1], -first)
    for _ in range(rounds):
        p = np.where(truth < 0, 1 / (1 + np.exp(-(up @ odds_up + down @ odds_down))), truth)
        true, other = p * n, (1 - p) * n
        # votes for and against in both classes, each with the start's votes beside them
        a, b = true @ up + 2 * FIRST_RIGHT, true @ down + 2 * (1 - FIRST_RIGHT)
        c, d = other @ up + 2 * (1 - FIRST_RIGHT), other @ down + 2 * FIRST_RIGHT
        of_true, of_other = np.where(lone, true @ counts + 4, a + b), np.where(lone, other @ counts + 4, c + d)
        odds_up = np.clip(np.log(a / of_true) - np.log(c / of_other), 0, most)
        odds_down = np.clip(np.log(b / of_true) - np.log(d / of_other), -most, 0)
    agree = np.where(v > 0, p[:, None], 1 - p[:, None]) * (v != 0)
    right = (n @ agree + 2 * FIRST_RIGHT) / (n @ (v != 0) + 2)
    return right, dict(zip(rows, p.tolist()))


def _columns(pattern: str) -> list[str]:
    kind, vote, length, joint, edge = pattern.split("/")
    return ["bias", f"kind={kind}", *(f"{kind}:{l}={v}" for l, v in zip(LABELERS, vote.split(","))), f"{kind}:len={length}", f"{kind}:edge={edge}", *(f"{kind}:has={c}" for c in joint)]


def train(counts: dict[str, int], rounds: int = 300) -> dict[str, float]:
    """Probability of each feature pattern: a logistic regression on the soft labels of expectation-maximisation."""
    soft: dict[str, float] = {}
    for kind in KINDS:
        own: dict[tuple[int, ...], int] = {}
        for pattern, n in counts.items():
            k, v = vote_pattern(pattern)
            if k == kind:
                own[v] = own.get(v, 0) + n
        _, p = em(own, known(own))
        soft |= {pattern: p[vote_pattern(pattern)[1]] for pattern in counts if vote_pattern(pattern)[0] == kind}
    names = sorted({c for p in counts for c in _columns(p)})
    at = {c: i for i, c in enumerate(names)}
    rows = sorted(counts)
    x = np.zeros((len(rows), len(names)))
    for i, p in enumerate(rows):
        x[i, [at[c] for c in _columns(p)]] = 1
    y, n = np.array([soft[p] for p in rows]), np.log1p(np.array([counts[p] for p in rows], dtype=float))
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.01 * w
        curve = (x.T * (n * np.maximum(p * (1 - p), 1e-3))) @ x + 0.01 * np.eye(len(names))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return dict(zip(rows, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def classify(scanned: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``scanned`` with only its base spans and the further candidates that the trained classifier accepts."""
    counts = {r["pattern"]: r["count"] for r in scanned.select(F.explode("spans").alias("s")).groupBy(F.col("s.pattern").alias("pattern")).count().collect()}  # a fixed number of patterns
    probability = train(counts) if counts else {}
    accepted = sorted(p for p, x in probability.items() if x >= threshold)
    keep = F.filter("spans", lambda s: s["base"] | s["pattern"].isin(accepted)) if accepted else F.filter("spans", lambda s: s["base"])
    return scanned.withColumn("spans", keep)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Personal data of every text: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans array<struct>).

    Counts and digest are those of the base patterns; ``spans`` holds (kind,
    start, end, base, pattern) in code points, end exclusive, base spans first.
    Null text counts as empty; rows repeat as they come and doc_id may be null;
    columns other than doc_id and text are not read; an empty table gives an
    empty table.
    """
    found = docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).mapInArrow(_scan, _SCAN)
    return classify(materialize(found, "pii"), threshold)


def spans_string(spans) -> "F.Column":
    """All spans as kind:start:end, by kind as listed, then start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"])), ",")


def redact_text(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (and n_chars, if there, counted anew).

    The classifier is trained on the whole table as in ``scan``; the texts are
    then scanned again in place, so no text is shuffled. Null text stays null.
    """
    found = docs.select(F.lit(None).cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).mapInArrow(_scan, _SCAN)
    counts = {r["pattern"]: r["count"] for r in found.select(F.explode("spans").alias("s")).groupBy(F.col("s.pattern").alias("pattern")).count().collect()}
    accepted = {p for p, x in (train(counts) if counts else {}).items() if x >= threshold}

    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column(at).to_pylist()
                found = _scan_rows(texts)["spans"]
                kept = [[s for s in own if s["base"] or s["pattern"] in accepted] for own in found]
                out = [redact_text(t, k) if t is not None and k else t for t, k in zip(texts, kept)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(out, part.column(at).type), *part.columns[at + 1 :]], schema=part.schema)

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(clean, out.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
