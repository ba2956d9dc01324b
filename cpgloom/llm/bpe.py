"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that are not in the cache yet lie one after another in one
flat array of symbols. In each round every word finds its lowest-ranked pair, by
binary search of (left, right) in the sorted keys of all merges, and all its
places of that pair are joined from left to right. Words without a mergeable
pair leave the array. Which words exist depends on the text alone, so the
kernel runs inside a map over the documents, with no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import text_or_empty

# Letters (L) and numbers (N) that Unicode 16.0 has and Python's 15.1 tables have not.
UNICODE_16 = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


def ranges(kind: str, below: int) -> str:
    """Character class body of all code points under ``below`` whose category begins with ``kind``, S meaning white space."""
    extra = [c for a, b in UNICODE_16.get(kind, []) for c in range(a, b + 1) if c < below]
    if kind == "S":
        found = [c for c in range(below) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    else:
        found = sorted({c for c in range(below) if unicodedata.category(chr(c))[0] == kind} | set(extra))
    out, a = [], 0
    for i, c in enumerate(found):
        if i + 1 == len(found) or found[i + 1] != c + 1:
            out.append(f"\\U{found[a]:08x}-\\U{c:08x}")
            a = i + 1
    return "".join(out)


@cache
def splitter(below: int) -> re.Pattern:
    """The published word pattern, for texts of code points under ``below``.

    's 't 're 've 'm 'll 'd, or letters, numbers or other signs after an optional
    space, or white space up to the last before a word. The branches begin with
    different characters but for the apostrophe's, so the commonest come first.
    """
    letter, number, space = (ranges(k, below) for k in "LNS")
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return splitter(0x110000).findall(text)
    return splitter(0x100).findall(text)


#: Words kept in a worker's cache; it is emptied when full. Longer words are not kept.
CACHE_WORDS, CACHE_LENGTH = 300_000, 48
#: Characters of new words that go through the merge rounds at once.
ROUND_CHARS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The published printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder over a vocabulary file; ids as numpy uint32."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for word, i in vocab.items():
            # a special token's content isn't in the byte alphabet's terms; it stands for itself
            self.token[i] = word.encode() if word in self.special else bytes(byte_of[c] for c in word)
        for word, i in self.special.items():
            self.token[i] = word.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(printable_bytes().items(), key=lambda x: x[1])], dtype=np.int64)
        self.size = size
        left, right, joined = [], [], []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(vocab[a])
            right.append(vocab[b])
            joined.append(vocab[a + b])
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.joined = keys[order], order.astype(np.int64), np.array(joined, dtype=np.int64)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {s: np.uint32(i).tobytes() for s, i in self.special.items()}

    def ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each of the places; len(keys) where there is none."""
        none = len(self.keys)
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.size + symbols[after]
        found = np.searchsorted(self.keys, key)
        found[found == none] = 0
        return np.where((self.keys[found] == key) & (word[after] == word[at]) & (after > at), self.rank[found], none)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian uint32 bytes."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        done: list[bytes] = [b""] * len(words)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys)
        rank = self.ranks(symbols, word, np.arange(len(symbols))) if len(symbols) else symbols
        while len(symbols):
            firsts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.concatenate((firsts, [len(symbols)])))
            best = np.minimum.reduceat(rank, firsts)
            if (over := best == none).any():
                raw = symbols.astype("<u4").tobytes()
                for w, s, n in zip(word[firsts[over]].tolist(), firsts[over].tolist(), sizes[over].tolist()):
                    done[w] = raw[4 * s : 4 * (s + n)]
                stay = np.repeat(~over, sizes)
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                best, sizes = best[~over], sizes[~over]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            if not len(at):
                continue
            # in a run of overlapping places every second one is joined, from the left
            fresh = np.concatenate(([True], np.diff(at) != 1))
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.joined[rank[at]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            at = at - np.arange(len(at))  # where the joined symbols stand now
            near = np.concatenate((at, at[at > 0] - 1))
            rank[near] = self.ranks(symbols, word, near)
        return done

    def learn(self, fresh: set[str], into: dict[str, bytes]) -> None:
        words, held = [], 0
        for w in [*fresh, None]:
            if w is None or held > ROUND_CHARS:
                into.update(zip(words, self.merge([x.encode("utf-8", "surrogatepass") for x in words])))
                words, held = [], 0
            if w is not None:
                words.append(w)
                held += len(w)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return words_of(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += words_of(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out, a = [], 0
        while a < len(texts):
            b, held, split, fresh = a, 0, [], set()
            while b < len(texts) and held <= ROUND_CHARS:
                split.append(w := self.split(texts[b]))
                fresh.update(w)
                held += len(texts[b])
                b += 1
            if len(self.cache) > CACHE_WORDS:
                self.cache = {s: np.uint32(i).tobytes() for s, i in self.special.items()}
            fresh.difference_update(self.cache)
            long = {w for w in fresh if len(w) > CACHE_LENGTH}
            self.learn(fresh - long if long else fresh, self.cache)
            rare: dict[str, bytes] = {}
            self.learn(long, rare)
            for words in split:
                if rare and not rare.keys().isdisjoint(words):
                    parts = [rare[w] if w in rare else self.cache[w] for w in words]
                else:
                    parts = map(self.cache.__getitem__, words)
                out.append(np.frombuffer(b"".join(parts), dtype="<u4"))
            a = b
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def load(path: str | None) -> ByteBPE:
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _rows(batches: Iterator[pa.RecordBatch], path: str | None, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = part.column(1).to_pylist()
            ids = bpe.encode_batch(texts)
            out = {"doc_id": part.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if keep_ids:
                out["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                out["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
            else:
                out["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token ids and the text decoded from them: (doc_id, n_tokens, ids array<int>, decoded).

    Null text counts as empty: no ids, empty decoded text. Rows repeat as they
    come and doc_id may be null. Columns other than doc_id and text are not read.
    An empty table gives an empty table. ``vocabulary`` is the path of a
    byte-level BPE file on every executor; by default that of the installed public_tokenizers.
    """
    return docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).mapInArrow(
        lambda b: _rows(b, vocabulary, True), "doc_id long, n_tokens long, ids array<int>, decoded string"
    )


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids (little-endian uint32) and of the decoded text."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).mapInArrow(
        lambda b: _rows(b, vocabulary, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
