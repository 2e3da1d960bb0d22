"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

The last token of the encoding of a prefix is the one token that ends there and is compatible with the last
token of what stands before it; so one pass gives the counts of all prefixes. Tables are made for chunks (a word
with the space before it) and kept; the table of a text is their running sum. It answers how many tokens a prefix
has, whether a text keeps to a budget and where to cut it, with no further encoding.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import groups_of, prepared, table, texts

LIMIT = 1024
CACHE = 300_000
_PIECE = regex.compile(public_tokenizers.PATTERN)
#: What is never in one piece with a letter.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Contractions of two letters.
_CUT = {"'re", "'ve", "'ll"}


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Prefix tables under one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.specials = {x["content"] for x in spec["added_tokens"]}
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.rank: dict[bytes, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for b in range(256):
            self.rank[bytes([b])] = b
        # tokens numbered in the order of their merges: 256 + rank
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            pair = (self.rank[a], self.rank[b])
            self.rank.setdefault(a + b, 256 + i)
            self.halves.setdefault(256 + i, pair)
            self.merged[pair] = 256 + i
        self.longest = max(map(len, self.rank))
        self.fits: dict[int, bool] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials)))) if self.specials else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of both tokens gives just these two: undo merges, latest first, on either
        side of the boundary; none of the pairs met there may merge before the merges yet to be undone."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        first, bound, ok = key, 1 << 60, True
        while True:
            if self.merged.get((a, b), 1 << 61) < bound:
                ok = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # a was made after b: take its right half
                bound, a = a, self.halves[a][1]
            else:
                bound, b = b + 1, self.halves[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[first] = ok
        return ok

    def pieces(self, items: Iterable[bytes]) -> Iterator[list[int]]:
        """Token counts of all prefixes of each piece, in bytes, the empty one first.

        The counts of a prefix depend on nothing after it, so a piece keeps what it shares with the one before it.
        """
        rank, compatible, most = self.rank, self.compatible, self.longest
        before, count, last = b"", [0], [-1]
        for data in items:
            k, n = 0, min(len(before), len(data))
            while k < n and before[k] == data[k]:
                k += 1
            del count[k + 1 :], last[k + 1 :]
            for i in range(k + 1, len(data) + 1):
                for j in range(i - 1, max(-1, i - most - 1), -1):
                    t = rank.get(data[j:i])
                    if t is not None and (j == 0 or compatible(last[j], t)):
                        count.append(count[j] + 1)
                        last.append(t)
                        break
            before = data
            yield count

    def piece(self, data: bytes) -> list[int]:
        return next(self.pieces([data]))

    def chunk(self, text: str) -> list[int]:
        """Counts of the non-empty prefixes, in characters, of a text without special strings."""
        out: list[int] = []
        base, blank = 0, ""
        for p in _PIECE.findall(text):
            data = p.encode("utf-8", "surrogatepass")
            counts = self.piece(data)
            if len(data) == len(p):
                out += [base + c for c in counts[1:]]
            else:
                at = 0
                for c in p:
                    at += len(c.encode("utf-8", "surrogatepass"))
                    out.append(base + counts[at])
            if p in _CUT:  # before its last letter the prefix holds an apostrophe and a word
                out[-2] = base + 2
            if blank:  # a prefix that ends with white space has all of it in one piece
                out[len(out) - len(p)] = blank_base + self.piece((blank + p[0]).encode())[-1]
            blank, blank_base = (p, base) if p.isspace() else ("", 0)
            base += counts[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Prefix table of any text; entry i is the token count of its first i + 1 characters.

        A special string is one token; while a prefix holds only part of it, that part is plain text.
        """
        if not text:
            return np.zeros(0, np.int64)
        if "<|" not in text or self.special is None or not self.special.search(text):
            return self._plain(text)
        out, base, at = [], 0, 0
        for m in self.special.finditer(text):
            out.append(base + self._plain(text[at : m.end() - 1]))
            before = self._plain(text[at : m.start()])
            base += 1 + (int(before[-1]) if len(before) else 0)
            out.append(np.array([base]))
            at = m.end()
        return np.concatenate([*out, base + self._plain(text[at:])])

    def many(self, items: list[str]) -> Iterator[np.ndarray]:
        """Prefix tables of some texts, whose new words are learned together."""
        split = [None if not x or "<|" in x else self._split(x) for x in items]
        odd = iter([self.counts(x) for x, chunks in zip(items, split, strict=True) if chunks is None])
        self._learn({c for x in split if x for c in x})
        for x, chunks in zip(items, split, strict=True):
            yield next(odd) if chunks is None else self._sum(x, chunks)

    @staticmethod
    def _split(text: str) -> list[str] | None:
        """A text's chunks; None if it has other white space than single blanks and line feeds."""
        words = text.replace("\n", " ").split(" ")
        if words != text.split():  # other white space, or more than one at a place
            return None
        words = text.replace("\n", " \n ").split(" ")  # a line feed is a piece of its own here
        return [words[0], *[w if w == "\n" or b == "\n" else f" {w}" for b, w in zip(words, words[1:], strict=False)]]

    def _plain(self, text: str) -> np.ndarray:
        chunks = self._split(text)
        if chunks is None:
            return np.array(self.chunk(text), np.int64)
        self._learn(set(chunks))
        return self._sum(text, chunks)

    def _sum(self, text: str, chunks: list[str]) -> np.ndarray:
        tables = [self.young[c] for c in chunks]
        if b"" in tables:  # a chunk that may have more tokens than a table can hold
            return np.array(self.chunk(text), np.int64)
        flat = np.frombuffer(b"".join(tables), "<u2")
        size = np.fromiter(map(len, tables), np.int64, len(tables)) // 2
        ends = np.cumsum(size)
        last = flat[ends - 1].astype(np.int64)
        return flat + np.repeat(np.cumsum(last) - last, size)

    def _learn(self, chunks: set[str]) -> None:
        """Tables of chunks: words of letters and the marks after them are a piece each, and are taken in order, so that they share
        beginnings; others by themselves."""
        new = chunks.difference(self.young)
        if len(self.young) > CACHE:  # the tables asked for stay
            self.young, self.old = {c: self.young[c] for c in chunks.difference(new)}, self.young
        young, old = self.young, self.old
        words, marked = set(), []
        for c in new:
            t = old.get(c)
            if t is None:
                word = c.rstrip(MARKS)
                if word.lstrip(" ").isalpha() and len(c) < 65_536:
                    if word not in young:
                        words.add(word)
                    if len(word) < len(c):
                        tail = c[len(word) :]
                        if tail not in young:
                            words.add(tail)
                        marked.append((c, word, tail))
                    continue
                t = np.array(self.chunk(c), "<u2").tobytes() if len(c) < 65_536 else b""
            young[c] = t
        coded = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        for (data, w), counts in zip(coded, self.pieces(d for d, _ in coded), strict=True):
            if len(data) != len(w):  # counts where characters end
                ends = [i + 1 for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]
                young[w] = array("H", [counts[i] for i in ends]).tobytes()
            else:
                young[w] = array("H", counts[1:]).tobytes()
        for c, word, tail in marked:  # the marks are a piece of their own
            t = array("H", young[word])
            t.extend([t[-1] + n for n in array("H", young[tail])])
            young[c] = t.tobytes()


def within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, by its prefix table."""
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _measure(path: str | None, limit: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path or public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            n, fit, items = [], [], texts(batch)
            for lo, hi in groups_of(items, 2 << 20):
                for x, counts in zip(items[lo:hi], known.many(items[lo:hi]), strict=True):
                    n.append(int(counts[-1]) if len(counts) else 0)
                    fit.append(len(x) if n[-1] <= limit else within(counts, limit))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    return measure


def token_counts(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and the characters of its longest prefix within the limit.

    Null and empty texts have no bytes and no tokens. Repeated documents give a row each; other columns are ignored.
    """
    prepared(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measure(tokenizer, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint")


def prefix_tables(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id with the whole prefix table of its text (array<int>): the token count of each non-empty prefix in characters."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([known.counts(x).astype(np.int32) if x else [] for x in texts(batch)], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    prepared(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tables, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
