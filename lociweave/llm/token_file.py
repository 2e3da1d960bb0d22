"""Token ids as ORC: documents in ascending doc_id order, integer run lengths, row indexes, Bloom filters on doc_id.

Documents are range-partitioned by doc_id as text (so nothing is encoded twice for the range bounds), sorted, and
encoded while they stream to the writer. Each file holds one range; each row keeps the number of ids before it in
its own range, so a reader adds one offset per range: any stripe can be read alone, and doc_id predicates skip
stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import groups_of, prepared, scratch, table, texts
from .token_counts import MARKS, byte_alphabet

END_ID = 1
FILES = "doc_id bigint, part int, before bigint, n_tokens bigint, ids array<int>"
ORC = {"orc.compress": "ZSTD", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
#: Chunks in a Python worker's table, and in each of the two generations of its cache for texts beyond Latin-1.
CACHE = 400_000
#: Bytes of the longest word that is merged with many others, a power of two; longer ones go to the library.
LONGEST = 1 << (BITS := 6)
_LATIN = [chr(b) for b in range(256)]
_LOWER = "".join(_LATIN).lower().encode("latin-1")
#: Letters and digits, white space, all else.
_KINDS = "".join("a" if c.isalpha() or c in "0123456789" else " " if c.isspace() else "!" for c in _LATIN).encode()
_SPACES = bytes(c.isspace() for c in _LATIN)
#: Bytes of the longest chunk in the table of chunks: three integers, but for the length.
SHORT = 23
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_CONTROL = "\x1c\x1d\x1e\x1f"  # split by str.split, but not white space to the tokenizer


class WordMerges:
    """The byte-level BPE of lower-case words of letters, a merge in each of many words at a time.

    Words are taken by the tokens they have just now, most first: of those with n tokens, every word whose best pair can merge has n - 1
    afterwards, and joins the words of n - 1 bytes. So a step is a few operations on whole columns, and words in it need no padding.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, self.made = (np.array(x, np.int32) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], strict=True))
        self.none, self.vocabulary = len(pairs), max(vocab.values()) + 1
        self.slots = (4 * len(pairs)).bit_length()
        self._table(left.astype(np.int64) * self.vocabulary + right)
        order = sorted((b, c) for c, b in byte_alphabet().items())
        self.inner, self.last = (np.array([vocab[c + x] for _, c in order], np.int32) for x in ("", end))
        self.first, self.final = (self._ranks(np.repeat(self.inner, 256), np.tile(x, 256)).reshape(256, 256) for x in (self.inner, self.last))

    def _table(self, codes: np.ndarray) -> None:
        """An open hash table from pairs to their ranks."""
        self.keys, self.rank = np.full(1 << self.slots, -1), np.full(1 << self.slots, self.none, np.int32)
        at, todo = self._slot(codes), np.arange(len(codes))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = codes[free]
            won = free[self.keys[at[free]] == codes[free]]
            self.rank[at[won]] = won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (1 << self.slots) - 1

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots)).view(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges; ``none`` if it isn't there."""
        codes = left.astype(np.int64) * self.vocabulary + right
        at = self._slot(codes)
        key, out = self.keys[at], self.rank[at]
        todo = np.flatnonzero((key != codes) & (key >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (1 << self.slots) - 1
            key = self.keys[at[todo]]
            out[todo] = self.rank[at[todo]]
            todo = todo[(key != codes[todo]) & (key >= 0)]
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of at most LONGEST bytes, none of them empty, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for i in range(0, len(words), 16_384):
            out += self._some(words[i : i + 16_384])
        return out

    def _some(self, words: list[str]) -> list[bytes]:
        raw = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        size = np.diff(ends, prepend=-1) - 1
        by_size = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[by_size], np.arange(size.max() + 2))
        out = np.empty(len(words), object)
        which, tokens, ranks = np.zeros(0, np.int64), np.zeros((size.max(), 0), np.int32), np.zeros((size.max() - 1, 0), np.int32)
        for n in range(size.max(), 0, -1):
            if len(own := by_size[bounds[n] : bounds[n + 1]]):
                data = raw[(ends[own] - n) + np.arange(n)[:, None]]
                fresh = self.inner[data]
                fresh[-1] = self.last[data[-1]]
                which, tokens = np.concatenate([which, own]), np.concatenate([tokens, fresh], 1)
                pairs = self.first[data[:-1], data[1:]]
                pairs[-1:] = self.final[data[-2:-1], data[-1:]]
                ranks = np.concatenate([ranks, pairs], 1)
            best = ((ranks << BITS) + np.arange(n - 1, dtype=np.int32)[:, None]).min(0, initial=self.none << BITS)  # of equal pairs the first
            ready = best == self.none << BITS
            if ready.any():
                out[which[ready]] = np.ascontiguousarray(tokens[:, ready].T.astype("<u4")).view(f"V{4 * n}").ravel().tolist()
                go = ~ready
                which, tokens, ranks, best = which[go], tokens[:, go], ranks[:, go], best[go]
            if n == 1:
                break
            at, made, col = best & LONGEST - 1, self.made[best >> BITS], np.arange(len(which))
            tokens[at, col] = made
            for i in range(1, n - 1):
                np.copyto(tokens[i], tokens[i + 1], where=at < i)
            for i in range(n - 2):
                np.copyto(ranks[i], ranks[i + 1], where=at <= i)
            tokens, ranks = tokens[:-1], ranks[:-1]
            c = np.flatnonzero(at > 0)
            ranks[at[c] - 1, c] = self._ranks(tokens[at[c] - 1, c], made[c])
            c = np.flatnonzero(at < n - 2)
            ranks[at[c], c] = self._ranks(made[c], tokens[at[c] + 1, c])
        return out.tolist()


class ChunkTable:
    """Ids of short Latin-1 chunks, looked up many at a time: an open hash table whose keys are the chunks' bytes and lengths themselves."""

    def __init__(self):
        self.slots = (2 * CACHE).bit_length()
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks. Row 0 is that of a free slot."""
        self.table = np.zeros((1 << self.slots, 4), np.uint64)
        self.rows, self.used = 1, 0
        self.at, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def keys(self, raw: bytes, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bytes and length of each chunk of at most SHORT bytes, in three integers; raw goes on for SHORT + 1 bytes after the last."""
        out = np.empty((3, len(starts)), np.uint64)
        for lo in range(0, len(raw), 1 << 19):  # all runs of eight bytes of a part of the text at once
            a, b = np.searchsorted(starts, [lo, lo + (1 << 19)])
            if a < b:
                runs = np.ndarray((min(len(raw) - lo, (1 << 19) + SHORT + 1) - 7,), "<u8", raw, lo, (1,)).astype(np.uint64)
                for i in range(3):
                    out[i, a:b] = runs[starts[a:b] - lo + 8 * i] & _MASKS[np.clip(size[a:b] - 8 * i, 0, 8)]
        out[2] |= size.astype(np.uint64) << np.uint64(56)
        return out

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) + keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[2] * np.uint64(0x165667B19E3779F9)
        return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (self._hash(keys) >> np.uint64(64 - self.slots)).view(np.int64)

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each different key is, and for each key which of them it is."""
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        new = np.diff(h[order], prepend=~h[order[:1]]) != 0
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        fresh = order[new]
        if (keys != keys[:, fresh[which]]).any():  # two keys of one hash
            _, fresh, which = np.unique(keys, axis=1, return_index=True, return_inverse=True)
        return fresh, which.reshape(-1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of chunks, 0 for those not in the table."""
        at, out, todo = self._slot(keys), np.zeros(keys.shape[1], np.int64), np.arange(keys.shape[1])
        while len(todo):
            got = self.table.take(at, 0)
            same = (got[:, 0] == keys[0]) & (got[:, 1] == keys[1]) & (got[:, 2] == keys[2]) & (got[:, 3] > 0)
            out[todo[same]] = got[same, 3].view(np.int64)
            on = np.flatnonzero(~same & (got[:, 3] > 0))
            todo, keys, at = todo[on], keys[:, on], at[on] + 1 & (1 << self.slots) - 1
        return out

    def put(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """Enters different chunks that are not in the table."""
        self.used += len(rows)
        at = self._slot(keys)
        while len(rows):
            free = np.flatnonzero(self.table[at, 3] == 0)
            self.table[at[free], 3] = rows[free]
            won = self.table[at, 3].view(np.int64) == rows
            self.table[at[won], :3] = keys[:, won].T
            rows, keys, at = rows[~won], keys[:, ~won], at[~won] + 1 & (1 << self.slots) - 1

    def add(self, ids: list[bytes]) -> np.ndarray:
        """New rows with these ids."""
        size, rows = np.array([len(x) // 4 for x in ids], np.int64), self.rows + np.arange(len(ids))
        end = self.at[self.rows - 1] + self.size[self.rows - 1]
        self.rows += len(ids)
        if self.rows > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(self.rows, np.int64)]) for x in (self.at, self.size))
        self.at[rows], self.size[rows] = end + np.cumsum(size) - size, size
        if (most := end + size.sum()) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(most, np.uint32)])
        self.flat[end:most] = np.frombuffer(b"".join(ids), "<u4")
        return rows


class ChunkEncoder:
    """The ids of texts, by white-space-separated chunks: this tokenizer's pieces and special strings never span white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.table = WordMerges(path), ChunkTable()
        self.specials = [x.content.lower().encode("latin-1", "replace") for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, items: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _spaced(self, text: str) -> bytes | None:
        """A text of the same ids with fewer different chunks, in lower case, single points and commas apart from their words;
        None if it has characters beyond Latin-1 or what may be a special string."""
        try:
            low = text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return None
        if any(x in low for x in self.specials):
            return None
        if b"!! " not in low.translate(_KINDS):  # else a mark before a blank may be in one piece with the mark before it
            low = low.replace(b". ", b" . ").replace(b", ", b" , ")
        return low

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts in lower case, without special strings."""
        t = self.table
        if t.rows > CACHE:
            t.clear()
        raw = b"\n".join(texts) + b" " * (SHORT + 9)
        edges = np.flatnonzero(np.diff(np.frombuffer(raw.translate(_SPACES), np.bool_), prepend=True))
        starts, size = edges[::2], edges[1::2] - edges[::2]
        short, long = np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)
        keys = t.keys(raw, starts[short], size[short])
        found = t.find(keys)
        gaps = np.flatnonzero(found == 0)
        fresh, which = t.distinct(keys[:, gaps])
        new = gaps[fresh]
        at = np.concatenate([short[new], long])
        chunks = [raw[a:b].decode("latin-1") for a, b in zip(starts[at].tolist(), (starts + size)[at].tolist(), strict=True)]
        self._learn(set(chunks), known := {}, {})  # only the table keeps them
        added = t.add([known[c] for c in chunks])
        found[gaps] = added[which]
        rows = np.zeros(len(starts), np.int64)
        rows[short], rows[long] = found, added[len(new) :]
        if t.used + len(new) < 1 << t.slots - 1:
            t.put(added[: len(new)], keys[:, new])
        n = t.size[rows]
        ends = np.cumsum(n)
        ids = t.flat[np.repeat(t.at[rows] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4").tobytes()
        offsets = np.cumsum([0, *[len(x) + 1 for x in texts]])
        cuts = (4 * np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _normal(c: str, low: str) -> bool:
        """Whether a chunk that isn't ASCII begins, once normalised, with ``low``, its letters in lower case."""
        return max(c) <= "\xff" or (c.startswith(low) and unicodedata.is_normalized("NFC", low))

    def _learn(self, new: set[str], young: dict[str, bytes], old: dict[str, bytes]) -> None:
        """Ids of chunks: a word of letters and the marks after it are a piece each, other chunks go to the library."""
        kept = set(filter(old.__contains__, new))
        young.update(zip(kept, map(old.__getitem__, kept), strict=True))
        words, other, parts = set(), set(), []
        for c in new - kept:
            low = c.rstrip(MARKS).lower()
            if low.isalpha() and (c.isascii() or self._normal(c, low)) and (len(low) <= LONGEST // 4 or len(low.encode()) <= LONGEST):
                words.add(low)
                if c != low:
                    tail = c[len(low) :]
                    parts.append((c, low, tail))
                    if tail and tail not in young:
                        other.add(tail)
            else:
                other.add(c)
        words = list(words.difference(young))
        young.update(zip(words, self.merges.ids(words), strict=True))
        other = list(other)
        for i in range(0, len(other), 20_000):
            young.update(zip(other[i : i + 20_000], self._whole(other[i : i + 20_000]), strict=True))
        for c, low, tail in parts:
            young[c] = young[low] + young[tail] if tail else young[low]

    def _apart(self, items: list[str]) -> list[bytes]:
        """Ids of texts with any characters but those of _CONTROL."""
        split = [x.split() for x in items]
        self._learn({c for s in split for c in s}.difference(self.young), self.young, self.old)
        get = self.young.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def encode(self, items: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        odd = {i for i, x in enumerate(items) if any(c in x for c in _CONTROL)}
        low = {i: y for i, x in enumerate(items) if i not in odd and (y := self._spaced(x)) is not None}
        rest = [i for i in range(len(items)) if i not in odd and i not in low]
        out = {i: self._whole([items[i]])[0] for i in odd}
        out.update(zip(low, self._together(list(low.values())), strict=True))
        out.update(zip(rest, self._apart([items[i] for i in rest]), strict=True))
        return [out[i] for i in range(len(items))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _encode(path: str | None, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, before = encoder(path or public_tokenizers.path("word_bpe_49k.json")), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            items = texts(batch)
            for lo, hi in groups_of(items):
                ids = [x + end for x in known.encode(items[lo:hi])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + offsets[:-1]), pa.array(n), lists], names=["doc_id", "part", "before", "n_tokens", "ids"])
                before += int(offsets[-1])

    return encode


def write_token_files(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of docs (doc_id, text) to ORC files in ascending doc_id order, nulls first, ties by text.

    Null texts are empty: the end id alone. Repeated documents are written each time. Other columns are ignored.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = rows.mapInArrow(_encode(tokenizer, end_id), FILES).write.mode("errorifexists")
    for k, v in ORC.items():
        writer = writer.option(k, v)
    writer.orc(to)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files; start is the number of ids of all documents before it."""
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", "256")
    files = spark.read.schema(FILES).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # one row for each range partition that was written, so bounded by the number of partitions
    return files.join(F.broadcast(ranges), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of every document, all from the files."""
    prepared(spark)
    return read_token_files(spark, path).select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenise(docs: DataFrame) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files hold of each."""
    write_token_files(docs, path := scratch(docs.sparkSession))
    return token_digests(docs.sparkSession, path)


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"))
