"""Benchmark decontamination: suffix arrays over shards of the training text, searched with every benchmark suffix.

A shard is a few megabytes of documents. Its words become ids in the benchmark's vocabulary (0: any other word). A
suffix is live if its first window (ten words, or all words of a shorter item) is one of the benchmark's, which a sorted table
of window hashes tells; others match nothing and are in no array, which loses no match. Live suffixes of the shard are sorted by
all their words (prefix doubling, together with the benchmark's suffixes that have the same windows); each of those is then
binary-searched in the shard's array, and common prefixes with the neighbours found are the longest verbatim matches, with their
places in both texts. The benchmark is broadcast in blocks of bounded size. One block, the usual case, is one map pass
without a shuffle; more blocks are a pass each, never two in one task, whose thin results are put together by key.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepared, groups_of, table, texts, written

WINDOW = 10
#: Characters of benchmark text in one broadcast block; an item is never cut.
BLOCK_CHARS = 8 << 20
#: Characters of training text in one shard; a longer text is one by itself.
SHARD_CHARS = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[65:91] = _WORD_BYTE[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE, np.uint64)]))


def shard_words(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """(hash, start, document) of each word, the folded bytes, the end of each word. Equal words, equal hashes."""
    raw = [x.encode("utf-8", "surrogatepass") for x in items]
    data = b"\n".join(raw) + b"\n"
    b = _FOLD[np.frombuffer(data, np.uint8)]
    mask = _WORD_BYTE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, b.tobytes(), none
    at = np.flatnonzero(mask)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    hashes = np.add.reduceat(_VALUE[b[at]] * _powers(int(size.max()))[place], first)
    begins = np.cumsum([0] + [len(x) + 1 for x in raw[:-1]])
    return hashes, starts, np.searchsorted(begins, starts, "right") - 1, b.tobytes(), ends


@dataclass
class Block:
    """Some benchmark items: their words as ids, a 0 after each item, and all their windows by width.

    windows: width to (sorted hashes of the distinct windows, positions of the equal ones, where those of each begin).
    """

    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spelled: bytes = b""
    spelled_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    line: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: list[str | None] = field(default_factory=list)
    factor: np.uint64 = np.uint64(1)
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def word(self, i: int) -> bytes:
        return self.spelled[self.spelled_at[i - 1] : self.spelled_at[i]]


def window_hashes(values: np.ndarray, at: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of the ``width`` values from each place on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * factor + values[at + j]
    return out


def build_block(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block:
    """Words and windows of (item id, text) pairs, in order of id and text; items without words are left out."""
    items = sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1] or ""))
    hashes, owner, spelled = [], [], {}
    for lo, hi in groups_of([x or "" for _, x in items], 1 << 20):
        h, start, text, data, end = shard_words([x or "" for _, x in items[lo:hi]])
        hashes.append(h)
        owner.append(text + lo)
        _, one = np.unique(h, return_index=True)
        for i in one.tolist():
            if spelled.setdefault(int(h[i]), word := data[start[i] : end[i]]) != word:
                raise ValueError("two words have one hash")
    hashes, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner))
    if not len(hashes):
        return Block()
    vocabulary = np.array(sorted(spelled), np.uint64)
    words = [spelled[x] for x in vocabulary.tolist()]
    held, count = np.unique(owner, return_counts=True)
    begins = np.cumsum(count + 1) - (count + 1)
    line = np.zeros(int(count.sum()) + len(count), np.int32)
    line[np.arange(len(hashes)) + np.searchsorted(held, owner)] = np.searchsorted(vocabulary, hashes) + 1
    place = np.concatenate([[np.uint64(0)], vocabulary])[line]
    at: dict[int, np.ndarray] = {}
    for width in np.unique(np.minimum(count, window)).tolist():
        own = np.flatnonzero(np.minimum(count, window) == width)
        at[width] = np.concatenate([np.arange(b, b + n - width + 1) for b, n in zip(begins[own].tolist(), count[own].tolist(), strict=True)])
    factor = np.uint64(_BASE)
    while True:  # another factor should two windows share a hash
        windows = {}
        for width, where in at.items():
            distinct, kind = np.unique(as_key(line[where[:, None] + np.arange(width)]), return_inverse=True)
            order = np.argsort(kind, kind="stable")
            first = np.searchsorted(kind[order], np.arange(len(distinct) + 1))
            found = window_hashes(place, where[order[first[:-1]]], width, factor)
            rank = np.argsort(found)
            size = np.diff(first)[rank]
            starts = np.concatenate([[0], np.cumsum(size)])
            moved = np.repeat(first[:-1][rank] - starts[:-1], size) + np.arange(len(where))
            windows[width] = found[rank], where[order[moved]].astype(np.int32), starts
        if all(len(np.unique(x)) == len(x) for x, _, _ in windows.values()):
            break
        factor = factor * np.uint64(_BASE)
    return Block(vocabulary, b"".join(words), np.cumsum([0, *map(len, words)]), line, begins, [items[i][0] for i in held.tolist()], factor, windows)


def as_key(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort alike."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def suffix_levels(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places of a text by their first 1, 2, 4, ... words, up to the order of whole suffixes; ends are -1.

    Every 0 ends a text and is unlike all others, so that words beyond it never count.
    """
    text = text.astype(np.int64)
    end = np.flatnonzero(text == 0)
    text[end] = text.max(initial=0) + 1 + np.arange(len(end))
    levels, h = [np.unique(text, return_inverse=True)[1].astype(np.int64)], 1
    while levels[-1].max(initial=0) + 1 < len(text):
        r = levels[-1]
        after = np.full(len(r), -1)
        after[: len(r) - h] = r[h:] if h < len(r) else after[: len(r) - h]
        levels.append(np.unique(r * (len(r) + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        h *= 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at places a and b have in common."""
    out, n = np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        r = levels[k]
        out += np.where((x < n) & (y < n) & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]), 1 << k, 0)
    return out


@dataclass
class Matches:
    """Of a shard: words of each text; covered words of each as maximal spans; (text, item) pairs; and the longest matches
    as (text, first word, words, item, first word in the item)."""

    n_words: np.ndarray
    spans: list[tuple[int, int, int]] = field(default_factory=list)
    items: list[tuple[int, int]] = field(default_factory=list)
    longest: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def shard_matches(items: list[str], block: Block) -> Matches:
    """Verbatim windows of the block's items in some texts, and the longest matches by the shard's suffix arrays."""
    hashes, starts, doc, folded, ends = shard_words(items)
    out = Matches(np.bincount(doc, minlength=len(items)) if len(doc) else np.zeros(len(items), np.int64))
    if not len(block.vocabulary) or not len(doc):
        return out
    at = np.searchsorted(block.vocabulary, hashes)
    at[at == len(block.vocabulary)] = 0
    known = block.vocabulary[at] == hashes
    line = np.zeros(len(known) + len(items), np.int32)  # with a 0 after each text
    spot = np.arange(len(known)) + doc
    line[spot] = np.where(known, at + 1, 0)
    value = np.zeros(len(line), np.uint64)
    value[spot] = np.where(known, hashes, np.uint64(0))
    gaps = np.flatnonzero(line == 0)
    live, widths, kinds = [], [], []
    for width, (table_, of, first) in block.windows.items():
        begin = spot[known]
        begin = begin[gaps[np.searchsorted(gaps, begin)] - begin >= width]  # words in the vocabulary from here on
        h = window_hashes(value, begin, width, block.factor)
        k = np.searchsorted(table_, h)
        k[k == len(table_)] = 0
        hit = np.flatnonzero(table_[k] == h)
        begin, k = begin[hit], k[hit]
        same = (line[begin[:, None] + np.arange(width)] == block.line[of[first[k]][:, None] + np.arange(width)]).all(1)  # equal hashes, so nearly always
        live.append(begin[same])
        widths.append(np.full(int(same.sum()), width))
        kinds.append(k[same])
    live, width, kind = (np.concatenate(x) for x in (live, widths, kinds))
    cover = np.zeros(len(line) + 1, np.int64)
    np.add.at(cover, live, 1)
    np.add.at(cover, live + width, -1)
    cover = np.cumsum(cover)[:-1] > 0
    word = np.cumsum(np.bincount(spot, minlength=len(line))) - 1  # number of the word at a place
    wrong = [i for i in np.flatnonzero(cover).tolist() if folded[starts[word[i]] : ends[word[i]]] != block.word(int(line[i]))]
    if wrong:  # a word that only shares the hash of one of the block's
        line[wrong] = 0
        fine = np.array([not any(a <= i < a + w for i in wrong) for a, w in zip(live.tolist(), width.tolist(), strict=True)])
        live, width, kind = live[fine], width[fine], kind[fine]
        cover[:] = False
        for a, w in zip(live.tolist(), width.tolist(), strict=True):
            cover[a : a + w] = True
    if not len(live):
        return out
    text_of = np.zeros(len(line), np.int64)
    text_of[spot] = doc
    begins = np.searchsorted(doc, np.arange(len(items))) + np.arange(len(items))  # place of each text's first word
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    out.spans = [(int(text_of[a]), int(a - begins[text_of[a]]), int(b - begins[text_of[a]])) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
    found: list[tuple[int, int, int, int, int]] = []
    for w, (_, of, first) in block.windows.items():
        mine = width == w
        pair = np.unique(np.stack([text_of[live[mine]], kind[mine]], 1), axis=0)
        size = (first[pair[:, 1] + 1] - first[pair[:, 1]])
        every = np.repeat(first[pair[:, 1]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        place = of[every].astype(np.int64)
        owner = np.searchsorted(block.begins, place, "right") - 1
        out.items += [tuple(x) for x in np.unique(np.stack([np.repeat(pair[:, 0], size), owner], 1), axis=0).tolist()]
        if mine.any():  # a shorter item matches as a whole
            found += _longest(line, np.unique(live[mine]), block, np.unique(place), text_of, begins)
    text = end = -1
    for m in sorted(found, key=lambda m: (m[0], m[1], -m[2], m[3])):
        if m[0] != text or m[1] + m[2] > end:  # one within another isn't the longest
            text, end = m[0], m[1] + m[2]
            out.longest.append(m)
    return out


def _longest(line: np.ndarray, live: np.ndarray, block: Block, tested: np.ndarray, text_of: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Longest matches of live places of the shard with the benchmark places that share their windows."""

    def cut(text: np.ndarray, places: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, int]:
        """The stretches from the first place in each to its end, and where the places are in them."""
        gaps = np.flatnonzero(text == 0)
        stop = gaps[np.searchsorted(gaps, places)]
        first = np.concatenate([[True], stop[1:] != stop[:-1]])
        size = (stop - places + 1)[first]
        offset = np.cumsum(size) - size
        return [text[a : a + n] for a, n in zip(places[first].tolist(), size.tolist(), strict=True)], places + np.repeat(offset - places[first], np.diff(np.concatenate([np.flatnonzero(first), [len(places)]]))), int(size.sum())

    mine, a, n = cut(line, live)
    theirs, b, _ = cut(block.line, tested)
    b = b + n
    levels = suffix_levels(np.concatenate([*mine, *theirs]))
    rank = levels[-1]
    array, order = a[np.argsort(rank[a])], np.argsort(rank[b])  # the shard's suffix array; the benchmark's suffixes in order
    b, tested = b[order], tested[order]
    found = np.searchsorted(rank[array], rank[b])  # binary search: shard suffixes less than each of the benchmark's
    upto = np.searchsorted(found, np.arange(len(array)), "right")  # benchmark suffixes less than each of the shard's
    before, after = np.maximum(upto - 1, 0), np.minimum(upto, len(b) - 1)
    x, y = common_prefix(levels, array, b[before]), common_prefix(levels, array, b[after])
    words, partner = np.zeros(n, np.int64), np.zeros(n, np.int64)
    words[array], partner[array] = np.maximum(x, y), np.where(x >= y, before, after)
    text, item = text_of[live], tested[partner[a]]
    owner = np.searchsorted(block.begins, item, "right") - 1
    return list(zip(text.tolist(), (live - begins[text]).tolist(), words[a].tolist(), owner.tolist(), (item - block.begins[owner]).tolist(), strict=True))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) spans, as maximal spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


MATCH = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.ArrayType(MATCH))])
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])))])


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read through a local iterator: never all of it on the driver."""
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_chars:
            yield build_block(held)
            held, size = [], 0
    if held:
        yield build_block(held)


def _found(items: list[str], block: Block) -> list[dict]:
    """``hits`` of some texts."""
    out = []
    for lo, hi in groups_of(items, SHARD_CHARS):
        m = shard_matches(items[lo:hi], block)
        rows = [{"n_words": int(n), "spans": [], "items": set(), "longest": []} for n in m.n_words.tolist()]
        for d, s, e in m.spans:
            rows[d]["spans"].append((s, e))
        for d, i in m.items:
            if block.items[i] is not None:
                rows[d]["items"].add(block.items[i])
        for d, s, n, i, j in m.longest:
            rows[d]["longest"].append({"start": s, "words": n, "item_id": block.items[i], "item_start": j})
        out += [{**r, "items": sorted(r["items"])} for r in rows]
    return out


def _scan(shared, every: bool):
    """doc_id, the other columns but the text, and the hits of one block; of all texts or of those with any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _found(texts(batch), shared.value)
            rest = batch.select([c for c in batch.schema.names if c != "text"])
            out = pa.RecordBatch.from_arrays([*rest.columns, pa.array(hits, _HITS)], names=[*rest.schema.names, "hits"])
            yield out if every else out.filter(pa.array([bool(h["spans"]) for h in hits], pa.bool_()))

    return scan


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of several blocks as one."""
    for batch in batches:
        hits = []
        for parts in batch.column("hits").to_pylist():
            longest = sorted((m for p in parts for m in p["longest"]), key=lambda m: (m["start"], -m["words"], m["item_id"] is None, m["item_id"] or "", m["item_start"]))
            kept, end = [], -1  # a match within another one isn't the longest
            for m in longest:
                if m["start"] + m["words"] > end:
                    kept.append(m)
                    end = m["start"] + m["words"]
            hits.append({"n_words": parts[0]["n_words"], "spans": joined([tuple(s) for p in parts for s in p["spans"]]), "items": sorted({i for p in parts for i in p["items"]}), "longest": kept})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copies"), pa.array(hits, _HITS)], names=["doc_id", "copies", "hits"])


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs' doc_id with ``hits``: its words, the spans of words in windows of the benchmark, the ids of the items of these
    windows, and the longest verbatim matches with their places in the document and in one item that has them.

    A match is longest if no other in the document holds it. Null and empty texts have no words and no hit; null
    item ids count for spans and are not listed; repeated items are listed once; repeated documents give a row each; no items: no
    hits. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepared(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = rows.schema["doc_id"]
    shared = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, block_chars)] or [spark.sparkContext.broadcast(Block())]
    if len(shared) == 1:
        return rows.mapInArrow(_scan(shared[0], True), T.StructType([key, T.StructField("hits", HITS)]))
    rows = rows.withColumn("same", F.sha2("text", 256))
    shape = T.StructType([key, T.StructField("same", T.StringType()), T.StructField("hits", HITS)])
    out = None
    for i, block in enumerate(shared):
        part = rows.mapInArrow(_scan(block, not i), shape).withColumn("copies", F.lit(int(not i)))
        out = part if out is None else out.unionAll(part)
    # texts without hits need no putting together: their one row says all
    out = written(out)
    found = out.where(F.size("hits.spans") > 0).select("doc_id", "same").distinct()
    mine = [F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("same").eqNullSafe(F.col("_s"))]
    found = found.select(F.col("doc_id").alias("_d"), F.col("same").alias("_s"))
    alone = out.join(found, mine, "left_anti").select("doc_id", "hits")
    parts = out.join(found, mine, "left_semi").distinct().groupBy("doc_id", "same").agg(F.collect_list("hits").alias("hits"))
    copies = out.join(found, mine, "left_semi").groupBy("doc_id", "same").agg(F.sum("copies").alias("copies")).select(F.col("doc_id").alias("_d"), F.col("same").alias("_s"), "copies")
    one = parts.join(copies, mine).select("doc_id", "copies", "hits").mapInArrow(_together, T.StructType([key, T.StructField("copies", T.LongType()), T.StructField("hits", HITS)]))
    return alone.unionAll(one.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. See ``longest_matches`` for odd rows."""
    h = F.col("hits")
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return longest_matches(docs, benchmark, block_chars).select(
        "doc_id", h["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", h["items"]), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without those that hold a benchmark window; all columns as they were, whatever their names."""
    spark = docs.sparkSession
    prepared(spark)
    shared = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, block_chars)]
    if len(shared) < 2:
        return docs.mapInArrow(_clean(shared[0]), docs.schema) if shared else docs
    rows = docs.select(F.col("doc_id").alias("d"), F.sha2(F.col("text").cast("string"), 256).alias("s"), F.col("text").cast("string").alias("text"))
    shape = T.StructType([T.StructField("d", docs.schema["doc_id"].dataType), T.StructField("s", T.StringType())])
    bad = None
    for block in shared:
        part = rows.mapInArrow(_dirty(block), shape)
        bad = part if bad is None else bad.unionAll(part)
    tag = uuid.uuid4().hex
    bad = written(bad.distinct()).select(F.col("d").alias(f"d_{tag}"), F.col("s").alias(f"s_{tag}"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(f"d_{tag}")) & F.sha2(docs["text"].cast("string"), 256).eqNullSafe(F.col(f"s_{tag}")), "left_anti")


def _hit(items: list[str], block: Block) -> np.ndarray:
    """Which texts have a longest match, as the suffix arrays tell."""
    out = np.zeros(len(items), bool)
    for lo, hi in groups_of(items, SHARD_CHARS):
        out[[lo + d for d, *_ in shard_matches(items[lo:hi], block).longest]] = True
    return out


def _clean(shared):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_hit(texts(batch), shared.value)))

    return clean


def _dirty(shared):
    def dirty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["d", "s"]).filter(pa.array(_hit(texts(batch), shared.value)))

    return dirty


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with item as (select cast(item_id as varchar) as item, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
wide as (select item, w, least(len(w), {WINDOW}) as width from item where len(w) > 0),
win as (select distinct item, width, array_to_string(w[i:i + width - 1], ' ') as key
        from (select item, w, width, unnest(range(1, len(w) - width + 2)) as i from wide)),
doc as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
pos as (select r, w, unnest(range(1, len(w) + 1)) as i from doc where len(w) > 0),
cand as (select r, i, width, array_to_string(w[i:i + width - 1], ' ') as key
         from pos, (select distinct width from win) where i + width - 1 <= len(w)),
hit as (select c.r, c.i, c.width, win.item from cand c join win on c.width = win.width and c.key = win.key),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + width)) as p from hit) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hit where item is not null group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(t.n_items, 0) as bigint) as n_items, sha256(coalesce(t.ids, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 as contaminated
from doc d left join cover c on c.r = d.r left join items t on t.r = d.r
"""
