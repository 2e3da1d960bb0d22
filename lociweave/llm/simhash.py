"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most four have, of three segments, one that differs in at most one bit.
So each distinct fingerprint is indexed under its three segments and under each segment with one bit deleted, and
fingerprints that meet under a signature are verified on all 64 bits. Those under a one-bit variant only meet those
with the other bit, since equal segments meet under the segment itself. A signature with many fingerprints is cut
into blocks whose pairs are spread over the cluster. Where fingerprints meet, only a spanning forest of their links
is passed on; components join the forests. Copies of a text share one fingerprint and are never paired.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import groups_of, left_join_hot, prepared, table, texts, written
from .components import components

WORDS, SEED, BITS = 4, 42, 4
#: (offset, width) of the segments: one more than half of the bits that may differ, rounded up.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one signature that a task compares alone; more are cut into blocks of this size.
BLOCK = 2048
#: Links that a task holds before it keeps only a forest of them.
HELD = 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, width: int = WORDS) -> list[int]:
    """Hashes of all word shingles of a text, repeats included; of the whole if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: exactly \\x20 and \\x09-\\x0D
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints_of(items: list[str]) -> np.ndarray:
    """Fingerprint of each text; 0 without words."""
    hashes = [shingle_hashes(x) for x in items]
    n = np.array([len(h) for h in hashes])
    out = np.zeros(len(items), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(n.sum()))
    firsts = np.cumsum(n[some]) - n[some]
    sums = np.zeros((len(some), 64), np.int64)
    step = 1 << 17
    for i in range(0, len(flat), step):  # a bounded number of bits at a time
        bits = np.unpackbits(flat[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(firsts, i, "right") - 1, np.searchsorted(firsts, i + len(bits), "left")
        cuts = np.maximum(firsts[lo:hi] - i, 0)
        sums[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_ = (2 * sums > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = texts(batch)
            fp = np.concatenate([fingerprints_of(items[lo:hi]) for lo, hi in groups_of(items, 1 << 20)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, name])

    return run


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """docs with the fingerprint of ``text`` as a long; null and empty texts have 0."""
    prepared(docs.sparkSession)
    return docs.mapInArrow(_fingerprint(name), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def signatures(classes: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its segments and their one-bit variants; the key's last bit is the deleted bit."""
    keys = []
    for s, (offset, width) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned("fp", offset).bitwiseAND((1 << width) - 1)
        keys.append(F.shiftleft(part + F.lit(((s * 32 + 31) << 32)), 1))
        for p in range(width):
            rest = part.bitwiseAND(((1 << width) - 1) ^ (1 << p)) + F.lit((s * 32 + p) << 32)
            keys.append(F.shiftleft(rest, 1).bitwiseOR(F.shiftright(part, p).bitwiseAND(1)))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones connect: each node with the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= BITS


def _fewer(a: list, b: list) -> tuple[list, list]:
    """Links as they are, or a forest of them once they are many, so that all pairs of two blocks are never held at once."""
    if sum(map(len, a)) <= HELD:
        return a, b
    c, r = forest(np.concatenate(a), np.concatenate(b))
    return [c], [r]


LINKS = "a bigint, b bigint, left binary, right binary"


def _links(a: list, b: list, tasks: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """A batch of links and of block pairs yet to be compared."""
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    if len(a):
        a, b = forest(a, b)
    none = [None] * len(tasks)
    return pa.RecordBatch.from_arrays(
        [pa.array([*a.tolist(), *none], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()), pa.array([*[None] * len(a), *(x for x, _ in tasks)], pa.binary()), pa.array([*[None] * len(a), *(y for _, y in tasks)], pa.binary())],
        names=["a", "b", "left", "right"],
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each key; rows come sorted by key. Only the last key of a batch is held over."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def close(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        key2, bit = key >> 1, key & 1
        exact = (key2 >> 32) % 32 == 31
        edge = np.flatnonzero(np.diff(key2)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key2)]])
        size = last - first
        useful = (size > 1) & (exact[first] | (bit[first] != bit[last - 1]))
        a, b, tasks = [], [], []
        for s, e in zip(first[useful & (size > BLOCK)].tolist(), last[useful & (size > BLOCK)].tolist(), strict=True):
            cut = lambda x: [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]
            if exact[s]:
                parts = cut(fp[s:e])
                tasks += [(x, y) for i, x in enumerate(parts) for y in parts[i:]]
            else:
                m = s + int(np.searchsorted(bit[s:e], 1))
                tasks += [(x, y) for x in cut(fp[s:m]) for y in cut(fp[m:e])]
        few = useful & (size <= BLOCK)
        at = np.concatenate([np.arange(s, e) for s, e in zip(first[few].tolist(), last[few].tolist(), strict=True)] or [np.zeros(0, np.int64)])
        k, f, t, x = key2[at], fp[at], bit[at], exact[at]
        live = np.arange(len(k))
        for d in range(1, BLOCK):
            live = live[live + d < len(k)]
            live = live[k[live] == k[live + d]]
            if not len(live):
                break
            ok = live[(x[live] | (t[live] != t[live + d])) & near(f[live], f[live + d])]
            if len(ok):
                a.append(f[ok])
                b.append(f[ok + d])
                a, b = _fewer(a, b)
        return _links(a, b, tasks)

    for batch in batches:
        key = np.concatenate([held[0], batch.column("key").to_numpy()])
        fp = np.concatenate([held[1], batch.column("fp").to_numpy()])
        if not len(key):
            continue
        stop = int(np.searchsorted(key >> 1, key[-1] >> 1, "left"))
        if stop:
            yield close(key[:stop], fp[:stop])
        held = (key[stop:], fp[stop:])
    if len(held[0]):
        yield close(*held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the fingerprints of two blocks."""
    for batch in batches:
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            x, y = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)
            a, b = [], []
            for i in range(0, len(x), 64):
                p, q = np.nonzero(near(x[i : i + 256, None], y[None, :]))
                a.append(x[i + p])
                b.append(y[q])
                a, b = _fewer(a, b)
            yield _links(a, b, [])


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect just those of the distinct fingerprints ``fp`` that chains of near pairs connect."""
    rows = signatures(classes).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    met = written(rows.mapInArrow(_meet, LINKS))
    tasks = met.where("left is not null").select("left", "right")
    more = tasks.repartition(max(tasks.sparkSession.sparkContext.defaultParallelism, int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_compare, LINKS)
    return met.where("a is not null").select("a", "b").unionAll(more.select("a", "b"))


def classed(prints: DataFrame) -> tuple[DataFrame, int]:
    """Of (doc_id, fp): a row per distinct fingerprint, (fp, first, n, component_id), and the number of documents.

    first is the class's smallest doc_id, component_id that of all classes reachable from it.
    """
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted)
    total, many = rooted.agg(F.sum("n"), F.count("*")).first()
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("k"))
    out = left_join_hot(rooted, "root", least.select("root", "component_id"), least.select("root", F.col("k").alias("n")), many)
    return out.select("fp", "first", "n", "component_id"), total or 0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like any other. Null doc_ids are never smallest: a
    component of them alone has a null component_id. Repeated rows give a row each. Other columns are ignored.
    """
    prints = written(with_fingerprint(docs.select("doc_id", F.col("text").cast("string").alias("text")), "fp").select("doc_id", "fp"))
    classes, total = classed(prints)
    classes = written(classes)
    out = left_join_hot(prints, "fp", classes.select("fp", "component_id"), classes.select("fp", "n"), total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns as they were, whatever their names.

    Of rows that share that doc_id and fingerprint, one stays. Texts are read for fingerprints once; only rows of a
    doc_id that has several rows are fingerprinted again to tell them apart.
    """
    tag = uuid.uuid4().hex
    name, key, nth = f"fp_{tag}", f"id_{tag}", f"n_{tag}"
    prints = written(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"))
    classes, _ = classed(prints)
    keep = written(classes.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min("fp").alias("_fp")))
    keep = keep.select("_fp", F.col("component_id").alias("_id"))
    several = written(prints.groupBy("doc_id").count().where("count > 1").join(keep, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias(key)))
    is_several = docs["doc_id"].eqNullSafe(several[key])
    sole = keep.select(F.col("_id").alias(f"s_{tag}")).where(F.col(f"s_{tag}").isNotNull())
    out = docs.join(several, is_several, "left_anti")
    # always dealt by doc_id: what stays grows with the input, and a plan that broadcasts it would only hold for small ones
    out = out.join(sole.hint("merge"), out["doc_id"] == F.col(f"s_{tag}"), "left_semi").select(*[out[c] for c in docs.columns])
    if several.isEmpty():
        return out
    rows = with_fingerprint(docs.join(several, is_several, "left_semi"), name)
    rows = rows.join(keep, (rows[name] == keep["_fp"]) & rows["doc_id"].eqNullSafe(keep["_id"]), "left_semi")
    order = Window.partitionBy(name, "doc_id").orderBy(*[F.col(c) for c in docs.columns])
    rows = rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return out.unionAll(rows.select(*docs.columns))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
