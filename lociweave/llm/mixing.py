"""Mixing sources to target weights by cube-method balanced sampling.

A source is taken target / size times: each document the whole part of that, and once more with the probability of
the rest. Which ones is decided by the cube method: the vector of probabilities is moved through the null space of
the constraints (number of documents, number of words) until an entry is 0 or 1, which leaves both totals exactly as
they were, again and again, the largest open document first and the next ones in balance against it. Chunks of a
source fly in parallel; the small documents that each leaves undecided (two at most) fly again with those of the other
chunks. The last two of a source land: the first constraint given up is that on documents, then that on words. Every
move is as likely to go up as down, by its lengths, so each document keeps its probability from start to end, in
sources of any size. Copies of one document are one unit, of which all but a fraction is decided at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import left_join_hot, prepared, table, texts, written

WEIGHTS = (1, 2, 3)
MOST = 3
#: Units that fly together in one task.
CHUNK = 4096
#: Units that a flight leaves undecided at most, and units that balance one.
LEFT, BALLAST = 2, 256
#: Sources up to which their table is broadcast.
BROADCAST = 50_000
EPS = 1e-9


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # bytes.split: exactly \\x20 and \\x09-\\x0D
            n = [len(x.encode("utf-8", "surrogatepass").split()) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, name])

    return run


def with_size(docs: DataFrame, name: str) -> DataFrame:
    """docs with their number of words."""
    prepared(docs.sparkSession)
    return docs.mapInArrow(_count(name), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, docs, target) of (source, size).

    Sources in ascending order, null last, weigh 1, 2, 3 and so on again. Targets fill up by weight to a common
    level, each stopping at 3 times its source: with sources by the level that stops them, the first that the level
    of all later ones doesn't stop sets it. One row a source goes through the window.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    src = src.withColumn("w", ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("double"))
    most = MOST * F.col("source_size").cast("double")
    src = src.withColumn("stop", most / F.col("w"))
    by = Window.orderBy("stop", "rank")
    src = src.withColumn("left", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum(most).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("weight", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    src = src.withColumn("level", F.min(F.when(F.col("stop") * F.col("weight") >= F.col("left"), F.col("left") / F.col("weight"))).over(by))
    target = F.when(F.col("level").isNull(), most).otherwise(F.least(most, F.first(F.col("level"), True).over(by) * F.col("w")))
    return src.select("source", "rank", "source_size", "docs", target.alias("target"))


def against(size: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    """What the other units move when the first moves by 1, so that neither total does; None if they can't.

    Of all ways it is the least one, measured by the weights (the others' distance from being decided).
    """
    z = (size[1:] - size[0]) / max(1.0, size[0])
    s0, s1, s2 = weight.sum(), weight @ z, weight @ (z * z)
    if s2 <= 0:  # all of one size
        return -weight / s0
    det = s0 * s2 - s1 * s1
    return -weight * (s2 - s1 * z) / det if det > 1e-9 * s0 * s2 else None


def move(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """p moved along u, up or down, until an entry is 0 or 1; p stays in expectation."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
        down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
    p = p + (up if draw * (up + down) < down else -down) * u
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def fly(p: np.ndarray, size: np.ndarray, seed: int, land: bool = False) -> np.ndarray:
    """Moves the probabilities of units of descending sizes, keeping their sum and the sum of p * size, until at most two
    are undecided; these are decided too if asked for."""
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p.astype(float)))
    size, r = size.astype(float), np.random.default_rng([seed, len(p)])
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        at = open_[: BALLAST + 1]
        weight = np.minimum(p[at[1:]], 1 - p[at[1:]])
        u = against(size[at], weight)
        if u is None and len(at) > 2:  # the others are of one size: two of them move
            at, u = at[1:3], np.array([-1.0])
        if u is None:
            break
        p[at] = move(p[at], np.concatenate([[1.0], u]), r.random())
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    if land and len(open_) == 2:
        p[open_] = move(p[open_], size[open_[::-1]] * [1.0, -1.0], r.random())
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    if land and len(open_):
        p[open_] = r.random() < p[open_]
    return p


UNIT = "rank int, doc_id bigint, size bigint, p double, chunk bigint"


def _fly(level: int, last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable")
        size = rows["size"].to_numpy()
        rows["p"] = fly(rows["p"].to_numpy(), size, abs(hash((seed, level, int(key[0]), int(key[1])))) % 2**63, last)
        return rows

    return run


def decided(units: DataFrame, most: int, seed: int = 5) -> DataFrame:
    """units (rank, doc_id, size, p) with p decided to 0 or 1; most: the largest number of units of a source."""
    done, level = [], 0
    while True:
        chunks = -(-most // CHUNK)
        chunk = F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.lit(chunks)).cast("bigint")
        rows = units.withColumn("chunk", chunk).groupBy("rank", "chunk").applyInPandas(_fly(level, chunks == 1, seed), UNIT).drop("chunk")
        if chunks == 1:
            out = rows
            for d in done:
                out = out.unionAll(d)
            return out
        rows = written(rows)
        done.append(rows.where("p = 0 or p = 1"))
        units, most, level = rows.where("p > 0 and p < 1"), LEFT * chunks, level + 1


def plan(sizes: DataFrame, seed: int = 5) -> DataFrame:
    """What the mix takes of (source, doc_id, size): (source, doc_id, size, m, base, extra, source_size, target).

    Of the m rows of a unit each is taken base times, and ``extra`` of them once more.
    """
    spark = sizes.sparkSession
    src = written(targets(sizes))
    units = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m"))
    n, most, total = src.agg(F.count("*"), F.max("docs"), F.sum("docs")).first()
    if n <= BROADCAST:
        keyed = src.withColumnRenamed("source", "_source")
        units = units.join(F.broadcast(keyed), units["source"].eqNullSafe(keyed["_source"])).drop("_source")
    else:
        units = left_join_hot(units, "source", src, src.select("source", F.col("docs").alias("n")), total)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(times + EPS).cast("bigint")
    share = F.greatest(times - base, F.lit(0.0)) * F.col("m")
    sure = F.floor(share + EPS).cast("bigint")
    units = units.withColumns({"base": base, "sure": sure, "p": F.when(F.col("size") > 0, F.greatest(share - sure, F.lit(0.0))).otherwise(0.0)})
    units = written(units.drop("docs"))
    flown = decided(units.where("p > 0").select("rank", "doc_id", "size", "p"), max(1, most or 0), seed)
    flown = written(flown.select(F.col("rank").alias("_rank"), F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), F.col("p").alias("once")))
    same = (units["rank"] == flown["_rank"]) & units["doc_id"].eqNullSafe(flown["_doc"]) & (units["size"] == flown["_size"])
    out = units.join(flown, same, "left")
    return out.select("source", "doc_id", "size", "m", "base", (F.col("sure") + F.coalesce(F.col("once"), F.lit(0.0)).cast("bigint")).alias("extra"), "source_size", "target")


def mix(docs: DataFrame, seed: int = 5) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own, the last;
    rows that agree in source, doc_id and size are copies, of which the mix takes the same number in all. No
    documents: no rows. Other columns are ignored. Reruns agree.
    """
    sizes = written(with_size(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), "size").select("source", F.col("doc_id").cast("bigint").alias("doc_id"), "size"))
    one = plan(sizes, seed).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    return one.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + (F.col("nth") <= F.col("extra")).cast("bigint"))).alias("taken"))


def mixed(docs: DataFrame, seed: int = 5) -> DataFrame:
    """docs as the mix takes them: a row as often as it is taken; all columns as they were, whatever their names."""
    tag = uuid.uuid4().hex
    size, copies, nth = f"size_{tag}", f"copies_{tag}", f"nth_{tag}"
    sizes = written(with_size(docs.select("doc_id", "source", "text"), "size").select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), "size"))
    cols = {c: f"{c}_{tag}" for c in ("source", "doc_id", "size", "m", "base", "extra")}
    take = written(plan(sizes, seed).where("base + extra > 0").select(*[F.col(c).alias(n if c != "size" else f"words_{tag}") for c, n in cols.items()]))
    s, d, n, m, base, extra = (F.col(cols[c] if c != "size" else f"words_{tag}") for c in cols)
    rows = with_size(docs, size)
    # always dealt by source, doc_id and size: what is taken grows with the input
    rows = rows.join(take.hint("merge"), rows["source"].eqNullSafe(s) & rows["doc_id"].eqNullSafe(d) & (rows[size] == n))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out = rows.where(m == 1).select(*kept, (base + extra).alias(copies))
    if not take.where(m > 1).isEmpty():
        order = Window.partitionBy(s, d, n).orderBy(*kept)
        out = out.unionAll(rows.where(m > 1).select(*kept, (base + (F.row_number().over(order) <= extra).cast("bigint")).alias(copies)))
    return out.where(F.col(copies) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*kept)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
