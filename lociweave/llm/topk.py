"""Exact top-k by inner product, score at a time over an impact-ordered index.

Each block of candidates is indexed by impact: a posting is a vector with a component in a dimension, and a segment has
the postings of one bit length of the component, a list for each dimension. A few queries at a time take the segments by
descending impact and add the postings up for the candidates that are still possible. What the rest can yet add to a score is at most
the largest impact left times the sum of the query's sizes, and at most the product of the query's length and that of what is
left of the vector, which the index keeps for each segment. A vector whose score so far plus that can't reach the k-th best lower
bound is no member. When few pairs are left, or no segment is, those are scored exactly with integers. Nothing else ends a search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepared, table

K, EVERY, SCALE = 5, 50, 256
#: Queries in a broadcast block, queries that go through the segments together, candidates in an indexed block, and the part of their pairs
#: that may be scored exactly early.
QUERIES, TOGETHER, CANDIDATES, FEW = 16_384, 128, 8_192, 0.05
#: Bounds are looked at once no more than this part of the vectors' squared length is left.
MUCH = 0.1


def matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; missing components are 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


class ImpactIndex:
    """A block of candidates with its posting segments by descending quantised impact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.most = int(np.abs(rows).max(initial=0))
        level = np.frexp(np.abs(rows).astype(np.float64))[1]  # bit length: v < 2 ** level
        left = np.square(rows.astype(np.float64)).sum(1)
        #: (postings by dimension as candidates and components, largest impact left, length left of each candidate)
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], int, np.ndarray]] = []
        for b in np.unique(level)[::-1].tolist():
            if b > 0:
                dim, at = np.nonzero((level == b).T)
                cuts = np.searchsorted(dim, np.arange(rows.shape[1] + 1)).tolist()
                lists = [(j, at[x:y], rows[at[x:y], j]) for j, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                left = left - np.where(level == b, np.square(rows.astype(np.float64)), 0).sum(1)
                self.segments.append((lists, 2 ** (b - 1) - 1, np.sqrt(np.maximum(left, 0)) * (1 + 1e-9)))

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score) of all possible members of the k best; floor: the k-th best score elsewhere."""
        n, d = self.rows.shape
        reach = d * self.most * int(np.abs(queries).max(initial=0))
        possible = self.ids[:, None] != own[None, :]
        if reach < 2**53:  # beyond exact floats every candidate is scored with whole numbers
            kind = np.float32 if reach < 2**24 else np.float64
            weights = queries.T.astype(kind, order="C")
            sizes, lengths = np.abs(weights).sum(0, dtype=np.float64), np.sqrt(np.square(weights, dtype=np.float64).sum(0))
            whole = np.square(self.rows.astype(np.float64)).sum()
            score, alive, all_alive = np.zeros((n, len(queries)), kind), np.ones(n, bool), True
            for i, (lists, impact, left) in enumerate(self.segments):
                for j, at, value in lists:
                    if not all_alive:
                        keep = alive[at]
                        at, value = at[keep], value[keep]
                    score[at] += value.astype(kind)[:, None] * weights[j]
                last = i + 1 == len(self.segments)
                if not last and left @ left > MUCH * whole:
                    continue  # too much is left to prove anything
                slack = np.zeros((n, 1)) if last else np.minimum(impact * sizes[None, :], left[:, None] * lengths[None, :])
                if n >= k and not np.isfinite(floor).all():
                    floor = np.maximum(floor, np.partition(np.where(possible, score - slack, -np.inf), n - k, 0)[n - k])
                possible &= score + slack >= floor
                alive = possible.any(1)  # proof for all the others
                all_alive = bool(alive.all())
                if possible.mean() <= FEW:
                    break
        c, q = np.nonzero(possible)
        return q, self.ids[c], exact(queries, self.rows, q, c, reach)


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, c: np.ndarray, reach: int) -> np.ndarray:
    """Integer inner products of pairs; where 64 bits don't hold them, the nearest that they hold."""
    out = np.empty(len(q), np.int64)
    for i in range(0, len(q), 200_000):
        a, b = queries[q[i : i + 200_000]], rows[c[i : i + 200_000]]
        if reach < 2**63:
            out[i : i + 200_000] = np.einsum("ij,ij->i", a, b)
        else:
            out[i : i + 200_000] = [max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(u, v, strict=True)))) for u, v in zip(a.tolist(), b.tolist(), strict=True)]
    return out


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score.astype(object) if score.min(initial=0) == -(2**63) else -score, q))
    q, ids, score = q[order], ids[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = rank < k
    return q[keep], ids[keep], score[keep]


def _search(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        step = TOGETHER
        held = [(np.zeros(0, np.int64),) * 3 for _ in range(0, len(own), step)]
        floors = np.full(len(own), -np.inf)

        def take(index: ImpactIndex) -> None:
            for b, lo in enumerate(range(0, len(own), step)):
                q, ids, score = index.search(queries[lo : lo + step], own[lo : lo + step], floors[lo : lo + step], k)
                held[b] = best(*(np.concatenate([x, y]) for x, y in zip(held[b], (q, ids, score), strict=True)), k)
                q, _, score = held[b]
                full = np.flatnonzero(np.bincount(q, minlength=min(step, len(own) - lo)) >= k)
                floors[lo + full] = score[np.searchsorted(q, full, "right") - 1]

        for batch in batches:
            all_ids = batch.column("vec_id").to_numpy()
            for i in range(0, len(all_ids), CANDIDATES):
                part = batch.slice(i, CANDIDATES)
                order = np.argsort(all_ids[i : i + CANDIDATES], kind="stable")
                take(ImpactIndex(all_ids[i : i + CANDIDATES][order], matrix(part.column("v").to_pylist(), queries.shape[1])[order]))
        for b, lo in enumerate(range(0, len(own), step)):
            q, ids, score = held[b]
            yield pa.RecordBatch.from_arrays([pa.array(own[lo + q]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose vec_id is divisible by ``every``.

    Components count as floor(256 * x). Rows with a null vec_id or vector, or a null or non-finite component, take
    no part; shorter vectors are filled up with zeros. A row is known by its vec_id: rows that share the query's are
    its own, and a repeated query id is asked once, with the least of its vectors. Candidates that repeat count each
    time. Other columns are ignored. Queries go in blocks of bounded size, each over all rows.
    """
    spark = vectors.sparkSession
    prepared(spark)
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint")).alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = []

    def ask(block: list) -> None:
        block.sort()
        own = np.array([x for x, _ in block], np.int64)
        width = max(len(v) for _, v in block)
        shared = spark.sparkContext.broadcast((own, matrix([v for _, v in block], width)))
        parts.append(rows.mapInArrow(_search(shared, k), "query_id bigint, vec_id bigint, score bigint"))

    block = []
    for r in asked.toLocalIterator():
        block.append((r["vec_id"], r["v"]))
        if len(block) == query_block:
            ask(block)
            block = []
    if block:
        ask(block)
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = f"""
with e as (select vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as v from embeddings
           where vec_id is not null and embedding is not null
           and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
             cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) as bigint) as score
      from e q, e c where q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
