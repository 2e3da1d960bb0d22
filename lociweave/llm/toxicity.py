"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and their beginnings, hashed. Beside a weight, each term has a short vector, and
two terms that occur together add the product of their vectors: an insult with a group named, or two mild words,
can weigh more than their sum. The machine is trained in numpy on a bounded sample of the labelled rows, over all
hashed buckets, in two sparse steps. First the weights, all together, under a penalty that leaves those at zero that
the others make needless, and the directions in which vectors over all buckets grow from zero, which are the leading
eigenvectors of what the weights leave unexplained in pairs of terms: terms that tell nothing alone are found there.
Then weights and vectors together, without the penalty, over the terms that either showed; the others' are zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepared, table, texts

#: Labelled rows to learn from, at most; those of the smallest hash of doc_id.
SAMPLE = 10_000
BUCKETS, FACTORS = 1 << 20, 8
#: A weight, or the product of a pair of vectors, differs from zero if the labels ask for it by so many standard deviations.
CLEAR = 4.0
#: Eigenvectors followed, and rounds of it.
DIRECTIONS, POWER = 4, 8
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+")
#: Words whose terms a Python worker remembers.
CACHE = 500_000


def terms(word: str) -> list[int]:
    """Hashed terms of a word: itself, and its beginnings of 4 to 6 letters."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in {word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)}]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Machine:
    """Terms (sorted), weights and vectors; with no term it gives the share of positive labels."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, active: np.ndarray) -> float:
        """Probability for a text with these terms, given by their places."""
        s = self.vectors[active].sum(0)
        z = self.bias + self.weights[active].sum() + 0.5 * float((s * s).sum() - np.square(self.vectors[active]).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """A sparse matrix of zeros and ones, by rows."""

    def __init__(self, cols: np.ndarray, n: np.ndarray, width: int):
        self.cols, self.n, self.width = cols, n, width
        self.some = np.flatnonzero(n)
        self.starts = (np.cumsum(n) - n)[self.some]

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n), np.float32)
        if len(self.some):
            out[self.some] = np.add.reduceat(v.astype(np.float32)[self.cols], self.starts)
        return out

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, np.repeat(d, self.n), self.width)

    def only(self, kept: np.ndarray) -> Rows:
        """The columns asked for (ascending)."""
        place = np.full(self.width, -1, np.int32)
        place[kept] = np.arange(len(kept))
        at = place[self.cols]
        row = np.repeat(np.arange(len(self.n)), self.n)[at >= 0]
        return Rows(at[at >= 0], np.bincount(row, minlength=len(self.n)), len(kept))


def sparse_weights(x: Rows, y: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Bias and weights of all columns of the least log-loss plus penalty, each weight's in its standard deviations.

    It is solved over a growing set of columns until no other column's slope exceeds its penalty.
    """
    p = 1 / (1 + np.exp(-bias))
    spread = np.sqrt(np.maximum(x.back(np.ones(len(y))), 1) * p * (1 - p))
    w, at = np.zeros(x.width), np.zeros(0, np.int64)
    z = np.full(len(y), bias)
    while True:
        slope = x.back(sigmoid(z) - y)
        more = np.setdiff1d(np.flatnonzero(np.abs(slope) > CLEAR * spread * 1.02), at)
        if not len(more):
            return bias, w
        at = np.union1d(at, more)
        part, least = x.only(at), CLEAR * spread[at]
        v = w[at]
        size = 4 / max(1.0, float(part.n.max(initial=0)) + 1)  # a bound of the curvature along columns
        step = size / np.maximum(part.back(np.ones(len(y))), 1)
        ahead, t = v.copy(), 1.0
        for _ in range(300):
            z = bias + part.times(ahead)
            e = sigmoid(z) - y
            bias -= 2 * float(e.sum() / max(1e-9, (sigmoid(z) * (1 - sigmoid(z))).sum())) * 0.25
            u = ahead - step * part.back(e)
            new = np.sign(u) * np.maximum(np.abs(u) - step * least, 0)
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            moved = float(np.abs(new - v).max(initial=0))
            ahead, v, t = new + (t - 1) / t2 * (new - v), new, t2
            if moved < 1e-4:
                break
        w[:] = 0
        w[at] = v
        z = bias + part.times(v)


def interacting(x: Rows, d: np.ndarray, spread: np.ndarray, seed: int) -> np.ndarray:
    """Columns of the pairs that ask for a product, found along the leading eigenvectors of all columns' pairs.

    d: residuals; spread: their variances. With small vectors V, the slope of a machine whose pairs count by 1 / terms of
    the row is M V, M the residual-weighted co-occurrence of all columns without its diagonal. The columns that weigh most in M's
    leading eigenvectors are then compared pair by pair.
    """
    weight = (d / np.maximum(x.n, 1)).astype(np.float32)
    diagonal = x.back(weight)
    often = x.back(np.ones(len(d))) > 2
    v = np.random.default_rng(seed).normal(size=(x.width, DIRECTIONS)) * often[:, None]
    for _ in range(POWER):
        v = np.linalg.qr(v)[0]
        v = np.stack([(x.back(weight * x.times(c)) - diagonal * c) * often for c in v.T], 1)
    top = np.argsort(-np.abs(v), 0, kind="stable")[:32]
    kept = np.unique(top[np.take_along_axis(v, top, 0) != 0])
    m = np.zeros((len(d), len(kept)), np.float32)
    part = x.only(kept)
    m[np.repeat(np.arange(len(d)), part.n), part.cols] = 1
    asked, sd = m.T @ (d.astype(np.float32)[:, None] * m), np.sqrt(np.maximum(m.T @ (spread.astype(np.float32)[:, None] * m), 1e-9))
    both = m.T @ m
    clear = (np.abs(asked) > CLEAR * sd) & (both > 2) & ~np.eye(len(kept), dtype=bool)
    return kept[clear.any(1)]


def train(samples: list[tuple[np.ndarray, int]], seed: int = 3, rounds: int = 90) -> Machine:
    """Learns from (sorted hashed terms, label) pairs. Equal texts count once."""
    seen = {(x.tobytes(), int(y)) for x, y in samples}
    rows = sorted(seen)
    y = np.array([b for _, b in rows], float)
    none = np.zeros(0)
    share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Machine(none.astype(np.int64), bias, none, np.zeros((0, FACTORS)))
    n = len(y)
    every, cols = np.unique(np.frombuffer(b"".join(a for a, _ in rows), np.int32), return_inverse=True)
    x = Rows(cols.astype(np.int32), np.array([len(a) // 4 for a, _ in rows]), len(every))
    base, w = sparse_weights(x, y, bias)
    p = sigmoid(base + x.times(w))
    pairs = interacting(x, y - p, p * (1 - p), seed)
    at = np.union1d(np.flatnonzero(w), pairs).astype(np.int64)
    kept, part = every[at], x.only(at)
    g = np.random.default_rng(seed)
    m = np.zeros((n, len(kept)), np.float32)
    m[np.repeat(np.arange(n), part.n), part.cols] = 1
    p = {"bias": np.array([bias]), "weights": np.zeros(len(kept)), "vectors": g.normal(0, 0.05, (len(kept), FACTORS))}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, rounds + 1):
        v = p["vectors"].astype(np.float32)
        s = m @ v
        z = p["bias"] + m @ p["weights"].astype(np.float32) + 0.5 * (np.square(s).sum(1) - m @ np.square(v).sum(1))
        d = ((sigmoid(z) - y) / n).astype(np.float32)
        grad = {"bias": np.array([d.sum()]), "weights": m.T @ d + 1e-5 * p["weights"], "vectors": m.T @ (d[:, None] * s) - v * (m.T @ d)[:, None] + 1e-4 * v}
        for k in p:  # Adam
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * np.square(grad[k])
            p[k] = p[k] - 0.08 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(kept.astype(np.int64), float(p["bias"][0]), p["weights"], p["vectors"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.unique(np.array([t for w in words(text) for t in terms(w)], np.int32)).tobytes() for text in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary()), batch.column("toxic")], names=["doc_id", "terms", "toxic"])


def held_out() -> F.Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine for docs' labels, from at most ``sample`` labelled doc_ids that aren't held out, one text of each."""
    prepared(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.mapInArrow(_features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, terms binary, toxic int")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("terms", "toxic")).alias("x"))  # so at most ``sample`` rows, whatever repeats
    return train([(np.frombuffer(r[0], np.int32), r[1]) for r in one.select("x.terms", "x.toxic").toLocalIterator()])


class Scorer:
    """Scores texts with a machine; remembers which words have terms of it."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {int(t): i for i, t in enumerate(machine.terms)}
        self.active: dict[str, list[int]] = {}
        self.inert: set[str] = set()

    def score(self, items: list[str]) -> list[float]:
        own = [words(x) for x in items]
        for w in set().union(*own).difference(self.inert, self.active):
            places = [self.place[t] for t in terms(w) if t in self.place]
            if places:
                self.active[w] = places
            else:
                self.inert.add(w)
        known = self.active.keys()
        out = [self.machine.score(np.array(sorted({p for w in s & known for p in self.active[w]}), np.int64)) for s in own]
        if len(self.inert) > CACHE:
            self.inert.clear()
        if len(self.active) > CACHE:
            self.active.clear()
        return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer.score(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.7).

    Null and empty texts have no terms and get the bias's score. Rows with null doc_ids are never learned from and
    not held out; of texts that share a labelled doc_id one is learned from; a repeated label counts as toxic if one of its rows is; null labels are no labels; with no or equal
    labels all scores are the share of toxic ones. Repeated documents give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(_score(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that are predicted toxic; all columns as they were, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, sample))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([x < THRESHOLD for x in scorer.score(texts(batch))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
