"""Models of gene gain and loss, trees, and scaling of distances: small numpy kernels, spread over Spark by rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.stage import prepared


@dataclass
class Node:
    label: str = ""
    edge: float = 0.0
    children: list["Node"] = field(default_factory=list)

    def leaves(self) -> list["Node"]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]

    def postorder(self) -> Iterator["Node"]:
        for c in self.children:
            yield from c.postorder()
        yield self


def parse_newick(text: str) -> Node:
    """A tree from newick text; comments in brackets are skipped."""
    tokens = re.findall(r"[(),;]|:[^(),;]*|'(?:[^']|'')*'|[^(),:;]+", re.sub(r"\[[^\]]*\]", "", text.strip()))
    root = Node()
    stack, last = [root], root
    for t in tokens:
        if t == "(":
            last = Node()
            stack[-1].children.append(last)
            stack.append(last)
        elif t == ",":
            stack.pop()
            last = Node()
            stack[-1].children.append(last)
            stack.append(last)
        elif t == ")":
            stack.pop()
            last = stack[-1]
        elif t.startswith(":"):
            last.edge = float(t[1:])
        elif t != ";" and t.strip():
            last.label = t.strip().strip("'").replace("''", "'")
    return root.children[0] if not root.label and len(root.children) == 1 and root.edge == 0 else root


def tree_weights(tree: Node) -> dict[str, float]:
    """Normalised weight of each tip: edge lengths from the root, each shared by the tips below."""
    out: dict[str, float] = {}

    def walk(n: Node, w: float) -> None:
        w += n.edge / len(n.leaves()) if n is not tree else 0.0
        if not n.children:
            out[n.label] = w
        for c in n.children:
            walk(c, w)

    walk(tree, 0.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def check_labels(tree: Node, genomes: set[str]) -> None:
    tips = {x.label for x in tree.leaves()}
    if tips != genomes:
        raise ValueError(f"tree and genomes differ: {sorted(tips ^ genomes)[:5]}")


# infinitely many genes


def coalescent_curves(n: int, classes: list[tuple[float, float]], essential: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Expected pan and core sizes of 1..n genomes; classes of (loss, gain)."""
    j = np.arange(1, n + 1)
    pan, core = np.full(n, float(essential)), np.full(n, float(essential))
    for rho, theta in classes:
        pan = pan + theta * np.cumsum(1 / (rho - 1 + j))
        for m in j:
            i = np.arange(1, m + 1)
            core[m - 1] += theta / m * np.exp(np.sum(np.log(m - i + 1) - np.log(m - i + rho)))
    return pan, core


def coalescent_spectrum(n: int, classes: list[tuple[float, float]], essential: float = 0.0) -> np.ndarray:
    """Expected genes in exactly 1..n of n genomes."""
    j = np.arange(1, n + 1)
    out = np.zeros(n)
    for rho, theta in classes:
        out += theta / j * np.exp(np.cumsum(np.log(n - j + 1) - np.log(n - j + rho)))
    out[-1] += essential
    return out


def tree_spectrum(tree: Node, classes: list[tuple[float, float]], essential: float = 0.0) -> np.ndarray:
    """Expected genes in exactly 1..n tips of a binary tree; classes of (gain, loss)."""
    n = len(tree.leaves())
    out = np.zeros(n + 1)
    for u, v in classes:
        p: dict[int, np.ndarray] = {}
        for x in tree.postorder():
            if not x.children:
                p[id(x)] = np.array([0.0, 1.0])
            else:
                q = np.array([1.0])
                for c in x.children:
                    s = np.exp(-v * c.edge)
                    own = s * p[id(c)]
                    own[0] += 1 - s
                    q = np.convolve(q, own)
                p[id(x)] = q
            genes = u / v * (1.0 if x is tree else 1 - np.exp(-v * x.edge))
            out[: len(p[id(x)])] += genes * p[id(x)]
    out[n] += essential
    return out[1:]


def minimise(f: Callable[[np.ndarray], float], start: list[float], bounds: list[tuple[float, float]], rounds: int = 400, seed: int = 1, starts: int = 4) -> tuple[np.ndarray, float]:
    """Bounded minimum on log scales by the downhill simplex, from the start and seeded others."""
    low, high = np.log([b[0] for b in bounds]), np.log([b[1] for b in bounds])
    g = np.random.default_rng(seed)
    fun = lambda x: f(np.exp(np.clip(x, low, high)))
    best = None
    for s in range(starts):
        x0 = np.log(start) if s == 0 else g.uniform(low, high)
        simplex = np.array([x0, *[x0 + np.eye(len(x0))[i] * 0.7 for i in range(len(x0))]])
        value = np.array([fun(x) for x in simplex])
        for _ in range(rounds):
            order = np.argsort(value)
            simplex, value = simplex[order], value[order]
            if abs(value[-1] - value[0]) < 1e-10 * (1 + abs(value[0])):
                break
            mid = simplex[:-1].mean(0)
            r = 2 * mid - simplex[-1]
            fr = fun(r)
            if fr < value[0]:
                e = 3 * mid - 2 * simplex[-1]
                fe = fun(e)
                simplex[-1], value[-1] = (e, fe) if fe < fr else (r, fr)
            elif fr < value[-2]:
                simplex[-1], value[-1] = r, fr
            else:
                c = (mid + (r if fr < value[-1] else simplex[-1])) / 2
                fc = fun(c)
                if fc < min(fr, value[-1]):
                    simplex[-1], value[-1] = c, fc
                else:
                    simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                    value[1:] = [fun(x) for x in simplex[1:]]
        if best is None or value.min() < best[1]:
            best = (np.exp(np.clip(simplex[value.argmin()], low, high)), float(value.min()))
    return best


def fit_gains(spectrum: np.ndarray, tree: Node | None = None, classes: int = 1, essential: bool = True) -> tuple[np.ndarray, float]:
    """Parameters (per class two, then essential genes) of the least root mean square error to an observed spectrum."""
    n = len(spectrum)

    def error(x: np.ndarray) -> float:
        pairs = [(x[2 * i], x[2 * i + 1]) for i in range(classes)]
        e = x[2 * classes] if essential else 0.0
        theory = tree_spectrum(tree, pairs, e) if tree else coalescent_spectrum(n, pairs, e)
        return float(np.sqrt(np.mean((theory - spectrum) ** 2)))

    start = [0.01 * 10**i for i in range(2 * classes)] + ([2000.0] if essential else [])
    bounds = [(1e-7, 1e3 if tree else 1e5)] * (2 * classes) + ([(1.0, 1e7)] if essential else [])
    return minimise(error, start, bounds)


# finitely many genes


def pattern_likelihood(tree: Node, present: dict[str, int], a: float, v: float) -> float:
    """Log-likelihood of one presence pattern with gain a and loss v along a tree, root in equilibrium."""
    r = a + v
    like: dict[int, np.ndarray] = {}
    scale = 0.0
    for x in tree.postorder():
        if not x.children:
            like[id(x)] = np.array([1.0 - present[x.label], float(present[x.label])])
            continue
        p = np.ones(2)
        for c in x.children:
            e = np.exp(-r * c.edge)
            p *= np.array([[v / r + a / r * e, a / r * (1 - e)], [v / r * (1 - e), a / r + v / r * e]]) @ like[id(c)]
        top = p.max()
        scale += np.log(top)
        like[id(x)] = p / top
    return float(np.log(v / r * like[id(tree)][0] + a / r * like[id(tree)][1]) + scale)


def total_likelihood(tree: Node, patterns: list[tuple[dict[str, int], int]], a: float, v: float) -> float:
    """Of weighted patterns, given that each is in two genomes or more."""
    tips = [x.label for x in tree.leaves()]
    none = np.exp(pattern_likelihood(tree, dict.fromkeys(tips, 0), a, v))
    one = sum(np.exp(pattern_likelihood(tree, {t: int(t == u) for t in tips}, a, v)) for u in tips)
    seen = np.log1p(-min(none + one, 1 - 1e-12))
    return sum(w * (pattern_likelihood(tree, p, a, v) - seen) for p, w in patterns)


def patterns(members: DataFrame) -> DataFrame:
    """(genomes, n): distinct presence patterns of clusters in two genomes or more, and how often each occurs."""
    p = members.groupBy("cluster").agg(F.array_sort(F.collect_set(F.col("genome").cast("string"))).alias("genomes")).where(F.size("genomes") >= 2)
    return p.groupBy("genomes").agg(F.count("*").alias("n"))


def fit_finite(spark: SparkSession, members: DataFrame, tree: Node, boots: int = 0, most: int = 200_000) -> dict:
    """Gain, loss, genes, BIC, and bootstrap intervals; refits run one a row. Needs at most ``most`` distinct patterns."""
    tips = [x.label for x in tree.leaves()]
    check_labels(tree, {str(r[0]) for r in members.select("genome").distinct().limit(most).collect()})
    rows = patterns(members).orderBy("genomes").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many distinct patterns")
    weighted = [({t: int(t in set(r["genomes"])) for t in tips}, r["n"]) for r in rows]
    total = sum(w for _, w in weighted)

    def fit(ws: list[int], starts: int) -> tuple[np.ndarray, float]:
        data = [(p, w) for (p, _), w in zip(weighted, ws, strict=True) if w]
        return minimise(lambda x: -total_likelihood(tree, data, *x), [0.001, 0.001], [(1e-7, 1e3)] * 2, 80, starts=starts)

    (a, v), loss = fit([w for _, w in weighted], 1)
    out = {"gain": a, "loss": v, "log_likelihood": -loss, "bic": 2 * np.log(len(tips)) + 2 * loss, "genes": total * (a + v) / a}
    if boots:
        prepared(spark)

        def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = []
                for i in b["boot"]:
                    ws = np.random.default_rng(int(i)).multinomial(total, np.array([w for _, w in weighted]) / total)
                    got.append((int(i), *map(float, fit(ws.tolist(), 1)[0])))
                yield pd.DataFrame(got, columns=["boot", "a", "v"])

        r = spark.range(boots).toDF("boot").repartition(min(boots, 64)).mapInPandas(refit, "boot bigint, a double, v double")
        q = r.agg(F.expr("percentile(a, array(0.025, 0.975))").alias("a"), F.expr("percentile(v, array(0.025, 0.975))").alias("v")).first()
        out |= {"gain_interval": q["a"], "loss_interval": q["v"]}
    return out


def multidimensional_scaling(d: np.ndarray, dims: int = 2, rounds: int = 300, seed: int = 1) -> np.ndarray:
    """Coordinates whose distances are near a matrix's, by majorisation (SMACOF)."""
    n = len(d)
    x = np.random.default_rng(seed).normal(size=(n, dims))
    for _ in range(rounds):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        b = -np.where(e > 0, d / np.where(e > 0, e, 1), 0)
        b[np.arange(n), np.arange(n)] = -b.sum(1)
        x = b @ x / n
    return x
