"""Questions to a graph: neighbourhood paths, regions between genes, cuts."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dna import reverse_complement
from . import graph


def _path(target: str, pairs: list[tuple[str, str]]) -> str:
    """Preorder of the depth-first walk from the node farthest from the target; the least name goes first."""
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    hops, todo = {target: 0}, deque([target])
    while todo:
        for y in sorted(near.get(x := todo.popleft(), [])):
            if y not in hops:
                hops[y] = hops[x] + 1
                todo.append(y)
    start = min(hops, key=lambda x: (-hops[x], x))
    out, stack, seen = [], [start], set()
    while stack:
        if (x := stack.pop()) not in seen:
            seen.add(x)
            out.append(x)
            stack += sorted((y for y in near.get(x, []) if y in hops), reverse=True)
    return ">".join(out)


def neighbourhoods(em: DataFrame, target: str, expand: int = 5, write=None) -> DataFrame:
    """(path, support, genomes): each genome's path around the target, equal paths together.

    A frontier per genome goes over the edges that carry the genome; the order of a path is a small kernel per genome.
    """
    sym = graph.both_ways(em)
    front = em.where((F.col("a") == target) | (F.col("b") == target)).select("genome").distinct().withColumn("node", F.lit(target))
    seen = front
    for _ in range(expand):
        front = front.join(sym, ["genome", "node"]).select("genome", F.col("neighbour").alias("node")).distinct().join(seen, ["genome", "node"], "left_anti")
        if write:
            front = write(front)
        seen = seen.unionAll(front)
    own = em.join(seen.withColumnRenamed("node", "a"), ["genome", "a"], "left_semi").join(seen.withColumnRenamed("node", "b"), ["genome", "b"], "left_semi")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"genome": [str(rows["genome"].iloc[0])], "path": [_path(target, list(zip(rows["a"], rows["b"], strict=True)))]})

    paths = own.groupBy("genome").applyInPandas(walk, "genome string, path string")
    return paths.groupBy("path").agg(F.count("*").alias("support"), F.array_join(F.array_sort(F.collect_list("genome")), ";").alias("genomes"))


def regions(located: DataFrame, first: str, second: str, margin: int = 0) -> DataFrame:
    """(genome, contig, start, end, strand) of the stretch from one gene to another where both are on one contig."""
    a = located.where(F.col("cluster") == first).select("genome", "contig", F.col("start").alias("s1"), F.col("end").alias("e1"), "strand")
    b = located.where(F.col("cluster") == second).select("genome", "contig", F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, ["genome", "contig"]).select("genome", "contig", F.greatest(F.least("s1", "s2") - margin, F.lit(1)).alias("start"), (F.greatest("e1", "e2") + margin).alias("end"), "strand")


def extract_sequences(cells: DataFrame, genes: DataFrame, clusters: list[str], dna: bool = True, by: str = "both") -> DataFrame:
    """(id, seq) of the genes of some clusters, from cells (cluster, genome, cell) of ids joined by ``;``.

    genes: (genome, annotation_id, dna, protein). Marks of length and stops are taken off the ids; ``by`` names a
    sequence by gene, genome or both.
    """
    ids = cells.where(F.col("cluster").isin(clusters)).select("genome", F.explode(F.split("cell", ";")).alias("x"))
    ids = ids.select("genome", F.regexp_replace("x", "_len|_pseudo", "").alias("annotation_id")).where("annotation_id <> ''").distinct()
    name = {"gene": F.col("annotation_id"), "genome": F.col("genome").cast("string"), "both": F.concat_ws("_", F.col("genome").cast("string"), "annotation_id")}[by]
    return genes.join(ids, ["genome", "annotation_id"], "left_semi").select(name.alias("id"), F.col("dna" if dna else "protein").alias("seq"))


def region_sequences(spans: DataFrame, contigs: DataFrame) -> DataFrame:
    """(genome, contig, seq) of ``regions``: each stretch on the strand of its first gene."""
    d = spans.join(contigs, ["genome", "contig"])
    seq = F.substring("seq", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    return d.select("genome", "contig", F.when(F.col("strand") < 0, reverse_complement(seq)).otherwise(seq).alias("seq"))


def merged_genes(genes: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a gene table whose ``clustering_id`` is asked for, once each: the first by annotation of equals."""
    w = Window.partitionBy("clustering_id").orderBy("annotation_id")
    kept = genes.join(ids.select("clustering_id"), "clustering_id", "left_semi")
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def minimum_cut(pairs: list[tuple[str, str, int]], source: str, sink: str) -> list[tuple[str, str]]:
    """Edges of a least cut between two nodes by shortest augmenting paths; for the induced subgraph of one query."""
    cap: dict[str, dict[str, int]] = {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            cap.setdefault(x, {})[y] = cap.get(x, {}).get(y, 0) + w

    def reach() -> dict[str, str]:
        came, todo = {source: source}, deque([source])
        while todo:
            x = todo.popleft()
            for y, c in sorted(cap.get(x, {}).items()):
                if c > 0 and y not in came:
                    came[y] = x
                    todo.append(y)
        return came

    while sink in (came := reach()):
        path, y = [], sink
        while y != source:
            path.append((came[y], y))
            y = came[y]
        flow = min(cap[x][y] for x, y in path)
        for x, y in path:
            cap[x][y] -= flow
            cap[y][x] = cap[y].get(x, 0) + flow
    return sorted((a, b) if a < b else (b, a) for a, b, _ in pairs if (a in came) != (b in came))


def circular_distance(a, b, most) -> F.Column:
    """Distance of two places on a circle of the given length."""
    d = F.abs(a - b)
    return F.least(d, F.abs(d - most))
