"""The graph of clusters: edges from gene order with the genomes that support them, and its rewriting.

Member sets are long relations, (cluster, genome) and (a, b, genome) with a < b; a graph is the pair of both.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.stage import written
from .matrix import presence

#: Neighbours of a node in a block whose pairs are made under one key.
PAIRED = 512
#: Most genomes whose sets are kept as bits of numbers; more are kept as lists.
BITS = 630


def edge_members(genes: DataFrame) -> DataFrame:
    """(a, b, genome): clusters next to each other on a contig, once per genome. A cluster is not its own neighbour."""
    before = F.lag("cluster").over(Window.partitionBy("genome", "contig").orderBy("ix"))
    e = genes.withColumn("p", before).where(F.col("p").isNotNull() & (F.col("p") != F.col("cluster")))
    return e.select(F.least("p", "cluster").alias("a"), F.greatest("p", "cluster").alias("b"), "genome").distinct()


def edges(members: DataFrame) -> DataFrame:
    """(a, b, support)."""
    return members.groupBy("a", "b").agg(F.count("*").alias("support"))


def both_ways(e: DataFrame) -> DataFrame:
    """(node, neighbour, ...): each edge from both ends."""
    rest = [c for c in e.columns if c not in ("a", "b")]
    return e.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), *rest).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("neighbour"), *rest))


def degree(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(cluster, degree), 0 for nodes without edges."""
    d = both_ways(e.select("a", "b")).groupBy("node").agg(F.count("*").alias("d"))
    return nodes.join(d, F.col("cluster") == F.col("node"), "left").select("cluster", F.coalesce("d", F.lit(0)).alias("degree"))


def contig_ends(genes: DataFrame) -> DataFrame:
    """Clusters that are first or last on a contig, with the number of times."""
    w = Window.partitionBy("genome", "contig").orderBy("ix")
    e = genes.withColumns({"p": F.lag("ix").over(w), "n": F.lead("ix").over(w)}).where("p is null or n is null")
    return e.groupBy("cluster").agg(F.count("*").alias("ends"))


def trim(members: DataFrame, e: DataFrame, least: int, rounds: int | None, write=None) -> tuple[DataFrame, DataFrame]:
    """Drops nodes of at most one edge that fewer than ``least`` genomes support, all of a round at once.

    Stops when none is left or after the rounds (None: no limit, which needs ``write``). members: (cluster, support); e: (a, b). ``write`` cuts the lineage
    between rounds; None suits a few rounds.
    """
    nodes, e = members, e.select("a", "b")
    for _ in itertools.count() if rounds is None else range(rounds):
        weak = degree(nodes, e).where("degree <= 1").join(nodes.where(F.col("support") < least), "cluster").select("cluster")
        if write:
            weak = write(weak)
            if weak.isEmpty():
                break
        nodes = nodes.join(weak, "cluster", "left_anti")
        e = e.join(weak, e.a == weak.cluster, "left_anti").join(weak, F.col("b") == weak.cluster, "left_anti")
        if write:
            nodes, e = write(nodes), write(e)
    return nodes, e


def clean_edges(nodes: DataFrame, ends: DataFrame, e: DataFrame, least: float, share: float = 0.05) -> DataFrame:
    """Drops edges of little support at contig ends, or of little support for their nodes: likely misassemblies."""
    n = nodes.join(ends.select(F.col("cluster").alias("end")), F.col("cluster") == F.col("end"), "left").select("cluster", "support", F.col("end").isNotNull().alias("end"))
    a = n.select(F.col("cluster").alias("a"), F.col("support").alias("sa"), F.col("end").alias("ea"))
    b = n.select(F.col("cluster").alias("b"), F.col("support").alias("sb"), F.col("end").alias("eb"))
    bad = (F.col("support") < least) & (F.col("ea") | F.col("eb") | (F.col("support") < share * F.least("sa", "sb")))
    return e.join(a, "a").join(b, "b").where(~bad).select("a", "b", "support")


def structural_variants(members: DataFrame, least: int, centre_degree: int = 3) -> DataFrame:
    """(centre, a, b, support): pairs of edges at a node of three or more that at least so many genomes share.

    Edges of less support can't be in a pair and are dropped first. Then either the edges of a node are paired and their
    genomes compared, or the edges of a node in one genome are paired and the pairs counted: whichever makes fewer rows.
    """
    sets = F.when(F.count("*") >= least, F.collect_list("genome"))
    e = written(members.groupBy("a", "b").agg(sets.alias("g")))
    strong = both_ways(e.where("g is not null"))
    degrees = written(strong.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
    few = written(degrees.where(F.col("n") < centre_degree))  # nodes whose edges of less support decide
    every = both_ways(e.select("a", "b")).join(few, "node", "left_semi").groupBy("node").count().where(F.col("count") >= centre_degree)
    centres = degrees.where(F.col("n") >= centre_degree).unionAll(few.join(every, "node", "left_semi"))
    inc = written(strong.join(centres, "node"))
    one = inc.select("node", "neighbour", F.explode("g").alias("genome"))
    square = F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1)), F.lit(0.0))
    by_edge, by_genome = (x.agg(square).first()[0] for x in (centres, one.groupBy("node", "genome").agg(F.count("*").alias("n"))))
    if by_edge > by_genome:
        left = one.select("node", "genome", F.col("neighbour").alias("x"))
        right = one.select("node", "genome", F.col("neighbour").alias("y"))
        pairs = left.join(right, ["node", "genome"]).where("x < y").groupBy("node", "x", "y").agg(F.count("*").alias("support"))
    else:
        pairs = _edge_pairs(inc, members.select("genome").distinct())
    return pairs.where(F.col("support") >= least).select(F.col("node").alias("centre"), F.col("x").alias("a"), F.col("y").alias("b"), "support")


def _edge_pairs(inc: DataFrame, genomes: DataFrame) -> DataFrame:
    """(node, x, y, support): pairs of a node's neighbours x < y and the genomes that both edges have.

    The neighbours of a node are cut into blocks, and each pair of blocks is a join key, so no hub is one task. Up to BITS
    genomes, sets of them are compared as bits of numbers.
    """
    known = sorted((r[0] for r in genomes.limit(BITS + 1).collect()), key=lambda g: (g is not None, g))
    words = [known[i : i + 63] for i in range(0, len(known), 63)] if len(known) <= BITS else []
    if words:
        sets = inc.select("node", "neighbour", "n", F.explode("g").alias("genome"))
        numbers = [F.coalesce(F.sum(F.expr("case " + " ".join(f"when number = {63 * w + i} then {1 << i}L" for i in range(len(x))) + " end")), F.lit(0).cast("bigint")).alias(f"g{w}") for w, x in enumerate(words)]
        table = inc.sparkSession.createDataFrame([(g, i) for i, g in enumerate(known)], inc.schema["g"].dataType.elementType.simpleString().join(["genome ", ", number int"]))
        table = table.withColumnRenamed("genome", "known")
        sets = sets.join(F.broadcast(table), F.col("genome").eqNullSafe(F.col("known"))).groupBy("node", "neighbour", "n").agg(*numbers)
    else:
        sets = inc.withColumnRenamed("g", "g0")
    held = [f"g{w}" for w in range(max(1, len(words)))]
    blocks = F.ceil(F.col("n") / PAIRED).cast("int")
    sets = written(sets.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("neighbour"), blocks).cast("int")}))
    left = sets.select("node", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("neighbour").alias("l"), *[F.col(g).alias(f"l{g}") for g in held])
    right = sets.select("node", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("neighbour").alias("r"), *[F.col(g).alias(f"r{g}") for g in held])
    pairs = left.join(right, ["node", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("l") < F.col("r")))
    support = F.expr(" + ".join(f"bit_count(l{g} & r{g})" for g in held)) if words else F.size(F.array_intersect("lg0", "rg0"))
    return pairs.select("node", F.least("l", "r").alias("x"), F.greatest("l", "r").alias("y"), support.cast("bigint").alias("support"))


def missing_with_neighbour(members: DataFrame, em: DataFrame, least: int) -> DataFrame:
    """(cluster, genome): a cluster lacks a genome that one of its neighbours has; for clusters of enough support."""
    strong = members.groupBy("cluster").count().where(F.col("count") >= least).select("cluster")
    sym = both_ways(em.select("a", "b").distinct()).join(strong, F.col("node") == F.col("cluster"), "left_semi")
    near = sym.join(members.select(F.col("cluster").alias("neighbour"), "genome"), "neighbour").select(F.col("node").alias("cluster"), "genome").distinct()
    return near.join(members, ["cluster", "genome"], "left_anti")


def delete_nodes(members: DataFrame, em: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops clusters and bridges their neighbours: in each genome, all live neighbours of a deleted node pairwise."""
    inc = both_ways(em).join(dead.select(F.col("cluster").alias("node")), "node", "left_semi")
    live = inc.join(dead.select(F.col("cluster").alias("neighbour")), "neighbour", "left_anti").select("node", "genome", "neighbour")
    pairs = live.select("node", "genome", F.col("neighbour").alias("a")).join(live.select("node", "genome", F.col("neighbour").alias("b")), ["node", "genome"]).where("a < b")
    left = em.join(dead, em.a == dead.cluster, "left_anti").join(dead, F.col("b") == dead.cluster, "left_anti")
    out = left.unionByName(pairs.select("a", "b", "genome")).distinct()
    return members.join(dead, "cluster", "left_anti"), out


def remove_members(members: DataFrame, em: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes genomes off nodes, (cluster, genome) each, and bridges those nodes' neighbours for that genome; emptied edges vanish."""
    inc = both_ways(em)
    hit = inc.join(pairs.select(F.col("cluster").alias("node"), "genome"), ["node", "genome"], "left_semi")
    live = hit.join(pairs.select(F.col("cluster").alias("neighbour"), "genome"), ["neighbour", "genome"], "left_anti")
    bridge = live.select("node", "genome", F.col("neighbour").alias("a")).join(live.select("node", "genome", F.col("neighbour").alias("b")), ["node", "genome"]).where("a < b")
    gone = pairs.select("cluster", "genome")
    left = em.join(gone.withColumnRenamed("cluster", "a"), ["a", "genome"], "left_anti").join(gone.withColumnRenamed("cluster", "b"), ["b", "genome"], "left_anti")
    return members.join(gone, ["cluster", "genome"], "left_anti"), left.select("a", "b", "genome").unionByName(bridge.select("a", "b", "genome")).distinct()


def contract(members: DataFrame, em: DataFrame, into: DataFrame, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merges nodes by (old, new): members are united, edges re-attached, inner edges vanish.

    check: fails if two nodes that are merged share a genome.
    """
    m = members.join(into, members.cluster == into.old, "left").select(F.coalesce("new", "cluster").alias("cluster"), "genome")
    if check:
        n = m.groupBy("cluster", "genome").count()
        m = n.select("cluster", F.when(F.col("count") > 1, F.raise_error(F.lit("merged nodes share a genome")).cast("string")).otherwise(F.col("genome").cast("string")).cast(members.schema["genome"].dataType).alias("genome"))
    a = into.select(F.col("old").alias("a"), F.col("new").alias("na"))
    b = into.select(F.col("old").alias("b"), F.col("new").alias("nb"))
    e = em.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y"), "genome").where("x <> y")
    return m.distinct(), e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "genome").distinct()


def within(e: DataFrame, start: DataFrame, depth: int, write=None) -> DataFrame:
    """(source, node, hops): nodes within ``depth`` edges of each source; a frontier that never goes back."""
    sym = both_ways(e.select("a", "b"))
    seen = start.select(F.col("cluster").alias("source"), F.col("cluster").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, depth + 1):
        step = front.join(sym, "node").select("source", F.col("neighbour").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front = step.withColumn("hops", F.lit(h))
        if write:
            front = write(front)
        seen = seen.unionByName(front)
    return seen


def components(e: DataFrame, nodes: DataFrame, write, rounds: int = 60) -> DataFrame:
    """(cluster, component): the least node of each connected component, by large-star and small-star rounds.

    Some ten rounds settle any graph seen; one that isn't settled after all rounds fails.
    """
    cur = write(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        new = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark is not None and tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        cur = write(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(cur.select(F.col("u").alias("cluster"), F.col("v").alias("root")), "cluster", "left").select("cluster", F.coalesce("root", "cluster").alias("component"))


def ordered_components(component: DataFrame, support: DataFrame) -> DataFrame:
    """(cluster, fragment, place) of (cluster, component): components numbered by size, the largest first (of equals, the
    least name), and places of clusters in each by support, the largest first."""
    size = component.groupBy("component").agg(F.count("*").alias("n"))
    number = size.withColumn("fragment", F.row_number().over(Window.orderBy(F.desc("n"), "component"))).select("component", "fragment")  # a thin row per component
    place = F.row_number().over(Window.partitionBy("fragment").orderBy(F.desc("support"), "cluster"))
    return component.join(number, "component").join(support, "cluster").select("cluster", "fragment", place.alias("place"))


def repeated_edges(genes: DataFrame, more_than: int = 3) -> DataFrame:
    """(a, b, genome, times): pairs of clusters that are next to each other more than so many times in one genome."""
    before = F.lag("cluster").over(Window.partitionBy("genome", "contig").orderBy("ix"))
    e = genes.withColumn("p", before).where(F.col("p").isNotNull() & (F.col("p") != F.col("cluster")))
    return e.groupBy(F.least("p", "cluster").alias("a"), F.greatest("p", "cluster").alias("b"), "genome").agg(F.count("*").alias("times")).where(F.col("times") > more_than)


def merge_graphs(graphs: list[DataFrame]) -> DataFrame:
    """Nodes of several (cluster, genome) relations joined by shared cluster: (cluster, graphs, genomes, paralog).

    Genomes of different graphs are different; a cluster is a paralog if two graphs bring it.
    """
    out = None
    for i, g in enumerate(graphs):
        part = presence(g).withColumn("graph", F.lit(i))
        out = part if out is None else out.unionByName(part)
    per = out.groupBy("cluster", "graph").agg(F.count("*").alias("n"))
    return per.groupBy("cluster").agg(F.count("*").alias("graphs"), F.sum("n").alias("genomes"), (F.count("*") > 1).alias("paralog"))
