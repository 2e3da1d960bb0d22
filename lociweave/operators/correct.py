"""Correction of the graph: paralogs, families, genes that annotation missed, single genomes added."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import search_dna
from ..sources.stage import prepared, written
from . import graph, matrix


def split_paralogs(genes: DataFrame) -> DataFrame:
    """genes with ``node``: a cluster's one node, or a node for each gene of a cluster that repeats in a genome."""
    twice = matrix.paralogs(genes).select("cluster", F.lit(True).alias("paralog"))
    own = F.concat_ws("#", "cluster", F.concat_ws("_", F.col("genome").cast("string"), F.col("contig").cast("string"), F.col("ix").cast("string")))
    return genes.join(twice, "cluster", "left").withColumn("node", F.when(F.col("paralog"), own).otherwise(F.col("cluster"))).withColumn("paralog", F.coalesce("paralog", F.lit(False)))


def as_nodes(genes: DataFrame) -> DataFrame:
    """The gene relation with nodes in place of clusters."""
    return genes.select("genome", "contig", "ix", F.col("node").alias("cluster"))


def merge_paralogs(nodes: DataFrame, members: DataFrame, em: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts paralog nodes that share a centroid, (node, centroid), transitively and whatever their genomes."""
    links = nodes.select(F.col("node").alias("a"), F.concat(F.lit("centroid "), F.col("centroid").cast("string")).alias("b"))
    every = links.select(F.col("a").alias("cluster")).unionAll(links.select(F.col("b").alias("cluster"))).distinct()
    comp = graph.components(links, every, written).join(nodes.select(F.col("node").alias("cluster")).distinct(), "cluster")
    least = comp.groupBy("component").agg(F.min("cluster").alias("new"))
    into = written(comp.join(least, "component").select(F.col("cluster").alias("old"), "new"))
    return graph.contract(members, em, into)


def collapse_paralogs(genes: DataFrame, depth: int = 5) -> DataFrame:
    """(node, bucket) for the nodes of clusters that repeat: copies by their place in the graph.

    The genome with most copies (the least of equals) gives a bucket per copy. Each other copy, in order, goes to the
    bucket that is nearest in hops and doesn't hold its genome; if none is in reach, to that of the best context (the
    clusters near both, by difference of depth); else it opens a bucket. All distances are those of the graph before.
    """
    g = written(split_paralogs(genes))
    em = written(graph.edges(graph.edge_members(as_nodes(g))).select("a", "b"))
    copies = written(g.where("paralog").select("cluster", "genome", "node"))
    n = copies.groupBy("cluster", "genome").agg(F.count("*").alias("n"))
    ref = n.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "genome"))).where("r = 1").select("cluster", "genome")
    buckets = written(copies.join(ref, ["cluster", "genome"]).select("cluster", F.col("node").alias("bucket")))
    near = written(graph.within(em, copies.select(F.col("node").alias("cluster")), depth, written))
    hops = near.join(buckets.select(F.col("bucket").alias("node"), F.col("cluster").alias("own")), "node").select(F.col("source"), F.col("node").alias("bucket"), "hops", "own")
    hops = hops.join(copies.select(F.col("node").alias("source"), "cluster"), "source").where("cluster = own").select("source", "bucket", "hops")
    of = g.select("node", F.col("cluster").alias("c")).distinct()
    context = written(near.where("hops > 0").join(of, "node").groupBy("source", "c").agg((depth + 1 - F.max("hops")).alias("d")))
    mine = context.join(copies.select(F.col("node").alias("source"), "cluster"), "source")
    theirs = context.join(buckets.select(F.col("bucket").alias("source"), "cluster"), "source").select(F.col("source").alias("bucket"), "cluster", "c", F.col("d").alias("d2"))
    score = mine.join(theirs, ["cluster", "c"]).groupBy("source", "bucket").agg(F.sum(1 / (1 + F.abs(F.col("d") - F.col("d2")))).alias("score"))
    rows = copies.join(buckets, "cluster").select("cluster", "genome", F.col("node").alias("source"), "bucket").join(hops, ["source", "bucket"], "left").join(score, ["source", "bucket"], "left")
    kind = rows.schema["genome"].dataType.simpleString()
    return rows.select("cluster", "genome", "source", "bucket", "hops", "score").groupBy("cluster").applyInPandas(_assign, f"cluster string, genome {kind}, node string, bucket string")


def _assign(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of one cluster to buckets, in order of the copies."""
    held: dict[str, set] = {b: set() for b in sorted(rows["bucket"].unique())}
    out = []
    for node, r in sorted(rows.groupby("source"), key=lambda x: (x[0] not in held, x[0])):
        genome = r["genome"].iloc[0]
        if node in held:
            b = node
        else:
            free = r[[genome not in held[x] for x in r["bucket"]]]
            reach, rated = free[free["hops"].notna()], free[free["score"].notna()]
            if len(reach):
                b = min(zip(reach["hops"], reach["bucket"], strict=True))[1]
            elif len(rated):
                b = min(zip(-rated["score"], rated["bucket"], strict=True))[1]
            else:
                b = next((x for x in sorted(held) if x.startswith("new ") and genome not in held[x]), None) or f"new {node}"
                held.setdefault(b, set())
        held[b].add(genome)
        out.append((rows["cluster"].iloc[0], genome, node, b))
    return pd.DataFrame(out, columns=["cluster", "genome", "node", "bucket"])


#: Nodes of most edges around which similar clusters are looked for first, at most 63.
HUBS = 32


def collapse_families(members: DataFrame, em: DataFrame, similar: DataFrame, depths: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts similar clusters, (a, b), that are near each other in the graph and share no genome.

    Near: within ``depth`` hops of one node of three or more edges. In each round every cluster names its best
    partner (most genomes, then the least name) and pairs that name each other are contracted at once; rounds go on
    until none is left. Returns members, edge members and (old, new). The order of a sequential run isn't kept.
    """
    all_members, all_edges = written(members), written(em)
    sim = similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    # pairs that share a genome never can merge, as genomes only come to a cluster; of the rest, only their members are needed
    sim = written(_apart(written(sim), all_members))
    members = written(all_members.join(_either(sim), "cluster", "left_semi"))
    names, first = None, _either(sim)
    for depth in depths:
        e = all_edges.select("a", "b").distinct()
        fixed = None
        if depth == 1:  # edges of clusters that may merge; of others, their number of neighbours that can't
            e = written(e.join(first.select(F.col("cluster").alias("a"), F.lit(True).alias("ia")), "a", "left").join(first.select(F.col("cluster").alias("b"), F.lit(True).alias("ib")), "b", "left").select("a", "b", F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib")))
            fixed = graph.both_ways(e.where("not ia and not ib").select("a", "b")).groupBy("node").count()
            e = e.where("ia or ib").select("a", "b")
            fixed = written(fixed.join(graph.both_ways(e).select("node").distinct(), "node", "left_semi"))
        e = written(_renamed(e, names))
        masks = _hubs(e, all_members, names, depth) if depth > 1 else None
        look = sim
        while True:  # each round contracts at least one pair
            degrees = graph.both_ways(e).groupBy("node").count()
            degrees = degrees.unionAll(fixed).groupBy("node").agg(F.sum("count").alias("count")) if fixed else degrees
            centres = degrees.where("count > 2").select("node")
            if depth == 1:
                near = written(graph.within(e, written(_either(look)), depth, written).join(centres, "node", "left_semi").select(F.col("source").alias("word"), "node"))
                free = written(look.join(near.withColumnRenamed("word", "a"), "a").join(near.withColumnRenamed("word", "b"), ["node", "b"], "left_semi").select("a", "b").distinct())
            else:
                free = _near(look, masks, e, centres, depth)
            if free.isEmpty():
                break
            sup = matrix.support(members)
            sym = free.unionAll(free.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = sym.join(sup.select(F.col("cluster").alias("b"), "support"), "b").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("support"), "b"))).where("r = 1").select("a", "b")
            pairs = best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") < F.col("x.b"))).select("x.a", "x.b")
            into = written(pairs.select(F.col("b").alias("old"), F.col("a").alias("new")))
            if into.isEmpty():  # a ring of equal choices: contract its least pair
                into = written(free.orderBy("a", "b").limit(1).select(F.col("b").alias("old"), F.col("a").alias("new")))
            e = written(_renamed(e, into))
            members = written(members.join(into, members.cluster == into.old, "left").select(F.coalesce("new", "cluster").alias("cluster"), "genome").distinct())
            sim = written(_apart(written(_renamed(sim, into)), members))
            if depth == 1:
                # a pair that wasn't near is so now only if it, or the node in the middle, was merged: at others, ways only got fewer
                merged = into.select(F.col("new").alias("cluster"))
                around = written(graph.within(e, merged, 1).select(F.col("node").alias("cluster")).distinct())
                of = lambda c, x: F.col(c) == x["cluster"]
                own = sim.join(merged, of("a", merged), "left_semi").unionAll(sim.join(merged, of("b", merged), "left_semi"))
                middle = sim.join(around, of("a", around), "left_semi").join(around, of("b", around), "left_semi")
                look = written(own.unionAll(middle).unionAll(sim.join(_renamed(free, into), ["a", "b"], "left_semi")).distinct())
            else:
                look = sim
                masks = masks.join(into, masks.cluster == into.old, "left").select(F.coalesce("new", "cluster").alias("cluster"), "mask")
                masks = written(masks.groupBy("cluster").agg(F.bit_or("mask").alias("mask")))
            if names is None:
                names = into
            else:
                step = into.select(F.col("old").alias("o"), F.col("new").alias("n"))
                names = written(names.join(step, F.col("new") == F.col("o"), "left").select("old", F.coalesce("n", "new").alias("new")).unionAll(into))
    every = all_members.select("cluster").distinct()
    if names is None:
        return all_members, all_edges, every.select(F.col("cluster").alias("old"), F.col("cluster").alias("new"))
    renamed = every.join(names, F.col("cluster") == F.col("old"), "left").select(F.col("cluster").alias("old"), F.coalesce("new", "cluster").alias("new"))
    return *graph.contract(all_members, all_edges, names), renamed


def _hubs(e: DataFrame, members: DataFrame, names: DataFrame | None, depth: int) -> DataFrame:
    """(cluster, mask): a bit for each of HUBS centres within ``depth`` hops.

    Contraction shortens distances, so what is near a hub stays so while the hub has three edges. It keeps them: a cluster is
    of at most as many merged ones as there are genomes, n, so of 3 n neighbours with genomes at least 3 clusters are left.
    """
    least = 3 * members.select("genome").distinct().count()
    known = members.select(F.col("cluster").alias("neighbour")).distinct()
    if names is not None:
        known = known.join(names, F.col("neighbour") == F.col("old"), "left").select(F.coalesce("new", "neighbour").alias("neighbour")).distinct()
    sym = graph.both_ways(e)
    most = sym.join(known, "neighbour", "left_semi").groupBy("node").count().where(F.col("count") >= least).orderBy(F.desc("count"), "node").limit(HUBS)
    bit = F.row_number().over(Window.orderBy("node")) - 1  # of HUBS rows
    reach = written(most.withColumn("i", bit).selectExpr("node as cluster", "shiftleft(1L, i) as mask"))
    for _ in range(depth):
        step = reach.join(sym, reach.cluster == sym.node).select(F.col("neighbour").alias("cluster"), "mask")
        reach = written(reach.unionAll(step).groupBy("cluster").agg(F.bit_or("mask").alias("mask")))
    return reach


def _near(pairs: DataFrame, masks: DataFrame, e: DataFrame, centres: DataFrame, depth: int) -> DataFrame:
    """Pairs with a centre within ``depth`` hops of both: those near the same hub, the rest by what is around them.

    Of the rest, one is far from hubs as a rule. What touches a centre near it meets what is a hop less around the other.
    """
    of = lambda c: masks.select(F.col("cluster").alias(c), F.col("mask").alias(f"m{c}"))
    held = written(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ma", F.lit(0)).alias("ma"), F.coalesce("mb", F.lit(0)).alias("mb")))
    sure = held.where("(ma & mb) <> 0").select("a", "b")
    swap = F.bit_count("ma") < F.bit_count("mb")
    rest = held.where("(ma & mb) = 0").select("a", "b", F.when(swap, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("y"))
    rest = written(rest)
    if rest.isEmpty():
        return written(sure)
    ball = graph.within(e, written(rest.select(F.col("x").alias("cluster")).distinct()), depth, written).join(centres, "node", "left_semi").select(F.col("source").alias("x"), "node")
    ball = written(ball)
    sym = graph.both_ways(e)
    touch = ball.unionAll(ball.join(sym, "node").select("x", F.col("neighbour").alias("node"))).distinct()
    other = graph.within(e, written(rest.select(F.col("y").alias("cluster")).distinct()), depth - 1, written).select(F.col("source").alias("y"), "node")
    return written(sure.unionAll(rest.join(other, "y").join(touch, ["x", "node"], "left_semi").select("a", "b").distinct()))


def _either(pairs: DataFrame) -> DataFrame:
    """(cluster): those of any pair."""
    return pairs.select(F.col("a").alias("cluster")).unionAll(pairs.select(F.col("b").alias("cluster"))).distinct()


def _apart(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs that share no genome."""
    both = pairs.join(members.withColumnRenamed("cluster", "a"), "a").join(members.withColumnRenamed("cluster", "b"), ["b", "genome"], "left_semi").select("a", "b").distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def _renamed(pairs: DataFrame, into: DataFrame | None) -> DataFrame:
    """(a, b) after clusters took new names, (old, new): a before b, each once. pairs has each once.

    Only pairs of clusters that took or gave a name can become equal, so the others aren't shuffled if names are few.
    """
    if into is None:
        return pairs
    names = into.select("old", "new").unionAll(into.select(F.col("new").alias("old"), "new")).distinct()
    x, y = (names.select(F.col("old").alias(f"o{c}"), F.col("new").alias(f"n{c}")) for c in "ab")
    p = pairs.join(x, F.col("a") == F.col("oa"), "left").join(y, F.col("b") == F.col("ob"), "left")
    still = p.where("na is null and nb is null").select("a", "b")
    moved = p.where("na is not null or nb is not null").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
    moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return still.unionAll(moved)


def one_edit_apart(words: DataFrame, least: int = 1) -> DataFrame:
    """(a, b): words (of at least so many letters) that one edit turns into each other, met under their one-letter deletions."""
    w = words.where(F.length("cluster") >= least)
    cut = F.transform(F.sequence(F.lit(1), F.length("cluster")), lambda i: F.concat(F.substring("cluster", F.lit(1), i - 1), F.substring("cluster", i + 1, F.length("cluster"))))
    v = w.select("cluster", F.explode(F.array_distinct(F.array_append(cut, F.col("cluster")))).alias("v"))
    # forms are many times the words that they are estimated by, so neither side is to be broadcast
    p = v.select("v", F.col("cluster").alias("a")).join(v.select("v", F.col("cluster").alias("b")).hint("merge"), "v").where("a < b").select("a", "b").distinct()
    return p.where(F.levenshtein("a", "b") <= 1)


def find_missing(members: DataFrame, em: DataFrame, located: DataFrame, contigs: DataFrame, radius: int = 5000, prop_match: float = 0.2, identity: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Genes found where neighbours are but annotation has none, and annotated genes that larger clusters' genes cover.

    located: (cluster, genome, contig, start, end, strand, dna), 1-based closed; contigs: (genome, contig, seq).
    A cluster is looked for around its neighbours' places in each genome that lacks it; the longest hit counts. On each
    contig, clusters of more genomes come first (of equals, the greater name), and a gene of which half or more of the
    cluster's longest one is taken by then loses its place. Returns (cluster, genome, contig, start, end, strand, dna) of the
    found and (cluster, genome) of the annotated ones that lost it.
    """
    prepared(members.sparkSession)
    want = graph.missing_with_neighbour(members, em, 1)
    long = located.groupBy("cluster").agg(F.max_by("dna", F.struct(F.length("dna"), "dna")).alias("query"))
    sym = graph.both_ways(em.select("a", "b").distinct()).withColumnRenamed("node", "cluster")
    near = located.select(F.col("cluster").alias("neighbour"), "genome", "contig", "start", "end")
    rows = want.join(sym, "cluster").join(near, ["neighbour", "genome"]).join(long, "cluster").join(contigs.select("genome", "contig", "seq"), ["genome", "contig"])
    low = F.greatest(F.col("start") - radius, F.lit(1))
    rows = rows.select("cluster", "genome", "contig", "query", low.cast("bigint").alias("low"), F.substring("seq", low, F.col("end") + radius - low + 1).alias("window")).distinct()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                hit = search_dna(r.window, r.query, prop_match, identity)
                if hit:
                    seq, (s, e), strand = hit
                    out.append((r.cluster, r.genome, r.contig, r.low + s, r.low + e - 1, strand, seq))
            yield pd.DataFrame(out, columns=["cluster", "genome", "contig", "start", "end", "strand", "dna"])

    t = members.schema["genome"].dataType.simpleString()
    c = contigs.schema["contig"].dataType.simpleString()
    shape = f"cluster string, genome {t}, contig {c}, start bigint, end bigint, strand int, dna string"
    hits = rows.mapInPandas(search, shape)
    best = written(hits.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "genome").orderBy(F.desc(F.length("dna")), "contig", "start"))).where("r = 1").drop("r").withColumn("found", F.lit(True)))
    there = located.select("cluster", "genome", "contig", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.lit(0).alias("strand"), F.lit("").alias("dna"), F.lit(False).alias("found"))
    size = matrix.support(members).join(long.select("cluster", F.length("query").alias("longest")), "cluster")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """Places of one contig, by clusters; the intervals kept are few and disjoint or nearly so."""
        kept: list[tuple[int, int]] = []
        fine = []
        for r in rows.sort_values(["support", "cluster", "found"], ascending=[False, False, True]).itertuples():
            covered = sum(max(0, min(e, r.end) - max(s, r.start) + 1) for s, e in _union(kept, r.start, r.end))
            if covered < 0.5 * r.longest:
                kept.append((r.start, r.end))
                fine.append(r.Index)
        return rows.assign(ok=rows.index.isin(fine)).drop(columns=["support", "longest"])

    every = best.unionByName(there).join(size, "cluster")
    settled = written(every.groupBy("genome", "contig").applyInPandas(settle, shape + ", found boolean, ok boolean"))
    return settled.where("found and ok").drop("found", "ok"), settled.where("not found and not ok").select("cluster", "genome").join(settled.where("not found and ok").select("cluster", "genome"), ["cluster", "genome"], "left_anti").distinct()


def _union(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Disjoint spans that cover what some spans cover of an interval."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for s, e in spans if e >= low and s <= high):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def drop_by_consensus(members: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters that were found again in more genomes than annotation had them in: likely no genes."""
    return found.groupBy("cluster").agg(F.count("*").alias("hits")).join(matrix.support(members), "cluster").where("hits > support").select("cluster")


def integrate(members: DataFrame, em: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the genes of new genomes to a graph: counts are unions, so the old part isn't rebuilt."""
    return members.unionByName(matrix.presence(genes).select(*members.columns)).distinct(), em.unionByName(graph.edge_members(genes).select(*em.columns)).distinct()
