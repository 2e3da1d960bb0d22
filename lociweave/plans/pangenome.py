"""The whole run: annotated genomes to clusters, graph, correction and results, each stage a table."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dna as D
from ..operators import cluster, correct, graph, matrix
from ..sources import readers
from ..sources.stage import written
from .defaults import settings


@dataclass
class Pangenome:
    genes: DataFrame
    members: DataFrame
    edge_members: DataFrame
    summary: DataFrame
    variants: DataFrame

    def register(self, spark: SparkSession) -> None:
        """Every result as a view for SQL."""
        for name in ("genes", "members", "edge_members", "summary", "variants"):
            getattr(self, name).createOrReplaceTempView(f"pangenome_{name}")


def clustered(calls: DataFrame, identity: float, length: float) -> DataFrame:
    """Gene calls with ``cluster``: equal proteins once, then greedy clusters of the distinct ones."""
    distinct = calls.groupBy(F.col("protein").alias("seq")).agg(F.min("clustering_id").alias("id"))
    distinct = written(distinct)
    reps = cluster.greedy(distinct, identity, length)
    return calls.join(distinct.join(reps, "id").select(F.col("seq").alias("protein"), F.col("representative").alias("cluster")), "protein")


def read_inputs(spark: SparkSession, paths: list[str | tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Features and contigs of annotations with sequences in them, pairs of annotation and sequences, and GenBank files."""
    parts = []
    if genbank := [p for p in paths if isinstance(p, str) and p.endswith((".gbk", ".gb", ".gbff"))]:
        parts.append(readers.genbank(spark, genbank))
    if pairs := [p for p in paths if not isinstance(p, str)]:
        parts.append(readers.gff_with_fasta(spark, pairs))
    if whole := [p for p in paths if isinstance(p, str) and p not in genbank]:
        parts.append(readers.gff(spark, whole))
    return tuple(functools.reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))


def run(spark: SparkSession, paths: list[str | tuple[str, str]], mode: str = "strict", strict_genes: bool = False, refind: bool = True, table: int = 11) -> Pangenome:
    """Reads annotations (with sequences), clusters, builds the graph and corrects it by the mode's settings.

    refind: genes that annotation missed are looked for near their neighbours (and, in modes that ask for it, clusters found
    again more often than annotated are dropped); found genes are rows of ``genes`` without a place on their contig.
    """
    s = settings(mode, len(paths))
    features, contigs = read_inputs(spark, paths)
    files = [r[0] for r in features.select("path").distinct().orderBy("path").collect()]  # a row per genome
    genomes = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "path string, genome int")
    calls = written(readers.gene_calls(features, contigs, genomes, strict_genes, table))
    genes = written(clustered(calls, s.identity, s.length).select("genome", F.col("contig_ix").alias("contig"), F.col("gene_ix").alias("ix"), "cluster", "protein"))
    split = correct.split_paralogs(genes)
    buckets = correct.collapse_paralogs(genes).select("node", "bucket")
    nodes = written(split.join(buckets, "node", "left").select("genome", "contig", "ix", F.coalesce("bucket", "node").alias("cluster"), "protein"))
    place = calls.select("genome", F.col("contig_ix").alias("contig"), F.col("gene_ix").alias("ix"), F.col("contig").alias("scaffold"), "start", "end", F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"), "dna")
    nodes = written(nodes.join(place, ["genome", "contig", "ix"]))
    members, em = matrix.presence(nodes), graph.edge_members(nodes)
    # copies that differ by errors in the DNA first, then families of proteins
    for seq, identity, dna in (("dna", s.dna_error, True), ("protein", s.family, False)):
        near = cluster.similar(written(longest(nodes, seq)), identity, k=None if dna else 5, dna=dna)
        members, em, names = correct.collapse_families(members, em, near.select("a", "b"))
        nodes = renamed(nodes, names)
    ends = written(graph.contig_ends(nodes))
    kept, _ = graph.trim(written(matrix.support(members)), written(graph.edges(em)), s.min_trailing_support, s.trailing_rounds, written)
    members, em, nodes = within_clusters(members, em, nodes, kept.select("cluster"))
    if refind:
        located = nodes.select("cluster", "genome", F.col("scaffold").alias("contig"), "start", "end", "strand", "dna")
        found, lost = correct.find_missing(members, em, located, contigs.join(genomes, "path").select("genome", "contig", "seq"), s.search_radius, s.search_match, s.identity)
        members, em = (written(x) for x in graph.remove_members(members, em, lost))
        nodes = nodes.join(lost, ["cluster", "genome"], "left_anti")
        if s.remove_by_consensus:
            dead = written(correct.drop_by_consensus(members, found))
            members, em = (written(x) for x in graph.delete_nodes(members, em, dead))
            nodes, found = nodes.join(dead, "cluster", "left_anti"), found.join(dead, "cluster", "left_anti")
        found = written(found.join(members.select("cluster").distinct(), "cluster", "left_semi"))
        members = written(members.unionByName(found.select("cluster", "genome")).distinct())
        best = longest(nodes, "protein").select(F.col("id").alias("cluster"), F.col("seq").alias("target"))
        again = found.join(best, "cluster").withColumn("protein", D.best_frame("dna", F.col("target"), table)["protein"])
        again = again.select("genome", F.lit(None).cast("int").alias("contig"), F.lit(None).cast("int").alias("ix"), "cluster", "protein", F.col("contig").alias("scaffold"), "start", "end", "strand", "dna")
        nodes = written(nodes.select(again.columns).unionAll(again))
        near = cluster.similar(written(longest(nodes, "protein")), s.family)
        members, em, names = correct.collapse_families(members, em, near.select("a", "b"))
        nodes, ends = renamed(nodes, names), written(ends.join(names.withColumnRenamed("old", "cluster"), "cluster").groupBy(F.col("new").alias("cluster")).agg(F.sum("ends").alias("ends")))
    good = graph.clean_edges(matrix.support(members), ends, graph.edges(em), s.edge_support)
    em = written(em.join(good.select("a", "b"), ["a", "b"], "left_semi"))
    return Pangenome(nodes, members, em, matrix.summary(members), graph.structural_variants(em, s.min_variant_support))


def renamed(genes: DataFrame, names: DataFrame) -> DataFrame:
    """genes with clusters by (old, new)."""
    out = genes.join(names.withColumnRenamed("old", "cluster"), "cluster").withColumn("cluster", F.col("new"))
    return written(out.select(*genes.columns))


def within_clusters(members: DataFrame, em: DataFrame, genes: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of a graph and its genes with only some clusters."""
    em = em.join(kept.withColumnRenamed("cluster", "a"), "a", "left_semi").join(kept.withColumnRenamed("cluster", "b"), "b", "left_semi").select("a", "b", "genome")
    return written(members.join(kept, "cluster", "left_semi")), written(em), written(genes.join(kept, "cluster", "left_semi"))


def longest(genes: DataFrame, column: str) -> DataFrame:
    """(id, seq): the longest sequence of each cluster, the greatest of equals."""
    return genes.groupBy(F.col("cluster").alias("id")).agg(F.max_by(column, F.struct(F.length(column), column)).alias("seq"))


def longest_proteins(genes: DataFrame) -> DataFrame:
    """(id, seq): the longest protein of each cluster, the reference sequences of a graph."""
    return longest(genes, "protein")


def merge(spark: SparkSession, runs: list[Pangenome], mode: str = "strict", identity: float = 0.95, length: float = 0.98) -> Pangenome:
    """One graph of several: genomes are numbered on, clusters joined by their longest proteins, then families.

    Of one graph's clusters that fall to the same representative, one joins it; the others stay by themselves.
    """
    genes, offset = None, 0
    for i, r in enumerate(runs):
        part = r.genes.select((F.col("genome") + offset).cast("int").alias("genome"), "contig", "ix", F.concat(F.lit(f"{i}:"), "cluster").alias("cluster"), "protein")
        genes = part if genes is None else genes.unionByName(part)
        offset += (r.genes.agg(F.max("genome")).first()[0] or 0) + 1
    genes = written(genes)
    longest = written(longest_proteins(genes))
    reps = cluster.greedy(longest, identity, length)
    graph_of = F.substring_index("id", ":", 1)
    place = F.row_number().over(Window.partitionBy("representative", graph_of).orderBy((F.col("id") != F.col("representative")), "id"))
    into = reps.withColumn("r", place).select(F.col("id").alias("cluster"), F.when(F.col("r") == 1, F.col("representative")).otherwise(F.col("id")).alias("new"))
    genes = written(genes.join(into, "cluster").select("genome", "contig", "ix", F.col("new").alias("cluster"), "protein"))
    near = cluster.similar(written(longest_proteins(genes)), settings(mode, offset).family)
    members, em, names = correct.collapse_families(matrix.presence(genes), graph.edge_members(genes.where("ix is not null")), near.select("a", "b"))
    genes = written(genes.join(names.withColumnRenamed("old", "cluster"), "cluster").select("genome", "contig", "ix", F.col("new").alias("cluster"), "protein"))
    return Pangenome(genes, members, em, matrix.summary(members), graph.structural_variants(em, settings(mode, offset).min_variant_support))


def add_genome(spark: SparkSession, old: Pangenome, path: str, mode: str = "strict") -> Pangenome:
    """A graph with one more annotated genome."""
    return merge(spark, [old, run(spark, [path], "sensitive")], mode)
