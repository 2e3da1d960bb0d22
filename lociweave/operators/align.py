"""Alignments: columns, entropy, filters, and multiple alignment of genes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import centre_star, codon_align

CLASSES = ("a", "c", "g", "t", "other")


def column_counts(records: DataFrame) -> DataFrame:
    """(gene, pos, a, c, g, t, other) of (gene, aligned): bases in each column."""
    r = records.select("gene", F.posexplode(F.split(F.lower("aligned"), "")).alias("pos", "base")).where("base <> ''")
    count = lambda c: F.count(F.when(c, 1)).alias
    known = F.col("base").isin(*CLASSES[:4])
    return r.groupBy("gene", "pos").agg(*[count(F.col("base") == b)(b) for b in CLASSES[:4]], count(~known)("other"))


def entropy(counts: DataFrame) -> DataFrame:
    """(gene, entropy): column entropies over the four bases, weighted by the share of bases in the column."""
    total = sum(F.col(c) for c in CLASSES)
    p = {c: F.col(c) / total for c in CLASSES}
    h = -sum(F.when(F.col(c) > 0, p[c] * F.log(p[c])).otherwise(0.0) for c in CLASSES[:4])
    return counts.groupBy("gene").agg(F.round(F.sum((1 - p["other"]) * h) / F.sum(1 - p["other"]), 6).alias("entropy"))


def entropy_filter(per_gene: DataFrame, least: float = 0.01, threshold: float | None = None) -> DataFrame:
    """Genes at or below the threshold; by default the upper outlier bound, ``least`` at least."""
    if threshold is not None:
        return per_gene.where(F.col("entropy") <= threshold)
    q = per_gene.agg(F.expr("percentile(entropy, array(0.25, 0.75))").alias("q"))
    bound = F.greatest(F.lit(least), F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]))
    return per_gene.join(F.broadcast(q)).where(F.col("entropy") <= F.round(bound, 9)).drop("q")


def best_records(records: DataFrame) -> DataFrame:
    """One record per gene and genome: that of fewest gaps, the first of equals."""
    gaps = F.length("aligned") - F.length(F.regexp_replace("aligned", "-", ""))
    w = Window.partitionBy("gene", "genome").orderBy(gaps, "record")
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def align_genes(records: DataFrame) -> DataFrame:
    """(gene, record, aligned) of (gene, record, seq): a multiple alignment per gene, the gene's sequences in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record")
        rows["aligned"] = centre_star(rows["seq"].tolist())
        return rows[["gene", "record", "aligned"]]

    s = records.select("gene", "record", "seq")
    return s.groupBy("gene").applyInPandas(run, f"gene {s.schema['gene'].dataType.simpleString()}, record {s.schema['record'].dataType.simpleString()}, aligned string")


def codon_alignment(records: DataFrame) -> DataFrame:
    """(gene, record, aligned protein, dna) to aligned codons; rows whose DNA doesn't fit the protein are left out."""
    fits = F.length("dna") >= 3 * F.length(F.regexp_replace("aligned", "-", ""))
    fold = F.udf(codon_align, "string")
    return records.where(fits & ~F.col("dna").contains("NN")).select("gene", "record", fold("aligned", "dna").alias("aligned"))


def concatenated(records: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome, aligned): genes side by side in order; a genome without a gene has gaps there."""
    best = best_records(records)
    lengths = best.groupBy("gene").agg(F.max(F.length("aligned")).alias("len"))
    grid = lengths.join(genomes.select("genome").distinct())  # genes times genomes: the alignment itself
    full = grid.join(best.select("gene", "genome", "aligned"), ["gene", "genome"], "left").withColumn("aligned", F.coalesce("aligned", F.expr("repeat('-', len)")))
    parts = full.groupBy("genome").agg(F.array_sort(F.collect_list(F.struct("gene", "aligned"))).alias("p"))
    return parts.select("genome", F.array_join(F.transform("p", lambda x: x["aligned"]), "").alias("aligned"))
