"""Presence and absence of clusters in genomes: long relations, categories, spectra, exports' names and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# shares of genomes from which a gene is core, soft core, shell
CORE, SOFT, SHELL = 0.99, 0.95, 0.15


def presence(genes: DataFrame) -> DataFrame:
    """(cluster, genome) once each: the membership relation."""
    return genes.select("cluster", "genome").distinct()


def support(members: DataFrame) -> DataFrame:
    """Number of genomes of each cluster."""
    return members.groupBy("cluster").agg(F.count("*").alias("support"))


def genome_count(members: DataFrame) -> DataFrame:
    """One row: n, the number of genomes."""
    return members.agg(F.countDistinct("genome").alias("n"))


def category(share) -> F.Column:
    return F.when(share >= CORE, "core").when(share >= SOFT, "soft_core").when(share >= SHELL, "shell").otherwise("cloud")


def summary(members: DataFrame) -> DataFrame:
    """One row of core, soft_core, shell, cloud and total counts."""
    share = F.col("support") / F.col("n")
    s = support(members).join(F.broadcast(genome_count(members)))  # one row
    c = s.select(category(share).alias("c"))
    return c.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(k) for k in ("core", "soft_core", "shell", "cloud")], F.count("*").alias("total"))


def core_genes(members: DataFrame, threshold: float = SOFT) -> DataFrame:
    """Clusters in at least this share of the genomes."""
    return support(members).join(F.broadcast(genome_count(members))).where(F.col("support") / F.col("n") >= threshold).select("cluster", "support")


def core_subset(members: DataFrame, size: int, threshold: float = SOFT) -> DataFrame:
    """A fixed sample of core clusters: those of the smallest digests."""
    return core_genes(members, threshold).withColumn("digest", F.md5("cluster")).orderBy("digest", "cluster").limit(size)


def spectrum(members: DataFrame) -> DataFrame:
    """G(k): how many clusters are in exactly k genomes."""
    return support(members).groupBy(F.col("support").alias("k")).agg(F.count("*").alias("genes"))


def wide(genes: DataFrame, genomes: list, prefix: str = "g") -> DataFrame:
    """A row per cluster and a column of gene counts per genome: a pivot over the known genomes."""
    out = genes.groupBy("cluster").pivot("genome", genomes).agg(F.count(F.lit(1)))
    return out.select("cluster", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).cast("bigint").alias(f"{prefix}{g}") for g in genomes])


def paralogs(genes: DataFrame) -> DataFrame:
    """Clusters with more genes than genomes."""
    per = genes.groupBy("cluster", "genome").agg(F.count("*").alias("n"))  # two levels: no distinct over a hot cluster
    return per.groupBy("cluster").agg(F.sum("n").alias("genes"), F.count("*").alias("genomes")).where("genes > genomes")


def genes_per_genome(genes: DataFrame) -> DataFrame:
    return genes.groupBy("genome").agg(F.count("*").alias("genes"))


def contigs_per_genome(genes: DataFrame) -> DataFrame:
    return genes.select("genome", "contig").distinct().groupBy("genome").agg(F.count("*").alias("contigs"))


def mean_genome_size(members: DataFrame) -> DataFrame:
    """Mean number of distinct clusters per genome."""
    return members.groupBy("genome").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_size"))


def cells(genes: DataFrame) -> DataFrame:
    """(cluster, genome, cell, fragments): the ids of a cluster's genes in a genome, joined by ``;`` in order."""
    ids = F.concat_ws("_", F.col("genome").cast("string"), F.col("contig").cast("string"), F.col("ix").cast("string"))
    return genes.groupBy("cluster", "genome").agg(F.array_join(F.array_sort(F.collect_list(ids)), ";").alias("cell"), F.count("*").alias("fragments"))


def filter_cells(cell: DataFrame, kinds: tuple[str, ...] = ("frag", "pseudo", "length")) -> DataFrame:
    """Blanks cells of the given kinds; emptied rows stay. frag: several ids; pseudo, length: marked ids."""
    bad = F.lit(False)
    for k in kinds:
        bad = bad | F.col("cell").contains({"frag": ";", "pseudo": "pseudo", "length": "len"}[k])
    return cell.withColumn("cell", F.when(bad, "").otherwise(F.col("cell")))


def gene_names(names: DataFrame) -> DataFrame:
    """(id, annotation) to unique names: the first of a lower-cased name keeps it, others and empty ones are numbered groups."""
    clean = F.regexp_replace("annotation", "[^A-Za-z0-9_~]", "")
    n = names.select("id", clean.alias("clean"))
    n = n.withColumn("nth", F.row_number().over(Window.partitionBy(F.lower("clean")).orderBy("id")))
    keeps = (F.col("clean") != "") & (F.col("nth") == 1)
    kept = n.where(keeps).select("id", F.col("clean").alias("name"))
    # group numbers run over all renamed rows in order: one offset for each range of ids, then a running count in it
    rest = n.where(~keeps).select("id")
    return kept.unionAll(numbered(rest, "id").select("id", F.concat(F.lit("group_"), (F.col("number") - 1).cast("string")).alias("name")))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``number``, 1 and on in order of the distinct key, without bringing all rows to one task.

    A row's number is its place in its own range of keys plus the rows of the ranges before.
    """
    buckets = 256
    cuts = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10000).alias("cuts"))
    rows = rows.join(F.broadcast(cuts)).withColumn("b", F.size(F.filter(F.coalesce("cuts", F.array()), lambda c: c < F.col(key)))).drop("cuts")
    per = rows.groupBy("b").agg(F.count("*").alias("n"))
    before = per.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(key))
    return rows.withColumn("place", place).join(F.broadcast(before), "b").withColumn("number", F.col("before") + F.col("place")).drop("b", "place", "before")


def length_stats(lengths: DataFrame) -> DataFrame:
    """(cluster, length) to min, max, mean, count and mode; of equal modes the smallest."""
    per = lengths.groupBy("cluster", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "length")
    mode = per.withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster", F.col("length").alias("mode"))
    stats = per.groupBy("cluster").agg(F.min("length").alias("min"), F.max("length").alias("max"), F.round(F.sum(F.col("length") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))
    return stats.join(mode, "cluster")


def length_outliers(lengths: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows of (id, cluster, length) whose length is off the cluster's mode by more than the tolerance."""
    mode = length_stats(lengths).select("cluster", "mode")
    return lengths.join(mode, "cluster").where(F.abs(F.col("length") - F.col("mode")) > tolerance * F.col("mode")).select("id", "cluster", "length", "mode")


def annotation_conflicts(rows: DataFrame) -> DataFrame:
    """(cluster, annotation): normalised annotations beyond the first of each cluster, summed."""
    norm = F.regexp_replace(F.lower("annotation"), "[0-9|_]", "")
    kept = rows.where(~F.lower("annotation").isin("", "hypothetical protein")).select("cluster", norm.alias("a")).distinct()
    return kept.groupBy("cluster").agg((F.count("*") - 1).alias("conflicts"))


def metadata_by_cluster(members: DataFrame, metadata: DataFrame) -> DataFrame:
    """(cluster, field, values): the distinct metadata values (genome, field, value) of a cluster's genomes."""
    d = members.join(metadata, "genome").select("cluster", "field", "value").distinct()
    return d.groupBy("cluster", "field").agg(F.array_join(F.array_sort(F.collect_list("value")), ";").alias("values"))


def running_offsets(lengths: DataFrame) -> DataFrame:
    """(gene, length): start of each gene in their concatenation in order of gene; a row per gene."""
    w = Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("gene", "length", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("start"))
