"""Writers of tables, sequences and graphs. Large results stay many files; exchange formats are one."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F

from ..functions.dna import substring_id
from ..operators.matrix import running_offsets


def fasta(rows: DataFrame, path: str) -> None:
    """(id, seq) as FASTA."""
    rows.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), "seq")).write.text(path)


def gene_data(genes: DataFrame, path: str) -> None:
    """The gene table with its eight columns."""
    cols = {"gff_file": "path", "scaffold_name": "contig", "clustering_id": "clustering_id", "annotation_id": "annotation_id", "prot_sequence": "protein", "dna_sequence": "dna", "gene_name": "gene_name", "description": "description"}
    genes.select(*[F.col(v).alias(k) for k, v in cols.items()]).write.csv(path, header=True)


def presence_absence(cells: DataFrame, names: DataFrame, genomes: list, path: str, fragments: DataFrame | None = None, accessory: DataFrame | None = None, lengths: DataFrame | None = None) -> None:
    """Three tables of (cluster, genome, cell): with fourteen summary columns, with names only, and 0/1; most frequent first.

    names: (cluster, name, annotation). fragments and accessory: (cluster, fragment, place) by ``graph.ordered_components``, of the
    whole graph and of that without core genes; lengths: (cluster, min, max, mean) in bases. What isn't given is empty.
    """
    wide = cells.groupBy("cluster").pivot("genome", genomes).agg(F.first("cell"))
    stats = cells.groupBy("cluster").agg(F.count("*").alias("isolates"), F.sum("fragments").alias("sequences"))
    t = wide.join(stats, "cluster").join(names, "cluster")
    for side, cols in ((fragments, ("fragment", "place")), (accessory, ("fragment", "place")), (lengths, ("min", "max", "mean"))):
        tag = {id(fragments): "f", id(accessory): "a", id(lengths): "l"}[id(side)] if side is not None else None
        if side is not None:
            t = t.join(side.select("cluster", *[F.col(c).alias(f"_{tag}_{c}") for c in cols]), "cluster", "left")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in t.columns else F.lit("")
    t = t.orderBy(F.desc("isolates"), F.desc("cluster"))
    cell = [F.coalesce(F.col(f"`{g}`"), F.lit("")).alias(str(g)) for g in genomes]
    head = [F.col("name").alias("Gene"), F.lit("").alias("Non-unique Gene name"), F.col("annotation").alias("Annotation")]
    counts = [
        F.col("isolates").alias("No. isolates"), F.col("sequences").alias("No. sequences"), F.round(F.col("sequences") / F.col("isolates"), 2).alias("Avg sequences per isolate"),
        given("_f_fragment").alias("Genome Fragment"), given("_f_place").alias("Order within Fragment"), given("_a_fragment").alias("Accessory Fragment"), given("_a_place").alias("Accessory Order with Fragment"),
        F.lit("").alias("QC"), given("_l_min").alias("Min group size nuc"), given("_l_max").alias("Max group size nuc"), given("_l_mean").alias("Avg group size nuc"),
    ]
    one = t.coalesce(1)
    one.select(*head, *counts, *cell).write.csv(f"{path}/gene_presence_absence_summary.csv", header=True)
    one.select(*head, *cell).write.csv(f"{path}/gene_presence_absence.csv", header=True)
    one.select(F.col("name").alias("Gene"), *[F.when(F.coalesce(F.col(f"`{g}`"), F.lit("")) != "", 1).otherwise(0).alias(str(g)) for g in genomes]).write.csv(f"{path}/gene_presence_absence.Rtab", header=True, sep="\t")


def reference(genes: DataFrame, names: DataFrame, path: str) -> None:
    """The pan-genome's reference: the longest sequence of each cluster (the greatest of equals), once where clusters share it, as FASTA.

    genes: (cluster, dna); names: (cluster, name). The name of the least cluster that has a sequence is given.
    """
    best = genes.groupBy("cluster").agg(F.max_by("dna", F.struct(F.length("dna"), "dna")).alias("seq"))
    once = best.groupBy("seq").agg(F.min("cluster").alias("cluster"))
    fasta(once.join(names, "cluster").select(F.col("name").alias("id"), "seq"), path)


def neighbourhood(paths: DataFrame, path: str) -> None:
    """(path, support, genomes) as a tab-separated table, the most frequent first."""
    paths.orderBy(F.desc("support"), "path").select("support", F.col("genomes").alias("members"), "path").coalesce(1).write.csv(path, header=True, sep="\t")


def parameters(fit: dict, path: str, spark) -> None:
    """Fitted parameters of a model as (parameter, value) rows; a list (an interval, a curve) is a row per entry."""
    rows = [(k, i, float(x)) for k, v in fit.items() for i, x in enumerate(v if isinstance(v, (list, tuple)) else [v])]
    spark.createDataFrame(rows, "parameter string, entry int, value double").coalesce(1).write.csv(path, header=True)


def curve(rows: DataFrame, path: str) -> None:
    """(n_genomes, low, mean, high) as a table in order."""
    rows.orderBy("n_genomes").coalesce(1).write.csv(path, header=True)


def merged_gene_data(parts: list[DataFrame], offsets: list[int], path: str) -> None:
    """The gene tables of several runs as one, and their DNA as FASTA: genome numbers in ids are moved by each run's offset."""
    out = None
    for part, offset in zip(parts, offsets, strict=True):
        moved = part.withColumn("clustering_id", substring_id(F.col("clustering_id"), F.lit(offset)))
        out = moved if out is None else out.unionByName(moved)
    out.write.csv(f"{path}/gene_data.csv", header=True)
    fasta(out.select(F.col("clustering_id").alias("id"), F.col("dna_sequence").alias("seq")), f"{path}/combined_DNA_CDS.fasta")


def safe_name(name: str, most: int = 236) -> str:
    """A file name of a gene: no path signs, no more than so many characters."""
    return "".join("_" if c in '/\\:*?"<>|\0' else c for c in name)[:most]


def gene_files(records: DataFrame, path: str) -> DataFrame:
    """A FASTA folder for each gene of (gene, id, seq) with more than one sequence; returns the genes of one, which need no alignment."""
    n = records.groupBy("gene").agg(F.count("*").alias("n"))
    several = records.join(n.where("n > 1"), "gene", "left_semi")
    name = F.substring(F.regexp_replace("gene", '[/\\\\:*?"<>|]', "_"), 1, 236)
    rows = several.select(name.alias("file"), F.col("gene"), F.col("id").cast("string").alias("id"), F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), "seq").alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "gene", "id").select("file", "value").write.partitionBy("file").text(path)
    return records.join(n.where("n = 1"), "gene", "left_semi")


def alignment_header(lengths: DataFrame, path: str) -> None:
    """Places of genes in their concatenation as a feature table of (gene, length), in order of gene."""
    at = running_offsets(lengths)
    line = F.concat(F.lit("FT   feature         "), (F.col("start") + 1).cast("string"), F.lit(".."), (F.col("start") + F.col("length")).cast("string"), F.lit("\nFT                   /label="), "gene", F.lit("\nFT                   /locus_tag="), "gene")
    total = at.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).select(F.lit("").alias("gene"), F.lit(-1).cast("bigint").alias("start"), F.concat(F.lit("ID   Genome standard; DNA; PRO; "), F.col("n").cast("string"), F.lit(" BP.\nXX\nFH   Key             Location/Qualifiers\nFH")).alias("value"))
    end = total.select(F.lit("").alias("gene"), F.lit((1 << 62)).cast("bigint").alias("start"), F.lit("XX\n//").alias("value"))
    at.select("gene", F.col("start").cast("bigint").alias("start"), line.alias("value")).unionAll(total).unionAll(end).coalesce(1).sortWithinPartitions("start").select("value").write.text(path)


def core_alignment(aligned: DataFrame, genomes: DataFrame, path: str, threshold: float | None = None) -> None:
    """The core alignment of (gene, genome, record, aligned): genes side by side, all and those of little entropy, the header of both,
    and each gene's entropy."""
    from ..operators import align

    per = align.entropy(align.column_counts(aligned))
    per.orderBy("gene").coalesce(1).write.csv(f"{path}/alignment_entropy.csv", header=True)
    for rows, name in ((aligned, "core_gene_alignment"), (aligned.join(align.entropy_filter(per, threshold=threshold), "gene", "left_semi"), "core_gene_alignment_filtered")):
        fasta(align.concatenated(rows, genomes).select(F.col("genome").alias("id"), F.col("aligned").alias("seq")), f"{path}/{name}.aln")
        alignment_header(rows.groupBy("gene").agg(F.max(F.length("aligned")).cast("bigint").alias("length")), f"{path}/{name}.embl")


def variants(sv: DataFrame, genomes: list, path: str) -> None:
    """(centre, a, b, genome) as a 0/1 table of ``a-centre-b``."""
    wide = sv.groupBy(F.concat_ws("-", "a", "centre", "b").alias("Gene")).pivot("genome", genomes).agg(F.count(F.lit(1)))
    wide.select("Gene", *[F.when(F.col(f"`{g}`") > 0, 1).otherwise(0).alias(str(g)) for g in genomes]).coalesce(1).write.csv(path, header=True, sep="\t")


def gml(members: DataFrame, em: DataFrame, path: str, attributes: DataFrame | None = None) -> None:
    """The graph as one GML text; nodes are numbered by name. attributes: (cluster, key, value) as text, more lines of the nodes."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), '"', "&#34;"), F.lit('"'))
    joined = lambda: F.array_join(F.array_sort(F.collect_list(F.col("genome").cast("string"))), ";")
    n = members.groupBy("cluster").agg(F.count("*").alias("size"), joined().alias("members"))
    if attributes is not None:
        line = F.concat(F.lit(" "), F.col("key"), F.lit(" "), quoted("value"))
        n = n.join(attributes.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("more")), "cluster", "left")
    more = F.coalesce("more", F.lit("")) if attributes is not None else F.lit("")
    node = n.select(F.lit(1).alias("o"), F.col("cluster").alias("k"), F.concat(F.lit("  node [ id "), quoted("cluster"), F.lit(" name "), quoted("cluster"), F.lit(" size "), F.col("size").cast("string"), F.lit(" members "), quoted("members"), more, F.lit(" ]")).alias("value"))
    e = em.groupBy("a", "b").agg(F.count("*").alias("size"), joined().alias("members"))
    edge = e.select(F.lit(2).alias("o"), F.concat_ws("\t", "a", "b").alias("k"), F.concat(F.lit("  edge [ source "), quoted("a"), F.lit(" target "), quoted("b"), F.lit(" size "), F.col("size").cast("string"), F.lit(" members "), quoted("members"), F.lit(" ]")).alias("value"))
    ends = members.sparkSession.createDataFrame([(0, "", "graph ["), (3, "", "]")], "o int, k string, value string")
    node.unionAll(edge).unionAll(ends).orderBy("o", "k").coalesce(1).sortWithinPartitions("o", "k").select("value").write.text(path)


def annotations(rows: DataFrame, path: str) -> None:
    """Updated annotation lines (genome, contig, start, end, strand, attributes), a folder per genome, in order."""
    line = F.concat_ws("\t", "contig", F.lit("."), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), "attributes")
    rows.repartition("genome").sortWithinPartitions("genome", "contig", "start").select("genome", line.alias("value")).write.partitionBy("genome").text(path)


def whole_annotations(rows: DataFrame, contigs: DataFrame, path: str) -> None:
    """Updated annotations (as for ``annotations``; found genes are rows like others) with the sequences (genome, contig, seq) after them."""
    line = F.concat_ws("\t", "contig", F.lit("."), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), "attributes")
    notes = rows.select("genome", F.lit(1).alias("o"), F.col("contig").cast("string").alias("c"), F.col("start").cast("bigint").alias("at"), line.alias("value"))
    seqs = contigs.select("genome", F.lit(3).alias("o"), F.col("contig").cast("string").alias("c"), F.lit(0).cast("bigint").alias("at"), F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), "seq").alias("value"))
    marks = contigs.select("genome").distinct().select("genome", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("##gff-version 3").alias("v")), F.struct(F.lit(2).alias("o"), F.lit("##FASTA").alias("v")))).alias("m")).select("genome", "m.o", F.lit("").alias("c"), F.lit(0).cast("bigint").alias("at"), F.col("m.v").alias("value"))
    every = notes.unionAll(seqs).unionAll(marks)
    every.repartition("genome").sortWithinPartitions("genome", "o", "c", "at").select("genome", "value").write.partitionBy("genome").text(path)


def pairs(rows: DataFrame, path: str) -> None:
    """Associations, strongest first."""
    rows.orderBy(F.desc("mi"), "a", "b").write.csv(path, header=True)


# alignment runs that can go on


MANIFEST = ("alignment", "aligner", "codons", "core_threshold", "subset")


def write_manifest(folder: str, settings: dict, resume: bool) -> None:
    """Notes a run's settings; an existing note stops a new run, and a resumed one unless they agree."""
    path = os.path.join(folder, "alignment_manifest.json")
    if os.path.exists(path):
        if not resume:
            raise FileExistsError(path)
        with open(path) as f:
            old = json.load(f)
        if any(old.get(k) != settings.get(k) for k in MANIFEST):
            raise ValueError("the run to resume had other settings")
        return
    with open(path, "w") as f:
        json.dump({k: settings.get(k) for k in MANIFEST}, f)


def pending(genes: DataFrame, done: DataFrame) -> DataFrame:
    """Genes without a finished alignment."""
    return genes.join(done.select("gene"), "gene", "left_anti")
