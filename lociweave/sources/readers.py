"""Readers of annotation, sequence, graph, matrix and cluster files. Files are read by Spark, a file or a line a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dna import code
from ..functions.kernels import reverse_complement
from .stage import prepared

FEATURES = "path string, seqid string, type string, start bigint, end bigint, strand string, frame string, attributes map<string,string>, ord bigint"
CONTIGS = "path string, contig string, ord bigint, seq string"
GENE_DATA = "gff_file string, scaffold_name string, clustering_id string, annotation_id string, prot_sequence string, dna_sequence string, gene_name string, description string"


def whole(spark: SparkSession, paths) -> DataFrame:
    """(path, text): a file a row."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parse_fasta(text: str) -> list[tuple[str, str]]:
    """(id, sequence) pairs; lines before the first header are skipped."""
    out = []
    for part in re.split(r"(?m)^>", text)[1:]:
        head, _, body = part.partition("\n")
        out.append((head.split()[0] if head.split() else "", re.sub(r"\s", "", body)))
    return out


def parse_gff(text: str) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Features and contigs of an annotation with its sequences; there must be one sequence part."""
    text = "\n".join(x for x in text.replace(",", "").splitlines() if "##sequence-region" not in x)
    parts = text.split("##FASTA")
    if len(parts) != 2:
        raise ValueError("an annotation needs exactly one ##FASTA part")
    features = []
    for i, line in enumerate(parts[0].splitlines()):
        c = line.split("\t")
        if line.startswith("#") or len(c) != 9:
            continue
        attributes = dict(x.split("=", 1) for x in c[8].strip(";").split(";") if "=" in x)
        features.append((c[0], c[2], int(c[3]), int(c[4]), c[6], c[7], attributes, i))
    return features, [(a.removeprefix("accn|"), s) for a, s in parse_fasta(parts[1])]


def _parsed(files: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """Features and contigs of (path, text), by a parser of one text."""
    prepared(files.sparkSession)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *f) for p, t in zip(b["path"], b["text"], strict=True) for f in parse(t)[0]], columns=["path", "seqid", "type", "start", "end", "strand", "frame", "attributes", "ord"])

    def contigs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, c, i, s) for p, t in zip(b["path"], b["text"], strict=True) for i, (c, s) in enumerate(parse(t)[1])], columns=["path", "contig", "ord", "seq"])

    return files.mapInPandas(features, FEATURES), files.mapInPandas(contigs, CONTIGS)


def gff(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Features and contigs of annotation files with sequences at the end."""
    return _parsed(whole(spark, paths), parse_gff)


def genbank(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Features and contigs of GenBank files."""
    return _parsed(whole(spark, paths), parse_genbank)


def gff_with_fasta(spark: SparkSession, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Features and contigs of annotations whose sequences are in files of their own: (annotation, sequences) paths."""
    for a, b in pairs:
        if not a.endswith((".gff", ".gff3")) or not b.endswith((".fasta", ".fa", ".fna", ".fas")):
            raise ValueError(f"not an annotation and its sequences: {a} {b}")
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    if len({name(a) for a, _ in pairs}) < len(pairs) or len({name(b) for _, b in pairs}) < len(pairs):
        raise ValueError("files of one name")
    of = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a string, b string")  # a row per genome
    last = F.regexp_extract("path", "([^/]+)$", 1)
    notes = whole(spark, [a for a, _ in pairs]).withColumn("a", last)
    seqs = whole(spark, [b for _, b in pairs]).select(last.alias("b"), F.col("text").alias("seqs"))
    files = notes.join(of, "a").join(seqs, "b").select("path", F.concat(F.regexp_replace("text", "(?s)##FASTA.*", ""), F.lit("\n##FASTA\n"), "seqs").alias("text"))
    return _parsed(files, parse_gff)


def gene_calls(features: DataFrame, contigs: DataFrame, genomes: DataFrame, strict: bool = False, table: int = 11) -> DataFrame:
    """Genes of coding features, numbered by contig and place: (genome, contig_ix, gene_ix, ...) with DNA and protein.

    A feature is invalid if its frame isn't 0, its length is no multiple of 3 or under 34, or it stops before its last
    codon; a contig may be missing. strict: such a feature fails the job; else it is left out. genomes: (path, genome).
    """
    codons, starts = code(table)

    def genes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.seq is None:
                    if strict:
                        raise ValueError(f"no contig {r.seqid}")
                    continue
                dna = r.seq[r.start - 1 : r.end]
                dna = reverse_complement(dna) if r.strand == "-" else dna
                acids = "".join(codons.get(re.sub("[^ACGT]", "N", dna[i : i + 3].upper()), "X") for i in range(0, len(dna) - 2, 3))
                if r.frame != "0" or len(dna) % 3 or len(dna) < 34 or "*" in acids[:-1]:
                    if strict:
                        raise ValueError(f"invalid gene {r.seqid}:{r.start}-{r.end}")
                    continue
                protein = ("M" + acids[1:] if dna[:3] in starts else acids).removesuffix("*")
                a = dict(r.attributes or [])
                out.append((r.genome, r.path, r.seqid, r.ord, r.start, r.end, r.strand, a.get("ID", ""), a.get("gene", a.get("name", "")), a.get("product", ""), dna, protein))
            yield pd.DataFrame(out, columns=["genome", "path", "contig", "ord", "start", "end", "strand", "annotation_id", "gene_name", "description", "dna", "protein"])

    prepared(features.sparkSession)
    rows = features.where(F.col("type").contains("CDS")).join(contigs.select("path", F.col("contig").alias("seqid"), "seq"), ["path", "seqid"], "left").join(genomes, "path")
    rows = rows.mapInPandas(genes, "genome int, path string, contig string, ord bigint, start bigint, end bigint, strand string, annotation_id string, gene_name string, description string, dna string, protein string")
    first = rows.groupBy("genome", "contig").agg(F.min("ord").alias("first")).withColumn("contig_ix", F.row_number().over(Window.partitionBy("genome").orderBy("first")) - 1).drop("first")
    rows = rows.join(first, ["genome", "contig"]).withColumn("gene_ix", F.row_number().over(Window.partitionBy("genome", "contig").orderBy("start", "ord")) - 1)
    return rows.withColumn("clustering_id", F.concat_ws("_", "genome", "contig_ix", "gene_ix"))


def parse_genbank(text: str) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Features and contigs of GenBank records: genes and coding, transfer and messenger parts, with phases of joined parts."""
    features, contigs = [], []
    for record in re.split(r"(?m)^//\s*$", text):
        name = re.search(r"(?m)^LOCUS\s+(\S+)", record)
        if not name:
            continue
        origin = re.search(r"(?ms)^ORIGIN(.*)", record)
        contigs.append((name[1], re.sub(r"[^A-Za-z]", "", origin[1]).upper() if origin else ""))
        table = re.search(r"(?ms)^FEATURES[^\n]*\n(.*?)^(?:ORIGIN|CONTIG)", record)
        for i, m in enumerate(re.finditer(r"(?m)^     (\S+)\s+(\S+(?:\n {21}(?!/)\S+)*)((?:\n {21}.*)*)", table[1] if table else "")):
            kind, where, notes = m[1], re.sub(r"\s", "", m[2]), m[3]
            if kind not in ("gene", "mRNA", "tRNA", "rRNA", "CDS"):
                continue
            a = {k: re.sub(r"\s+", " ", v.strip('"')) for k, v in re.findall(r'/(\w+)=("[^"]*"|\S+)', notes)}
            strand = "-" if "complement" in where else "+"
            parts = [(int(x), int(y or x)) for x, y in re.findall(r"<?(\d+)(?:\.\.>?(\d+))?", where)]
            phase = int(a.get("codon_start", 1)) - 1
            for s, e in parts if strand == "+" else parts[::-1]:
                features.append((name[1], kind, s, e, strand, str(phase) if kind == "CDS" else ".", {"ID": a.get("locus_tag", f"{name[1]}_{i}"), **{k: a[k] for k in ("gene", "product") if k in a}}, i))
                phase = (phase - (e - s + 1)) % 3
    return features, contigs


def fasta(spark: SparkSession, paths) -> DataFrame:
    """(id, seq) of FASTA files, split at record starts by the reader."""
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("v")).where("v <> ''")
    head = F.substring_index("v", "\n", 1)
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "").alias("seq"))


def gene_data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENE_DATA).csv(path, header=True)


def presence_table(spark: SparkSession, path: str, drop_core: bool = False, least: int = 1) -> DataFrame:
    """(cluster, genome) of a 0/1 table with a column per genome; optionally without genes of all or of few genomes."""
    wide = spark.read.csv(path, sep="\t", header=True)
    genomes = wide.columns[1:]
    long = wide.unpivot(wide.columns[0], genomes, "genome", "v").where("v = '1'").select(F.col(wide.columns[0]).alias("cluster"), "genome")
    n = long.groupBy("cluster").count().where((F.col("count") >= least) & (F.col("count") < len(genomes) + (0 if drop_core else 1)))
    return long.join(n.select("cluster"), "cluster", "left_semi")


def cells_table(spark: SparkSession, path: str, metadata: int = 3) -> DataFrame:
    """(cluster, genome, cell) of a comma-separated table with so many leading metadata columns; empty cells are left out."""
    wide = spark.read.csv(path, header=True)
    return wide.unpivot(wide.columns[0], wide.columns[metadata:], "genome", "cell").where("cell is not null and cell <> ''").select(F.col(wide.columns[0]).alias("cluster"), "genome", "cell")


def sample_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sample string, cluster string").csv(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(genome, field, value) of a tab-separated table whose first column names genomes."""
    wide = spark.read.csv(path, sep="\t", header=True)
    return wide.unpivot(wide.columns[0], wide.columns[1:], "field", "value").select(F.col(wide.columns[0]).alias("genome"), "field", "value")


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, seq_id, is_centroid) of a file of ``>Cluster`` blocks, read a block a row."""
    blocks = spark.read.option("lineSep", ">Cluster ").text(path).where("trim(value) <> ''")
    lines = blocks.select(F.regexp_extract("value", r"^(\d+)", 1).cast("int").alias("cluster_id"), F.explode(F.split("value", "\n")).alias("l")).where(F.col("l").contains(">"))
    return lines.select("cluster_id", F.regexp_extract("l", r">(.*?)\.\.\.", 1).alias("seq_id"), F.col("l").endswith("*").alias("is_centroid"))


def parse_gml(text: str) -> dict[str, list[dict]]:
    """Nodes, edges and graph values of a GML text; a repeated key becomes a list."""
    tokens = re.findall(r'"[^"]*"|\[|\]|[^\s\[\]"]+', text)

    def value(i: int):
        if tokens[i] != "[":
            t = tokens[i]
            return (t[1:-1].replace("&#34;", '"').replace("&quot;", '"').replace("&amp;", "&") if t[0] == '"' else float(t) if re.search(r"[.eE]", t) else int(t) if re.fullmatch(r"-?\d+", t) else t), i + 1
        out: dict = {}
        i += 1
        while tokens[i] != "]":
            k = tokens[i]
            v, i = value(i + 1)
            if k in out:
                out[k] = [*(out[k] if isinstance(out[k], list) else [out[k]]), v]
            else:
                out[k] = v
        return out, i + 1

    g = value(tokens.index("graph") + 1)[0]
    as_list = lambda x: x if isinstance(x, list) else [x]
    return {"node": as_list(g.pop("node", [])), "edge": as_list(g.pop("edge", [])), "graph": [g]}


def gml(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, cluster, genome), (graph, a, b, genome) and node attributes as text, of graph files; genomes are numbered on from graph to graph."""
    prepared(spark)
    many = lambda v: v if isinstance(v, list) else str(v).split(";")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, str(n["id"]), int(m)) for p, t in zip(b["path"], b["text"], strict=True) for n in parse_gml(t)["node"] for m in many(n["members"])], columns=["graph", "cluster", "genome"])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *sorted((str(e["source"]), str(e["target"]))), int(m)) for p, t in zip(b["path"], b["text"], strict=True) for e in parse_gml(t)["edge"] for m in many(e["members"])], columns=["graph", "a", "b", "genome"])

    def attributes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, str(n["id"]), {k: ";".join(map(str, many(v))) for k, v in n.items() if k != "id"}) for p, t in zip(b["path"], b["text"], strict=True) for n in parse_gml(t)["node"]], columns=["graph", "cluster", "attributes"])

    w = whole(spark, paths)
    m = w.mapInPandas(members, "graph string, cluster string, genome int")
    e = w.mapInPandas(edges, "graph string, a string, b string, genome int")
    n = m.groupBy("graph").agg((F.max("genome") + 1).alias("n"))
    offset = n.select("graph", F.coalesce(F.sum("n").over(Window.orderBy("graph").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("o"))  # a row per graph
    shift = lambda d: d.join(F.broadcast(offset), "graph").withColumn("genome", F.col("genome") + F.col("o")).drop("o")
    return shift(m), shift(e), w.mapInPandas(attributes, "graph string, cluster string, attributes map<string,string>")


def input_list(lines: list[str]) -> list[str | tuple[str, str]]:
    """Inputs of a run: a path, or an annotation and its sequences, to a line."""
    out = []
    for x in lines:
        p = x.split()
        if len(p) > 2:
            raise ValueError(f"too many paths in a line: {x}")
        if p:
            out.append((p[0], p[1]) if len(p) == 2 else p[0])
    return out
