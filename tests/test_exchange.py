import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociweave.functions import dna, kernels
from lociweave.operators import cluster, correct, graph, matrix, query, simulate, stats
from lociweave.plans import pangenome
from lociweave.sources import convert, readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()))


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.rglob("part-*")))


def test_simulated_genomes_have_the_shape_asked_for():
    made = simulate.pangenome(6, 10, 4.0, 1.0, 0.05, seed=3)
    per = Counter(g for _, _, g, _ in made.genes)
    assert sum(n == 6 for g, n in per.items() if g.startswith("core")) == 10 and any(n < 6 for n in per.values())
    table, _ = dna.code(11)
    for _, _, _, s in made.genes:
        assert s.startswith("ATG") and s.endswith("TAA") and "*" not in "".join(table[s[i : i + 3]] for i in range(0, len(s) - 3, 3))
    assert made.genes == simulate.pangenome(6, 10, 4.0, 1.0, 0.05, seed=3).genes
    parents = {n: (p, x) for n, p, x in made.tree}
    assert len(parents) == 11 and all(x >= 0 for _, x in parents.values())


def test_run_gives_the_simulated_genes(spark, tmp_path):
    made = simulate.pangenome(4, 6, 2.0, 1.0, 0.01, seed=7)
    for g in range(4):
        own = [(i, name, s) for n, i, name, s in made.genes if n == g]
        (tmp_path / f"g{g}.gff").write_text(simulate.annotation_text(own, f"c{g}"))
    run = pangenome.run(spark, [str(tmp_path / f"g{g}.gff") for g in range(4)], "sensitive")
    want = Counter(len({n for n, _, x, _ in made.genes if x == name}) for name in {x for _, _, x, _ in made.genes})
    assert {r.k: r.genes for r in matrix.spectrum(run.members).collect()} == dict(want)


def test_injectors(spark):
    r = random.Random(2)
    genes = [(g, f"x{i}", simulate.random_gene(r, 50)) for g in range(3) for i in range(20)]
    d = spark.createDataFrame(genes, "genome int, gene string, dna string")
    got = {(a, b): s for a, b, s in rows(simulate.with_diversity(d, 0.2))}
    table, _ = dna.code(11)
    diff = sum(s[i : i + 3] != got[g, x][i : i + 3] for g, x, s in genes for i in range(0, len(s), 3))
    assert 300 < diff < 900 and all(len(got[g, x]) == len(s) and got[g, x][:3] == "ATG" and got[g, x][-3:] == "TAA" for g, x, s in genes)
    assert rows(simulate.with_diversity(d, 0.0)) == sorted(genes) and all("*" not in "".join(table[s[i : i + 3]] for i in range(0, len(s) - 3, 3)) for s in got.values())
    c = spark.createDataFrame([(g, "c", "".join(r.choices("ACGT", k=5000))) for g in range(40)], "genome int, contig string, seq string")
    more = simulate.contaminated(c, spark.createDataFrame([("f", "ACGT")], "contig string, seq string"), 0.5)
    assert 5 < more.where("contig = 'foreign_f'").count() < 35 and more.where("contig = 'c'").count() == 40
    parts = {}
    for g, k, s in simulate.fragmented(c, 500).collect():
        parts.setdefault(g, {})[int(k.split("_")[1])] = s
    assert all("".join(parts[g][i] for i in sorted(parts[g])) == s for g, _, s in c.collect()) and 3 < sum(map(len, parts.values())) / 40 < 20
    assert all(len(s) >= 300 for _, _, s in simulate.fragmented(c, 500, 300).collect())


def test_converters():
    notes = "##x\nc1\tr\tgene\t1\t9\t.\t+\t0\tID=g\nc1\tr\tCDS\t1\t9\t.\t+\t0\tID=a;product=p\nc1\tr\tCDS\t7\t15\t.\t+\t0\tID=a\nc1\tr\tCDS\t16\t20\t.\t+\t0\tID=odd\nc9\tr\tCDS\t1\t9\t.\t+\t0\tID=z\n"
    seqs = ">c1 some\n" + "ACGT" * 6 + "\n"
    features, contigs = readers.parse_gff(convert.from_refseq(notes, seqs))
    assert [f[6]["ID"] for f in features] == ["a", "a_2"] and contigs == [("c1", "ACGT" * 6)]
    assert [f[6]["ID"] for f in readers.parse_gff(convert.from_refseq(notes, seqs, True))[0]] == ["a"]
    assert len(readers.parse_gff(convert.from_gene_caller(notes, seqs))[0]) == 5


def test_readers_of_pairs_and_genbank(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff-version 3\nc1\tr\tCDS\t1\t9\t.\t+\t0\tID=a\n")
    (tmp_path / "a.fna").write_text(">accn|c1\nACGTACGTACGT\n")
    f, c = readers.gff_with_fasta(spark, [(f"{tmp_path}/a.gff", f"{tmp_path}/a.fna")])
    assert [r.seqid for r in f.collect()] == ["c1"] and [(r.contig, r.seq) for r in c.collect()] == [("c1", "ACGTACGTACGT")]
    with pytest.raises(ValueError):
        readers.gff_with_fasta(spark, [("a.txt", "b.fna")])
    (tmp_path / "b.gbk").write_text('LOCUS       c2 12 bp\nFEATURES             Location/Qualifiers\n     CDS             complement(1..9)\n                     /locus_tag="t1"\n                     /gene="x"\nORIGIN\n        1 acgtacgtac gt\n//\n')
    f, c = readers.genbank(spark, f"{tmp_path}/b.gbk")
    r = f.first()
    assert (r.seqid, r.start, r.end, r.strand, r.attributes["ID"], c.first().seq) == ("c2", 1, 9, "-", "t1", "ACGTACGTACGT")
    both = pangenome.read_inputs(spark, [f"{tmp_path}/b.gbk", (f"{tmp_path}/a.gff", f"{tmp_path}/a.fna")])
    assert both[0].count() == 2 and both[1].count() == 2


def test_writers_round_trip(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "b"), (1, 0, 0, "a"), (1, 0, 1, "c")], "genome int, contig int, ix int, cluster string")
    m, em = matrix.presence(g), graph.edge_members(g)
    names = m.select("cluster", F.col("cluster").alias("name"), F.lit("x").alias("annotation")).distinct()
    order = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], "cluster string, fragment int, place int")
    lengths = spark.createDataFrame([("a", 30, 33, 31.5)], "cluster string, min int, max int, mean double")
    sinks.presence_absence(matrix.cells(g), names, [0, 1], str(tmp_path / "pa"), order, order.where("cluster <> 'a'"), lengths)
    wide = spark.read.csv(f"{tmp_path}/pa/gene_presence_absence_summary.csv", header=True)
    assert wide.columns[:14] == ["Gene", "Non-unique Gene name", "Annotation", "No. isolates", "No. sequences", "Avg sequences per isolate", "Genome Fragment", "Order within Fragment", "Accessory Fragment", "Accessory Order with Fragment", "QC", "Min group size nuc", "Max group size nuc", "Avg group size nuc"] and wide.columns[14:] == ["0", "1"]
    assert [tuple(r)[6:14] for r in wide.where("Gene = 'a'").collect()] == [("1", "1", None, None, None, "30", "33", "31.5")]
    sinks.gml(m, em, f"{tmp_path}/g.gml", spark.createDataFrame([("a", "annotation", 'say "x" & y')], "cluster string, key string, value string"))
    m2, e2, notes = readers.gml(spark, f"{tmp_path}/g.gml")
    assert {(c, n) for _, c, n in rows(m2)} == set(rows(m)) and len(rows(e2)) == len(rows(em))
    assert {r.cluster: r.attributes.get("annotation") for r in notes.collect()}["a"] == 'say "x" & y'
    seqs = spark.createDataFrame([("a", "ACGTAC"), ("a", "ACG"), ("b", "ACGTAC"), ("c", "TTT")], "cluster string, dna string")
    sinks.reference(seqs, names, f"{tmp_path}/ref")
    assert rows(readers.fasta(spark, f"{tmp_path}/ref")) == [("a", "ACGTAC"), ("c", "TTT")]
    lines = spark.createDataFrame([(0, "c1", 5, 9, "+", "ID=x"), (0, "c1", 1, 3, "+", "ID=w"), (1, "c1", 1, 3, "-", "ID=y")], "genome int, contig string, start int, end int, strand string, attributes string")
    contigs = spark.createDataFrame([(0, "c1", "ACGTACGTACGT"), (1, "c1", "TTTTT")], "genome int, contig string, seq string")
    sinks.whole_annotations(lines, contigs, f"{tmp_path}/gff")
    features, found = readers.parse_gff(text_of(tmp_path / "gff" / "genome=0"))
    assert [f[6]["ID"] for f in features] == ["w", "x"] and found == [("c1", "ACGTACGTACGT")]
    data = spark.createDataFrame([("f", "c", "0_0_1", "a1", "M", "ATG", "g", "d")], readers.GENE_DATA)
    sinks.merged_gene_data([data, data], [0, 3], f"{tmp_path}/merged")
    assert sorted(r.clustering_id for r in readers.gene_data(spark, f"{tmp_path}/merged/gene_data.csv").collect()) == ["0_0_1", "3_0_1"]
    assert rows(readers.fasta(spark, f"{tmp_path}/merged/combined_DNA_CDS.fasta")) == [("0_0_1", "ATG"), ("3_0_1", "ATG")]
    sinks.parameters({"theta": 1.5, "ci": [1.0, 2.0]}, f"{tmp_path}/par", spark)
    assert rows(spark.read.csv(f"{tmp_path}/par", header=True)) == [("ci", "0", "1.0"), ("ci", "1", "2.0"), ("theta", "0", "1.5")]
    sinks.neighbourhood(query.neighbourhoods(em, "a", 1), f"{tmp_path}/near")
    assert spark.read.csv(f"{tmp_path}/near", header=True, sep="\t").count() == 2


def test_core_alignment_files(spark, tmp_path):
    a = spark.createDataFrame([("g", 0, 1, "ACGT"), ("g", 1, 2, "ACGA"), ("h", 0, 3, "TT")], "gene string, genome int, record int, aligned string")
    sinks.core_alignment(a, spark.createDataFrame([(0,), (1,)], "genome int"), str(tmp_path), 10.0)
    assert rows(readers.fasta(spark, f"{tmp_path}/core_gene_alignment.aln")) == [("0", "ACGTTT"), ("1", "ACGA--")] == rows(readers.fasta(spark, f"{tmp_path}/core_gene_alignment_filtered.aln"))
    head = text_of(tmp_path / "core_gene_alignment.embl")
    assert head.startswith("ID   Genome standard; DNA; PRO; 6 BP.") and "1..4\n" in head and "5..6\n" in head and head.rstrip().endswith("//")
    one = sinks.gene_files(spark.createDataFrame([("a/b", 1, "AC"), ("a/b", 2, "AG"), ("c", 3, "TT")], "gene string, id int, seq string"), f"{tmp_path}/genes")
    assert [r.gene for r in one.collect()] == ["c"] and ">1\nAC\n>2\nAG\n" in text_of(tmp_path / "genes" / "file=a_b")
    assert sinks.safe_name("a/b:" + "x" * 300) == "a_b_" + "x" * 232


def test_small_operators(spark):
    hits = spark.createDataFrame([("x", "r1", 5), ("y", "r1", 2), ("y", "r2", 1)], "genome string, ref string, shared long")
    assert rows(cluster.hit_prevalence(hits)) == [("r1", 2, 7), ("r2", 1, 1)]
    assert rows(cluster.outgroup(hits.withColumnRenamed("shared", "hits"))) == [("y", 3)]
    m = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 1)], "cluster string, genome int")
    got = stats.permuted_curves(m, 4).collect()
    assert all(r.pan == 2 for r in got if r.n_genomes == 3) and all(1 <= r.core <= r.pan <= 2 for r in got) and len(got) == 12
    comp = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x")], "cluster string, component string")
    sup = spark.createDataFrame([("a", 1), ("b", 5), ("x", 9)], "cluster string, support int")
    assert rows(graph.ordered_components(comp, sup)) == [("a", 1, 2), ("b", 1, 1), ("x", 2, 1)]
    spans = spark.createDataFrame([(0, "c", 2, 5, -1), (1, "c", 1, 3, 1)], "genome int, contig string, start int, end int, strand int")
    contigs = spark.createDataFrame([(0, "c", "AACCGG"), (1, "c", "TTTAAA")], "genome int, contig string, seq string")
    assert rows(query.region_sequences(spans, contigs)) == [(0, "c", kernels.reverse_complement("ACCG")), (1, "c", "TTT")]
    g = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "c")], "clustering_id string, annotation_id string")
    assert rows(query.merged_genes(g, spark.createDataFrame([("1",)], "clustering_id string"))) == [("1", "a")]
    p = spark.createDataFrame([("MK*", "ATGAAATAA"), ("MK", "ATGNNA"), ("MR", "ATGAAA")], "p string, d string")
    assert [r[0] for r in p.select(dna.rejected_for_codons(F.col("p"), F.col("d"))).collect()] == [False, True, True]
    assert [r[0] for r in p.select(dna.marked_id(F.lit("s"), F.col("p") == "MK", F.col("p").contains("*"))).collect()] == ["s_pseudo", "s_len", "s"]
    with pytest.raises(Exception, match="stop within"):
        spark.createDataFrame([("M*K",)], "p string").select(dna.checked_protein("p")).collect()
    assert correct.drop_by_consensus(m, spark.createDataFrame([("b", 0), ("b", 2)], "cluster string, genome int")).collect()[0][0] == "b"
