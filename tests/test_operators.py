import duckdb
import os
import random

import pytest
from pyspark.sql import functions as F

from lociweave.functions import dna
from lociweave.functions.kernels import reverse_complement
from lociweave.operators import align, cluster, correct, graph, matrix, query, stats
from lociweave.plans import catalogue, pangenome
from lociweave.sources import readers, sinks
from lociweave.sources.stage import written
from lociweave.streaming import ingest

GENES = "genome int, contig int, ix int, cluster string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def genes(spark, contigs):
    """contigs: (genome, string of one-letter clusters)."""
    return spark.createDataFrame([(g, i, j, c) for i, (g, s) in enumerate(contigs) for j, c in enumerate(s)], GENES)


FAST = list(catalogue.oracle_sql())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    k = sorted(want.columns)
    assert k == sorted(got.columns)
    a, b = (x[k].astype(str).sort_values(k).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_identical_genomes_are_all_core(spark):
    g = genes(spark, [(i, "abcdef") for i in range(3)])
    m = matrix.presence(g)
    assert matrix.summary(m).first().asDict() == {"core": 6, "soft_core": 0, "shell": 0, "cloud": 0, "total": 6}
    assert m.count() == 18


def test_mutual_information_of_a_known_matrix(spark):
    table = [(1, 1, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (0, 0, 0, 1, 1, 1), (1, 1, 1, 1, 1, 0)]
    m = spark.createDataFrame([("abcd"[i], j) for i, r in enumerate(table) for j, v in enumerate(r) if v], "cluster string, genome int")
    got = {(a, b): mi for a, b, mi in rows(stats.mutual_information(m))}
    for p, v in {("a", "b"): 0.31637702, ("a", "c"): 0.31637702, ("b", "c"): 0.31637702, ("a", "d"): 0.04316844, ("b", "d"): 0.04316844, ("c", "d"): 0.04316844}.items():
        assert got[p] == pytest.approx(v, abs=1e-7)


def test_trim_stops_and_is_idempotent(spark):
    g = genes(spark, [(0, "abcd"), (1, "abce"), (2, "abcfgh"), (0, "ca"), (1, "ca")])
    m, e = matrix.support(matrix.presence(g)), graph.edges(graph.edge_members(g))
    nodes, left = graph.trim(m, e, 2, 100, written)
    assert {r[0] for r in rows(nodes)} == set("abc")
    assert rows(graph.trim(nodes, left, 2, 100, written)[0]) == rows(nodes)


def test_delete_and_remove_bridge(spark):
    g = genes(spark, [(0, "axb"), (1, "axb"), (1, "cxd")])
    m, e = matrix.presence(g), graph.edge_members(g)
    dead = spark.createDataFrame([("x",)], "cluster string")
    assert ("a", "b", 0) in rows(graph.delete_nodes(m, e, dead)[1])
    pairs = spark.createDataFrame([("x", 0)], "cluster string, genome int")
    m2, e2 = graph.remove_members(m, e, pairs)
    assert ("x", 0) not in rows(m2) and ("a", "b", 0) in rows(e2) and ("a", "x", 1) in rows(e2)


def test_structural_variants_by_either_way(spark, monkeypatch):
    r = random.Random(6)
    g = genes(spark, [(n % 9, "".join(r.choice("abcdefghijklmnop") + ("h" if r.random() < 0.5 else "") for _ in range(6))) for n in range(200)])
    em = graph.edge_members(g)
    have = {}
    for a, b, n in rows(em):
        have.setdefault((a, b), set()).add(n)
    near = {}
    for (a, b), n in have.items():
        near.setdefault(a, {})[b] = n
        near.setdefault(b, {})[a] = n
    for least in (2, 5):
        want = sorted((c, x, y, len(near[c][x] & near[c][y])) for c in near if len(near[c]) >= 3 for x in near[c] for y in near[c] if x < y and len(near[c][x]) >= least and len(near[c][y]) >= least and len(near[c][x] & near[c][y]) >= least)
        assert rows(graph.structural_variants(em, least)) == want
        monkeypatch.setattr(graph, "PAIRED", 3)
        assert rows(graph.structural_variants(em, least)) == want
    lone = spark.createDataFrame([("a", "h", 1), ("b", "h", 2), ("c", "h", 3), ("d", "h", 1)], "a string, b string, genome int")
    assert rows(graph.structural_variants(lone, 1)) == [("h", "a", "d", 1)]


def test_contract_unites_and_checks(spark):
    g = genes(spark, [(0, "ab"), (1, "cb")])
    into = spark.createDataFrame([("c", "a")], "old string, new string")
    m, e = graph.contract(matrix.presence(g), graph.edge_members(g), into, True)
    assert rows(m) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)] and rows(e) == [("a", "b", 0), ("a", "b", 1)]
    clash = spark.createDataFrame([("b", "a")], "old string, new string")
    with pytest.raises(Exception, match="share a genome"):
        rows(graph.contract(matrix.presence(g), graph.edge_members(g), clash, True)[0])


def test_paralogs_never_share_a_bucket_and_genome(spark):
    g = genes(spark, [(0, "apbcpd"), (1, "apbcpd"), (2, "apb"), (2, "cpd")])
    got = rows(correct.collapse_paralogs(g))
    assert len({(b, ge) for _, ge, _, b in got}) == len(got) == 6
    by = {}
    for _, ge, node, b in got:
        by.setdefault(b, set()).add(ge)
    assert sorted(map(len, by.values())) == [3, 3]


def test_families_merge_without_conflict(spark):
    g = genes(spark, [(0, "axbc"), (1, "aybc"), (2, "axbd"), (0, "cb"), (1, "ca")])
    sim = spark.createDataFrame([("x", "y")], "a string, b string")
    m, em, names = correct.collapse_families(matrix.presence(g), graph.edge_members(g), sim)
    assert dict(rows(names))["y"] == "x" and len([1 for c, _ in rows(m) if c == "x"]) == 3
    both = genes(spark, [(0, "axbyc"), (1, "aybc"), (1, "ba"), (1, "bc")])
    assert dict(rows(correct.collapse_families(matrix.presence(both), graph.edge_members(both), sim)[2]))["y"] == "y"


def test_short_words_are_one_edit_apart_too(spark):
    words = ["a", "b", "an", "ant", "aunt", "tree", "trees", "zzz"]
    got = rows(correct.one_edit_apart(spark.createDataFrame([(w,) for w in words], "cluster string")))
    assert got == [("a", "an"), ("a", "b"), ("an", "ant"), ("ant", "aunt"), ("tree", "trees")]


def test_find_missing_finds_a_dropped_gene(spark):
    r = random.Random(5)
    seq = {g: "".join(r.choices("ACGT", k=60)) for g in "abc"}
    contig = "".join(seq[g] + "".join(r.choices("ACGT", k=20)) for g in "abc")
    where = {g: contig.index(seq[g]) + 1 for g in "abc"}
    located = spark.createDataFrame([(g, n, 0, where[g], where[g] + 59, 1, seq[g]) for n in (0, 1) for g in "abc" if (n, g) != (1, "b")], "cluster string, genome int, contig int, start bigint, end bigint, strand int, dna string")
    calls = genes(spark, [(0, "abc"), (1, "ac")])
    contigs = spark.createDataFrame([(n, 0, contig) for n in (0, 1)], "genome int, contig int, seq string")
    found, lost = correct.find_missing(matrix.presence(calls), graph.edge_members(calls), located, contigs)
    assert rows(found) == [("b", 1, 0, where["b"], where["b"] + 59, 1, seq["b"])] and rows(lost) == []
    # a cluster of one genome whose gene lies on that of a larger cluster loses it
    over = located.unionAll(spark.createDataFrame([("z", 1, 0, where["a"] + 5, where["a"] + 50, 1, contig[where["a"] + 4 : where["a"] + 50])], located.schema))
    calls = genes(spark, [(0, "abc"), (1, "azc")])
    found, lost = correct.find_missing(matrix.presence(calls), graph.edge_members(calls), over, contigs)
    assert [x[:2] for x in rows(found)] == [("b", 1)] and rows(lost) == [("z", 1)]


def test_neighbourhood_and_regions(spark):
    g = genes(spark, [(0, "abcde"), (1, "abcde"), (2, "edcxy")])
    got = rows(query.neighbourhoods(graph.edge_members(g), "c", 2))
    assert sum(r[1] for r in got) == 3 and max(r[1] for r in got) == 2
    loc = spark.createDataFrame([("a", 0, 0, 10, 20, 1), ("b", 0, 0, 30, 40, 1)], "cluster string, genome int, contig int, start int, end int, strand int")
    assert rows(query.regions(loc, "a", "b", 15)) == [(0, 0, 1, 55, 1)]


def test_greedy_equals_sequential(spark):
    r = random.Random(3)
    base = ["".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=60)) for _ in range(4)]
    seqs = []
    for i in range(24):
        s = list(base[i % 4])
        for _ in range(r.randint(0, 6)):
            s[r.randrange(len(s))] = r.choice("ACDEFGHIKLMNPQRSTVWY")
        seqs.append((i, "".join(s)))
    from lociweave.functions.kernels import infix_identity

    reps, want = [], {}
    for i, s in sorted(seqs, key=lambda x: (-len(x[1]), x[0])):
        near = [(infix_identity(t, s), -j) for j, t in reps]
        best = max((x for x in near if x[0] >= 0.9), default=None)
        if best is None:
            reps.append((i, s))
    for i, s in seqs:
        want[i] = i if i in dict(reps) else max((infix_identity(t, s), -j) for j, t in reps if j < i)[1] * -1
    got = dict(rows(cluster.greedy(spark.createDataFrame(seqs, "id int, seq string"), 0.9, 0.0, 5)))
    assert got == want


def test_dna_pairs_at_the_limit_of_identity_meet_on_both_strands(spark):
    from lociweave.functions.kernels import infix_identity

    r = random.Random(4)
    seqs = {}
    for i in range(0, 60, 3):
        base = "".join(r.choices("ACGT", k=96))
        at = [9 + 10 * j - (j > 5) for j in range(9)]  # nine edits, nine letters or fewer between them
        far = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if j in at else c for j, c in enumerate(base))
        seqs |= {i: base, i + 1: far, i + 2: reverse_complement(far if i % 2 else base)}
    df = spark.createDataFrame(list(seqs.items()), "id int, seq string")
    want = {(a, b) for a in seqs for b in seqs if a < b and infix_identity(seqs[a], seqs[b], True) >= 0.9}
    assert len(want) == 60 and cluster.seed_length(df, 0.9) == 9
    assert {(a, b) for a, b, _ in rows(cluster.similar(df, 0.9, 0.9, None, True))} == want
    assert dict(rows(cluster.greedy(df, 0.9, 0.9, None, True))) == {i: i - i % 3 for i in seqs}
    masked = spark.createDataFrame([(0, seqs[0]), (1, "".join("N" if i % 8 == 7 else c for i, c in enumerate(seqs[0][:50])) + seqs[0][50:])], "id int, seq string")
    assert rows(cluster.similar(masked, 0.9, 0.9, None, True)) == [(0, 1, 1.0)]


def test_dna_candidates_are_few_and_hold_every_similar_pair(spark):
    from lociweave.functions.kernels import infix_identity

    r = random.Random(5)
    for size, identity in ((96, 0.9), (90, 0.9), (60, 0.95), (30, 0.9)):
        seqs = []
        for _ in range(60):
            s = r.choices("ACGT", k=size)
            seqs.append("".join(s))
            for _ in range(r.randint(0, int((1 - identity) * size + 1e-9))):
                at = r.randrange(len(s))
                s[at : at + r.randint(0, 1)] = r.choices("ACGT", k=r.randint(0, 1))
            seqs.append("".join(s) if r.random() < 0.5 else reverse_complement("".join(s)))
        df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
        first = lambda i, j: (i, j) if (-len(seqs[i]), i) < (-len(seqs[j]), j) else (j, i)
        want = {first(i, j) for i in range(120) for j in range(i) if min(map(len, (seqs[i], seqs[j]))) >= 0.8 * max(map(len, (seqs[i], seqs[j]))) and infix_identity(seqs[i], seqs[j], True) >= identity}
        assert len(want) >= 40 and {x[:2] for x in rows(cluster.similar(df, identity, 0.8, None, True))} == want
    many = spark.createDataFrame([(i, "".join(r.choices("ACGT", k=96))) for i in range(3000)], "id int, seq string")
    assert cluster.whole_pieces(many, 0.9, 0.9, 9).count() < 500  # some 6000 share a seed alone


def test_seeds_are_never_broadcast(spark):
    r = random.Random(6)
    df = written(spark.createDataFrame([(i, "".join(r.choices("ACGT", k=96))) for i in range(20)], "id int, seq string"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    joins = [x for k in (None, 5) for x in plan(cluster.similar(df, 0.9, 0.9, k, True)).splitlines() if "Join" in x and "seed" in x]
    assert len(joins) == 2 and all("SortMergeJoin" in x for x in joins)


def test_word_edges_need_no_order_of_all_words(spark, tmp_path):
    from lociweave.sources import views as V

    docs = [("s", 1, "A b a c"), ("s", 1, "a B a c"), ("t", 1, "b a"), (None, 2, "x y y x z"), ("s", None, "q r"), ("t", 3, None), ("t", 4, "one"), ("t", 5, "")]
    spark.createDataFrame(docs, "source string, doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = graph.edge_members(V.token_genes(spark, str(tmp_path)))
    assert sorted(map(str, rows(V.token_edges(spark, str(tmp_path))))) == sorted(map(str, rows(want)))
    assert "Window" not in V.token_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_variants_by_bits_equal_those_by_lists(spark, monkeypatch):
    r = random.Random(8)
    members = sorted({(*sorted((f"n{r.randint(0, 3)}", f"x{r.randint(0, 30)}")), r.randint(0, 140)) for _ in range(6000)})
    em = spark.createDataFrame(members, "a string, b string, genome int")
    held = {}
    for a, b, g in members:
        for node, near in ((a, b), (b, a)):
            held.setdefault(node, {}).setdefault(near, set()).add(g)
    want = sorted((c, x, y, len(e[x] & e[y])) for c, e in held.items() if len(e) > 2 for x in e for y in e if x < y and len(e[x] & e[y]) >= 15)
    for bits in (graph.BITS, 0):
        monkeypatch.setattr(graph, "BITS", bits)
        assert sorted(rows(graph.structural_variants(em, 15))) == want and want


def test_families_equal_rounds_by_hand_and_contract_genomes_once(spark, monkeypatch):
    r = random.Random(12)
    names = [f"c{i:02}" for i in range(30)]
    held = {c: set(r.sample(range(12), r.randint(1, 3))) for c in names}
    links = {tuple(sorted(r.sample(names, 2))) for _ in range(60)}
    sim = {tuple(sorted(r.sample(names, 2))) for _ in range(120)}
    members = spark.createDataFrame([(c, g) for c, gs in held.items() for g in sorted(gs)], "cluster string, genome int")
    em = spark.createDataFrame([(a, b, 0) for a, b in sorted(links)], "a string, b string, genome int")
    new, e, pairs, held, rounds = {c: c for c in names}, set(links), set(sim), dict(held), 0
    while True:
        near = {c: {c} | {y for x in e for y in x if c in x} for c in held}
        centres = [near[c] for c in held if len(near[c]) > 3]
        free = {(a, b) for a, b in pairs if not held[a] & held[b] and any(a in n and b in n for n in centres)}
        if not free:
            break
        rounds += 1
        of = {c: [y for x in free if c in x for y in x if y != c] for x in free for c in x}
        best = {c: min(near_by, key=lambda y: (-len(held[y]), y)) for c, near_by in of.items()}
        into = {b: a for a, b in best.items() if best[b] == a and a < b} or dict([min(free)[::-1]])
        for b, a in into.items():
            held[a] = held[a] | held.pop(b)
        moved = lambda xs: {tuple(sorted((into.get(a, a), into.get(b, b)))) for a, b in xs if into.get(a, a) != into.get(b, b)}  # noqa: B023, E731
        e, pairs, new = moved(e), moved(pairs), {c: into.get(n, n) for c, n in new.items()}
    calls, real = [], graph.contract
    monkeypatch.setattr(graph, "contract", lambda *x: calls.append(x) or real(*x))
    m, edges_, got = correct.collapse_families(members, em, spark.createDataFrame(sorted(sim), "a string, b string"), (1,))
    assert dict(rows(got)) == new and rounds > 2 and len(calls) == 1
    assert {x[:2] for x in rows(edges_)} == e and sorted(rows(m)) == sorted((c, g) for c, gs in held.items() for g in gs)


def _families_by_hand(held, links, sim, depths):
    new, e, pairs, held = {c: c for c in held}, set(links), set(sim), {c: set(g) for c, g in held.items()}
    for depth in depths:
        while True:
            next_to = {c: {y for x in e for y in x if c in x} - {c} for c in held}
            ball = {}
            for c in held:
                ball[c] = {c}
                for _ in range(depth):
                    ball[c] = ball[c].union(*(next_to[x] for x in ball[c]))
            centres = {c for c in held if len(next_to[c]) > 2}
            free = {(a, b) for a, b in pairs if not held[a] & held[b] and ball[a] & ball[b] & centres}
            if not free:
                break
            of = {c: [y for x in free if c in x for y in x if y != c] for x in free for c in x}
            best = {c: min(near_by, key=lambda y: (-len(held[y]), y)) for c, near_by in of.items()}
            into = {b: a for a, b in best.items() if best[b] == a and a < b} or dict([min(free)[::-1]])
            for b, a in into.items():
                held[a] = held[a] | held.pop(b)
            moved = lambda xs: {tuple(sorted((into.get(a, a), into.get(b, b)))) for a, b in xs if into.get(a, a) != into.get(b, b)}  # noqa: B023, E731
            e, pairs, new = moved(e), moved(pairs), {c: into.get(n, n) for c, n in new.items()}
    return new


def test_families_equal_rounds_by_hand_at_every_depth(spark):
    r = random.Random(14)
    names = [f"c{i:02}" for i in range(60)]
    held = {c: set(r.sample(range(4), r.randint(1, 2))) for c in names}
    links = {("c00", c) for c in names[1:20]} | {(names[i], names[i + r.randint(1, 3)]) for i in range(18, 56)} | {("c56", "c57"), ("c57", "c58"), ("c57", "c59")}
    sim = {tuple(sorted(r.sample(names, 2))) for _ in range(60)} | {("c58", "c59"), ("c30", "c56")}
    members = spark.createDataFrame([(c, g) for c, gs in held.items() for g in sorted(gs)], "cluster string, genome int")
    em = spark.createDataFrame([(a, b, 0) for a, b in sorted(links)], "a string, b string, genome int")
    assert 0 < correct._hubs(em.select("a", "b"), members, None, 2).count() < len(names)
    got = dict(rows(correct.collapse_families(members, em, spark.createDataFrame(sorted(sim), "a string, b string"))[2]))
    want = _families_by_hand(held, links, sim, (1, 2, 3))
    assert got == want and len({tuple(sorted(_families_by_hand(held, links, sim, d).items())) for d in ((1,), (1, 2), (1, 2, 3))}) == 3


def test_registered_families_look_farther_than_one_hop(spark, tmp_path):
    from lociweave.plans import catalogue

    texts = [("s0", "mid one"), ("s0", "mid two"), ("s1", "mid zebra"), ("s2", "one tree"), ("s3", "two trees")]
    docs = spark.createDataFrame([(i, t, "en", g, len(t)) for i, (g, t) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(rows(catalogue.queries()["collapse_families"](spark, str(tmp_path))))["trees"] == "tree"


def test_coarsening_and_extraction(spark):
    s = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWY" * 2), (2, "ACDEFGHIKLMNPQRSTVWY" * 2), (3, "ACDEFGHIKLMNPQRSTVWA" + "ACDEFGHIKLMNPQRSTVWY"), (4, "YYYYYWWWWWVVVVV")], "id int, seq string")
    assert dict(rows(cluster.coarsen(s, (0.99, 0.9)))) == {1: 1, 2: 1, 3: 1, 4: 4}
    cells = spark.createDataFrame([("x", 0, "g1_len;g2"), ("y", 0, "g3")], "cluster string, genome int, cell string")
    g = spark.createDataFrame([(0, "g1", "A", "M"), (0, "g2", "C", "K"), (0, "g3", "G", "L")], "genome int, annotation_id string, dna string, protein string")
    assert rows(query.extract_sequences(cells, g, ["x"])) == [("0_g1", "A"), ("0_g2", "C")]


def test_components_and_within(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d")], "a string, b string")
    n = spark.createDataFrame([(x,) for x in "abcdxyz"], "cluster string")
    assert dict(rows(graph.components(e, n, written))) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    assert rows(graph.within(e, spark.createDataFrame([("a",)], "cluster string"), 2)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_alignment_operators(spark):
    r = spark.createDataFrame([("g", 1, "ACGT"), ("g", 2, "AGT")], "gene string, record int, seq string")
    out = rows(align.align_genes(r))
    assert len({len(x[2]) for x in out}) == 1
    k = spark.createDataFrame([("g", 0, 1, "A-"), ("g", 0, 2, "AC"), ("h", 1, 1, "TT")], "gene string, genome int, record int, aligned string")
    assert rows(align.concatenated(k, spark.createDataFrame([(0,), (1,)], "genome int"))) == [(0, "AC--"), (1, "--TT")]


def test_expressions(spark):
    d = spark.createDataFrame([("ATGAAACTNTAA",)], "s string").select(dna.translate_dna("s").alias("p"), dna.reverse_complement("s").alias("r"), dna.valid_gene(F.col("s"), dna.translate_dna("s")).alias("v")).first()
    assert tuple(d) == ("MKL*", reverse_complement("ATGAAACTNTAA"), True)


def annotation(path, name, genome, parts):
    body, text, at = "", "##gff-version 3\n", 1
    for i, (s, gene) in enumerate(parts):
        text += f"{name}\tx\tCDS\t{at}\t{at + len(s) - 1}\t.\t+\t0\tID={genome}_{i};gene={gene}\n"
        body += s + "TTTT"
        at += len(s) + 4
    (path / f"{genome}.gff").write_text(f"{text}##FASTA\n>{name}\n{body}\n")


def test_run_on_identical_genomes(spark, tmp_path):
    r = random.Random(9)
    safe = [a + b + c for a in "ACG" for b in "ACG" for c in "ACG"]
    parts = [("ATG" + "".join(r.choices(safe, k=30)) + "TAA", f"g{i}") for i in range(4)]
    for g in ("one", "two", "three"):
        annotation(tmp_path, "c1", g, parts)
    run = pangenome.run(spark, [str(tmp_path / f"{g}.gff") for g in ("one", "two", "three")])
    assert run.summary.first().total == 4 and run.members.count() == 12
    more = pangenome.merge(spark, [run, pangenome.run(spark, [str(tmp_path / "one.gff")], "sensitive")])
    assert more.summary.first().total == 4 and more.members.count() == 16
    run.register(spark)
    assert spark.sql("select count(*) from pangenome_members").first()[0] == 12


def test_run_finds_what_annotation_missed(spark, tmp_path):
    r = random.Random(9)
    safe = [a + b + c for a in "ACG" for b in "ACG" for c in "ACG"]
    parts = [("ATG" + "".join(r.choices(safe, k=30)) + "TAA", f"g{i}") for i in range(5)]
    for g in ("one", "two", "three"):
        annotation(tmp_path, "c1", g, parts)
    text = (tmp_path / "two.gff").read_text()
    (tmp_path / "two.gff").write_text("".join(x for x in text.splitlines(True) if "gene=g2" not in x))
    notes, _, seqs = (tmp_path / "three.gff").read_text().partition("##FASTA\n")
    (tmp_path / "three.gff").write_text(notes)
    (tmp_path / "three.fna").write_text(seqs)
    paths = [str(tmp_path / "one.gff"), str(tmp_path / "two.gff"), (str(tmp_path / "three.gff"), str(tmp_path / "three.fna"))]
    left = pangenome.run(spark, paths, "moderate", refind=False)
    assert left.members.count() == 14
    run = pangenome.run(spark, paths, "moderate")
    assert run.summary.first().core == 5 and run.members.count() == 15 and run.genes.where("ix is null").count() == 1
    assert run.genes.where("ix is null").first().dna == parts[2][0]


def test_sinks_round_trip(spark, tmp_path):
    g = genes(spark, [(0, "ab"), (1, "ac")])
    m, em = matrix.presence(g), graph.edge_members(g)
    sinks.gml(m, em, f"{tmp_path}/g.gml")
    m2, e2, _ = readers.gml(spark, f"{tmp_path}/g.gml")
    assert {(c, n) for _, c, n in rows(m2)} == set(rows(m)) and len(rows(e2)) == len(rows(em))
    names = m.select("cluster", F.col("cluster").alias("name"), F.lit("x").alias("annotation")).distinct()
    sinks.presence_absence(matrix.cells(g), names, [0, 1], str(tmp_path / "pa"))
    assert rows(readers.presence_table(spark, f"{tmp_path}/pa/gene_presence_absence.Rtab")) == [("a", "0"), ("a", "1"), ("b", "0"), ("c", "1")]
    sinks.fasta(spark.createDataFrame([("s1", "ACGT"), ("s2", "GG")], "id string, seq string"), f"{tmp_path}/f")
    assert rows(readers.fasta(spark, f"{tmp_path}/f")) == [("s1", "ACGT"), ("s2", "GG")]
    sinks.write_manifest(str(tmp_path), {"alignment": "core"}, False)
    with pytest.raises(FileExistsError):
        sinks.write_manifest(str(tmp_path), {"alignment": "core"}, False)


def test_stream_adds_genomes(spark, tmp_path):
    src = tmp_path / "in"
    genes(spark, [(0, "abc")]).write.parquet(f"{src}/a")
    stream = lambda: spark.readStream.schema(GENES).option("recursiveFileLookup", "true").parquet(str(src))
    for new in (None, [(1, "abd")]):
        if new:
            genes(spark, new).write.parquet(f"{src}/b")
        ingest.start(stream(), f"{tmp_path}/m", f"{tmp_path}/e", f"{tmp_path}/ck").awaitTermination()
    m, e = ingest.current(spark, f"{tmp_path}/m", f"{tmp_path}/e")
    whole = genes(spark, [(0, "abc"), (1, "abd")])
    assert rows(m) == rows(matrix.presence(whole)) and rows(e) == rows(graph.edge_members(whole))
