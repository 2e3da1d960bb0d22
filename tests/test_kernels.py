import random

import numpy as np
import pyarrow as pa
import pytest

from lociweave.functions import dna, kernels as K
from lociweave.operators import models as M
from lociweave.operators.query import minimum_cut
from lociweave.plans.defaults import settings
from lociweave.sources import readers

R = random.Random(7)
WINDOW = "".join(R.choices("ACGT", k=521))


def edit_infix(q, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(q, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_infix_distance_equals_dynamic_programme():
    for _ in range(300):
        q, t = "".join(R.choices("ACGT", k=R.randint(1, 30))), "".join(R.choices("ACGT", k=R.randint(0, 60)))
        assert K.infix_distance(q, t, 99) == edit_infix(q, t)
        assert K.infix_align(q, t)[0] == edit_infix(q, t)


def test_infix_identity_strands_and_wildcards():
    assert K.infix_identity("ACGTACGGA", K.reverse_complement("TTACGTACGGATT"), True) == 1
    assert K.infix_identity("MXKL", "MAKL") == 1
    assert K.infix_identity("AAAA", "CCCCCC") == 0


def test_infix_identities_of_many_equal_those_of_each():
    r = random.Random(11)
    for dna, letters in ((True, "ACGT"), (True, "ACGTNRn"), (False, "ACDXBZNEQ"), (False, "AC\u00e9\U0001f600X")):
        pairs = [("", ""), ("", "A"), ("A" * 64, "A" * 64), ("C" * 65, "A" + "C" * 64), ("A" * 128, "A" * 129)]
        for _ in range(300):
            a = r.choices(letters, k=r.choice([1, 5, 40, 63, 64, 65, 96, 128, 150]))
            b = [c if r.random() < 0.9 else r.choice(letters) for c in a][r.randint(0, 3) :] + r.choices(letters, k=r.randint(0, 20))
            pairs.append(("".join(a), "".join(r.choice([b, r.choices(letters, k=r.randint(0, 99))]))))
        pairs += [(a, K.reverse_complement(b)) for a, b in pairs[:100]]
        got = K.infix_identities(*(pa.array(x) for x in zip(*pairs, strict=True)), dna)
        assert got.tolist() == [K.infix_identity(a, b, dna) for a, b in pairs]


def test_search_forward_reverse_and_over_the_end():
    q = WINDOW[100:135]
    seq, (s, e), strand = K.search_dna(WINDOW, q, 0.5, 0.99)
    assert (seq, WINDOW[s:e], strand) == (q, q, 1)
    r = K.reverse_complement(q)
    seq, (s, e), strand = K.search_dna(WINDOW, r, 0.5, 0.99)
    assert (seq, WINDOW[s:e], strand) == (r, q, -1)
    seq, (s, e), _ = K.search_dna(WINDOW, "TTTT" + WINDOW[:15], 0.5, 0.99)
    assert seq == WINDOW[:15] and (s, e) == (0, 15)
    assert K.search_dna(WINDOW, "".join(R.choices("ACGT", k=40)), 0.5, 0.99) is None


def test_search_with_unknown_bases():
    r = random.Random(3)
    db = "".join(r.choices("ACGT", k=300))
    q = db[100:160]
    few = db[:120] + "N" * 6 + db[126:]
    assert K.search_dna(few, q, 0.5, 0.95) == (few[100:160], (100, 160), 1)
    assert K.search_dna(K.reverse_complement(few), q, 0.5, 0.95) == (few[100:160], (140, 200), -1)
    many = db[:130] + "N" * 25 + "".join(r.choices("ACGT", k=40))  # the end is unlike the gene
    hit = K.search_dna(many, q, 0.2, 0.9)
    assert hit and hit[0].startswith(db[100:130]) and hit[2] == 1
    assert K.search_dna(db[:105] + "N" * 50 + db[155:], q, 0.5, 0.9) is None  # too little of it is known


def test_alignments():
    a, b = K.global_align("ACGTT", "AGTT")
    assert a.replace("-", "") == "ACGTT" and b.replace("-", "") == "AGTT" and len(a) == len(b) == 5
    seqs = ["ACGTACGT", "ACGACGT", "ACGTACG", "CGTACGTT"]
    rows = K.centre_star(seqs)
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs
    assert K.codon_align("M-K", "ATGAAA") == "ATG---AAA"


def test_codes():
    codons, starts = dna.code(11)
    assert len([c for c in codons if "N" not in c]) == 64 and codons["CTN"] == "L" and "GTG" in starts
    with pytest.raises(ValueError):
        dna.code(99)


def test_trees_and_weights():
    t = M.parse_newick("((a:1,b:1):2,c:3);")
    assert sorted(x.label for x in t.leaves()) == ["a", "b", "c"] and [c.edge for c in t.children] == [2, 3]
    w = M.tree_weights(t)
    assert w["c"] == pytest.approx(3 / 7) and w["a"] == pytest.approx(2 / 7)
    with pytest.raises(ValueError):
        M.check_labels(t, {"a", "b"})


def test_finite_model_sums_to_one():
    t = M.parse_newick("((a:1,b:0.5):0.7,c:0.2);")
    total = sum(np.exp(M.pattern_likelihood(t, dict(zip("abc", p)), 0.3, 0.9)) for p in np.ndindex(2, 2, 2))
    assert total == pytest.approx(1)


def test_infinite_models():
    pan, core = M.coalescent_curves(5, [(2.0, 10.0)], 100)
    assert pan[0] == pytest.approx(core[0]) and (np.diff(pan) > 0).all() and (np.diff(core) < 0).all()
    assert M.coalescent_spectrum(5, [(2.0, 10.0)], 100).sum() == pytest.approx(pan[-1])
    t = M.parse_newick("((a:1,b:1):1,c:2);")
    s = M.tree_spectrum(t, [(3.0, 1.5)])
    assert (s * np.arange(1, 4)).sum() == pytest.approx(3 * 2.0)  # each genome holds gain / loss genes
    x, error = M.fit_gains(M.coalescent_spectrum(8, [(2.0, 50.0)], 300.0))
    assert error < 1


def test_scaling_and_cut():
    d = np.abs(np.arange(5.0)[:, None] - np.arange(5.0)[None])
    x = M.multidimensional_scaling(d)
    assert np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) == pytest.approx(d, abs=0.05)
    assert minimum_cut([("s", "a", 3), ("a", "t", 1), ("s", "b", 1), ("b", "t", 5)], "s", "t") == [("a", "t"), ("b", "s")]


def test_settings():
    assert settings("strict", 100).min_trailing_support == 5 and settings("sensitive", 100).trailing_rounds == 0
    with pytest.raises(ValueError):
        settings("other", 3)


def test_parsers():
    f, c = readers.parse_gff("##gff\n##sequence-region x 1 9\nc1\tp\tCDS\t1\t9\t.\t+\t0\tID=a;gene=b\n##FASTA\n>c1 x\nACG\nTAC\n")
    assert f == [("c1", "CDS", 1, 9, "+", "0", {"ID": "a", "gene": "b"}, 1)] and c == [("c1", "ACGTAC")]
    with pytest.raises(ValueError):
        readers.parse_gff("no sequences")
    g = readers.parse_gml('graph [ node [ id 0 members 1 members 2 name "a" ] edge [ source 0 target 1 ] ]')
    assert g["node"][0]["members"] == [1, 2] and g["edge"][0]["target"] == 1
    gb = "LOCUS       c1 12 bp\nFEATURES             Location/Qualifiers\n     CDS             complement(1..9)\n                     /locus_tag=\"t1\"\n                     /product=\"some thing\"\nORIGIN\n        1 acgtacgtac gt\n//\n"
    f, c = readers.parse_genbank(gb)
    assert f[0][:6] == ("c1", "CDS", 1, 9, "-", "0") and f[0][6]["product"] == "some thing" and c == [("c1", "ACGTACGTACGT")]
    assert readers.input_list(["a.gff", "b.gff b.fa", ""]) == ["a.gff", ("b.gff", "b.fa")]
