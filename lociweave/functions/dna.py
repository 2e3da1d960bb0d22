"""Sequence functions as column expressions: no Python rows."""

from __future__ import annotations

from pyspark.sql import functions as F

# Genetic codes by number, amino acids in the order of bases T, C, A, G, and their start codons.
CODES = {
    1: ("FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTG", "CTG", "ATG")),
    2: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", ("ATT", "ATC", "ATA", "ATG", "GTG")),
    3: ("FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATA", "ATG", "GTG")),
    4: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    5: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", ("TTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    6: ("FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATG",)),
    9: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", ("ATG", "GTG")),
    10: ("FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATG",)),
    11: ("FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    12: ("FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("CTG", "ATG")),
    13: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG", ("TTG", "ATA", "ATG", "GTG")),
    14: ("FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", ("ATG",)),
    16: ("FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATG",)),
    21: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG", ("ATG", "GTG")),
    22: ("FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATG",)),
    23: ("FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATT", "ATG", "GTG")),
    24: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", ("TTG", "CTG", "ATG", "GTG")),
    25: ("FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTG", "ATG", "GTG")),
    26: ("FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("CTG", "ATG")),
}
BASES = "TCAG"
IUPAC = ("ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN")


def code(number: int) -> tuple[dict[str, str], tuple[str, ...]]:
    """Codons to amino acids, with N for a third base that doesn't matter, and start codons."""
    if number not in CODES:
        raise ValueError(f"no genetic code {number}")
    acids, starts = CODES[number]
    codons = {a + b + c: acids[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    for p in {c[:2] for c in codons}:
        if len(acid := {codons[p + c] for c in BASES}) == 1:
            codons[p + "N"] = acid.pop()
    return codons, starts


def codon_line(number: int = 11) -> str:
    """Amino acids of all codons of T, C, A, G and N, in that order of bases; X where a codon has several."""
    codons = code(number)[0]
    return "".join(codons.get(a + b + c, "X") for a in BASES + "N" for b in BASES + "N" for c in BASES + "N")


def reverse_complement(s) -> F.Column:
    a, b = IUPAC
    return F.translate(F.reverse(s), a + a.lower(), b + b.lower())


def translate_dna(s, number: int = 11, start: bool = True) -> F.Column:
    """Protein of whole codons; unknown codons are X; a start codon at the beginning is M."""
    # bases as digits 0 to 4: a codon is a number, and its acid is at that place of one line
    digits = F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), BASES + "N", "01234")
    line = F.lit(codon_line(number))
    at = F.when(F.length(s) >= 3, F.sequence(F.lit(1), F.length(s) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    protein = F.array_join(F.transform(at, lambda i: F.substring(line, F.conv(F.substring(digits, i, F.lit(3)), 5, 10).cast("int") + 1, F.lit(1))), "")
    if not start:
        return protein
    return F.when(F.substring(s, 1, 3).isin(*code(number)[1]), F.concat(F.lit("M"), F.substring(protein, 2, 1 << 30))).otherwise(protein)


def checked_protein(protein) -> F.Column:
    """A protein without one stop at its end; another stop in it fails the job."""
    p = trim_stop(protein)
    return F.when(F.instr(p, "*") > 0, F.raise_error(F.concat(F.lit("a stop within "), p)).cast("string")).otherwise(p)


def marked_id(sid, length_outlier, stop) -> F.Column:
    """An id with the marks that presence tables give genes of odd length and with stops."""
    return F.concat(sid, F.when(length_outlier, "_len").otherwise(""), F.when(stop, "_pseudo").otherwise(""))


def rejected_for_codons(protein, dna, number: int = 11) -> F.Column:
    """Whether a gene can't be aligned by codons: it isn't translated to the protein, or has unknown bases in a row or codons of more than one meaning."""
    p = trim_stop(translate_dna(dna, number))
    return (p != trim_stop(protein)) | F.upper(dna).contains("NN") | F.contains(p, F.lit("X"))


def trim_stop(protein) -> F.Column:
    """Without one stop at the end."""
    return F.regexp_replace(protein, r"\*$", "")


def valid_cds(frame, dna) -> F.Column:
    """Frame 0, whole codons, long enough, no stop before the last codon."""
    p = translate_dna(dna, start=False)
    return (frame == "0") & (F.length(dna) % 3 == 0) & (F.length(dna) >= 34) & (F.instr(F.substring(p, F.lit(1), F.length(p) - 1), "*") == 0)


def valid_gene(dna, protein) -> F.Column:
    """Whole codons, starts with M (after unknowns), no stop but at the end."""
    p = F.regexp_replace(protein, "^X+|X+$", "")
    return (F.length(dna) % 3 == 0) & p.startswith("M") & (F.instr(F.substring(p, F.lit(1), F.greatest(F.length(p) - 1, F.lit(0))), "*") == 0)


def internal_stop(protein) -> F.Column:
    """A stop before the last three letters, after the first."""
    return F.instr(F.substring(protein, F.lit(2), F.greatest(F.length(protein) - 4, F.lit(0))), "*") > 0


def kmers(s, k: int) -> F.Column:
    """Distinct substrings of length k."""
    at = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(s, i, F.lit(k))))


def six_frames(s, number: int = 11) -> F.Column:
    """Array of (frame, protein): three of the strand, then three of the other."""
    rc = reverse_complement(s)
    return F.array(*[F.struct(F.lit(i).alias("frame"), translate_dna(F.substring(x, i % 3 + 1, 1 << 30), number, start=False).alias("protein")) for i, x in enumerate([s, s, s, rc, rc, rc])])


def best_frame(s, target, number: int = 11) -> F.Column:
    """(shared, frame, protein) of the frame that shares most 3-mers with the target; the first of equals."""
    t = kmers(target, 3)
    scored = F.transform(six_frames(s, number), lambda f: F.struct(F.size(F.array_intersect(kmers(f["protein"], 3), t)).alias("shared"), (-f["frame"]).alias("order"), f["frame"].alias("frame"), f["protein"].alias("protein")))
    return F.array_max(scored)


def window(s, start, end, margin: int) -> F.Column:
    """Substring of a 1-based closed interval with a margin, cut at the ends of the sequence."""
    low = F.greatest(start - margin, F.lit(1))
    return F.substring(s, low, F.least(end + margin, F.length(s)) - low + 1)


def substring_id(sid, offset) -> F.Column:
    """A composite id with its genome number moved by an offset."""
    p = F.split(sid, "_", 2)
    return F.concat_ws("_", (p[0].cast("int") + offset).cast("string"), p[1])
