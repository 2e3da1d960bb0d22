"""Annotations of other sources in the form that the readers take."""

from __future__ import annotations

from .readers import parse_fasta


def from_refseq(notes: str, sequences: str, skip_overlaps: bool = False) -> str:
    """A downloaded annotation and its sequences as one: coding features of whole codons on the given sequences, one for each
    id (later ones get a number), and without those that overlap the one kept before them if asked."""
    contigs = dict(parse_fasta(sequences))
    out, seen, last = ["##gff-version 3"], {}, None
    rows = [c for c in (x.split("\t") for x in notes.splitlines() if not x.startswith("#")) if len(c) == 9 and "CDS" in c[2]]
    for c in sorted(rows, key=lambda c: (c[0], int(c[3]), int(c[4]))):
        start, end = int(c[3]), int(c[4])
        if c[0] not in contigs or (end - start + 1) % 3 or end > len(contigs[c[0]]):
            continue
        if skip_overlaps and last and last[0] == c[0] and start <= last[1]:
            continue
        notes_ = dict(x.split("=", 1) for x in c[8].strip(";").split(";") if "=" in x)
        name = notes_.get("ID", notes_.get("locus_tag", f"{c[0]}_{start}"))
        seen[name] = seen.get(name, 0) + 1
        notes_["ID"] = name if seen[name] == 1 else f"{name}_{seen[name]}"
        last = (c[0], end)
        out.append("\t".join([*c[:2], "CDS", *c[3:8], ";".join(f"{k}={v}" for k, v in notes_.items())]))
    return "\n".join([*out, "##FASTA", *(f">{k}\n{v}" for k, v in contigs.items())]) + "\n"


def from_gene_caller(notes: str, sequences: str) -> str:
    """The output of a gene caller and the sequences that it was run on as one annotation."""
    return "\n".join(x for x in notes.splitlines() if x.strip()) + "\n##FASTA\n" + sequences.strip() + "\n"
