"""Made genomes for tests: gain and loss on a coalescent tree, changed codons, contamination, broken contigs.

All is a function of the seed: hashes in place of generators, so that rows can be made anywhere in any order.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.dna import code


@dataclass
class Made:
    """Genes of each genome in order, as (genome, ix, gene, dna), and the genealogy as (node, parent, length)."""

    genes: list[tuple[int, int, str, str]]
    tree: list[tuple[int, int, float]]


def genealogy(n: int, seed: int) -> list[tuple[int, int, float]]:
    """(node, parent, branch length) of a coalescent tree of n tips 0 to n - 1; the root is its own parent."""
    r = random.Random(seed)
    height, out = dict.fromkeys(range(n), 0.0), []
    live, now, new = list(range(n)), 0.0, n
    while len(live) > 1:
        now += r.expovariate(len(live) * (len(live) - 1) / 2)
        a, b = r.sample(live, 2)
        for x in (a, b):
            out.append((x, new, now - height[x]))
            live.remove(x)
        height[new] = now
        live.append(new)
        new += 1
    return [*out, (live[0], live[0], 0.0)]


def random_gene(r: random.Random, codons: int) -> str:
    """A start, codons that are no stops, a stop."""
    table = sorted(c for c, a in code(11)[0].items() if a != "*" and "N" not in c)
    return "ATG" + "".join(r.choices(table, k=codons)) + "TAA"


def changed(dna: str, rate: float, r: random.Random) -> str:
    """Codons between start and stop changed to others that are no stops, each with the probability of the rate."""
    table = sorted(c for c, a in code(11)[0].items() if a != "*" and "N" not in c)
    parts = [dna[i : i + 3] for i in range(0, len(dna), 3)]
    return "".join(c if i in (0, len(parts) - 1) or r.random() >= rate else r.choice(table) for i, c in enumerate(parts))


def pangenome(n: int, core: int, gain: float, loss: float, mutation: float, codons: int = 60, seed: int = 1) -> Made:
    """Genomes under infinitely many genes: new ones arrive at the rate ``gain`` a unit of tree length, each accessory gene is
    lost at the rate ``loss``, and codons change at the rate ``mutation``; core genes are never lost."""
    r = random.Random(seed)
    tree = genealogy(n, seed)
    root = tree[-1][0]
    count = 0

    def fresh(kind: str) -> tuple[str, str]:
        nonlocal count
        count += 1
        return f"{kind}{count}", random_gene(r, codons)

    held = {root: [fresh("core") for _ in range(core)]}
    for _ in range(int(gain / loss) if loss else 0):  # what the root has at equilibrium
        held[root].insert(r.randint(0, len(held[root])), fresh("acc"))
    for node, parent, length in sorted(tree[:-1], key=lambda x: -x[1]):  # parents have greater numbers
        own = [(g, changed(s, 1 - 2.718281828 ** (-mutation * length), r)) for g, s in held[parent] if g.startswith("core") or r.random() < 2.718281828 ** (-loss * length)]
        left = length
        while gain and (left := left - r.expovariate(gain)) > 0:
            if r.random() < 2.718281828 ** (-loss * left):
                own.insert(r.randint(0, len(own)), fresh("acc"))
        held[node] = own
    return Made([(g, i, name, dna) for g in range(n) for i, (name, dna) in enumerate(held[g])], tree)


def with_diversity(genes: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """(genome, gene, dna) with codons between start and stop changed at a rate, by a hash of genome, gene and place."""
    table = F.array(*[F.lit(c) for c in sorted(c for c, a in code(11)[0].items() if a != "*" and "N" not in c)])
    n = F.length("dna") / 3
    draw = lambda i, what: F.pmod(F.xxhash64(F.col("genome"), F.col("gene"), i, F.lit(f"{what}{seed}")), F.lit(1_000_000))
    keep = lambda i: (i == 0) | (i == n - 1) | (draw(i, "if") >= int(rate * 1_000_000))
    parts = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.when(keep(i), F.substring("dna", i * 3 + 1, F.lit(3))).otherwise(F.element_at(table, (draw(i, "to") % F.size(table) + 1).cast("int"))))
    return genes.withColumn("dna", F.array_join(parts, ""))


def contaminated(contigs: DataFrame, foreign: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """(genome, contig, seq) and for a share of the genomes, by hash, all of some foreign (contig, seq) too."""
    some = contigs.select("genome").distinct().where(F.pmod(F.xxhash64("genome", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    return contigs.select("genome", "contig", "seq").unionByName(some.join(foreign.select(F.concat(F.lit("foreign_"), F.col("contig").cast("string")).alias("contig"), "seq")).select("genome", F.col("contig").cast(contigs.schema["contig"].dataType), "seq"))


def fragmented(contigs: DataFrame, mean: int, least: int = 1) -> DataFrame:
    """(genome, contig, seq) cut into pieces of about a mean length; pieces shorter than the least are lost.

    A cut is where a hash of genome, contig and place says so, once in ``mean`` places.
    """
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("seq") - 1, F.lit(1))), lambda i: (F.pmod(F.xxhash64("genome", "contig", i), F.lit(mean)) == 0) & (i < F.length("seq")))
    cuts = F.concat(F.array(F.lit(0)), at)
    rows = contigs.withColumn("ends", F.concat(at, F.array(F.length("seq")))).select("genome", "contig", "seq", "ends", F.posexplode(cuts).alias("piece", "start"))
    piece = F.expr("substring(seq, start + 1, ends[piece] - start)")
    return rows.select("genome", F.concat_ws("_", F.col("contig").cast("string"), F.col("piece").cast("string")).alias("contig"), piece.alias("seq")).where(F.length("seq") >= least)


def annotation_text(genes: list[tuple[int, str, str]], contig: str, gap: str = "CCCC") -> str:
    """An annotation with its sequence of (ix, gene, dna) on one contig."""
    lines, body = ["##gff-version 3"], ""
    for ix, gene, dna in genes:
        body += gap
        lines.append(f"{contig}\tmade\tCDS\t{len(body) + 1}\t{len(body) + len(dna)}\t.\t+\t0\tID={contig}_{ix};gene={gene}")
        body += dna
    return "\n".join([*lines, "##FASTA", f">{contig}", body + gap]) + "\n"
