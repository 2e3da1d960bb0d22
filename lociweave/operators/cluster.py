"""Similarity of sequences and genomes: pairs in blocks, greedy clusters, sketches, containment."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import reverse_complement
from ..functions.kernels import infix_identities
from ..sources.stage import prepared, written


def pairs_in_blocks(rows: DataFrame) -> DataFrame:
    """(a, b, identity) of (id, seq, block) for pairs within a block, by edit distance of sequences of equal length."""
    x = rows.select("block", F.col("id").alias("a"), F.col("seq").alias("sa"))
    y = rows.select("block", F.col("id").alias("b"), F.col("seq").alias("sb"))
    p = x.join(y, "block").where("a < b")
    return p.select("a", "b", F.round(1 - F.levenshtein("sa", "sb") / F.greatest(F.length("sa"), F.length("sb")), 6).alias("identity"))


def seeds(rows: DataFrame, k: int) -> DataFrame:
    """(id, seed): digests of a sequence's distinct k-mers."""
    at = F.when(F.length("seq") >= k, F.sequence(F.lit(1), F.length("seq") - (k - 1))).otherwise(F.array().cast("array<int>"))
    return rows.select("id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substring("seq", i, F.lit(k)))))).alias("seed"))


def edits(n: Column, identity: float) -> Column:
    """Most edits of n letters at an identity."""
    return F.floor((1 - identity) * n + 1e-9).cast("int")


def seed_length(rows: DataFrame, identity: float) -> int:
    """The longest k such that each pair of that identity shares a k-mer: of e + 1 pieces, e edits leave one whole."""
    n = F.length("seq")
    return max(1, rows.where(n > 0).agg(F.min(F.floor(n / (edits(n, identity) + 1)))).first()[0] or 1)


#: Letters on either side of a seed that are packed into a number, two bits each.
PACKED = 31


def packed(text: Column) -> Column:
    """Letters A, C, G, T as digits of a number; others count as A, so equal texts give equal numbers."""
    return F.conv(F.translate(F.regexp_replace(text, "[^ACGT]", "A"), "ACGT", "0123"), 4, 10).cast("long")


def whole_pieces(rows: DataFrame, identity: float, length_ratio: float, k: int) -> DataFrame:
    """(a, b): DNA pairs, on either strand, of which a holds a piece of b near where an alignment would have it.

    b is cut into a piece more than it may have edits; the first k letters of each are looked for. With e edits, the
    piece that begins i letters into b begins i - e to i + e letters into a, more by what a is longer.
    If the pieces are even in number, one without edits is next to one with at most one: were all neighbours of such
    pieces to have two, there would be as many edits as pieces. So one half of that neighbour is in a too, at most one
    letter off. Half of at most 4 letters each are compared, in the join.
    """
    n = F.length("seq")
    e = edits(n, identity)
    h = min(4, k // 2)
    back = 2 * h + 1
    ahead = PACKED - back
    both = rows.select("id", "seq").unionAll(rows.select("id", reverse_complement(F.col("seq")).alias("seq"))).where(n >= k)
    start = lambda j: F.floor(j * n / (e + 1)).cast("int")
    short = both.select("id", "seq", n.alias("nb"), e.alias("e"), F.explode(F.sequence(F.lit(0), e)).alias("j"))
    short = short.select("*", start(F.col("j")).alias("i"), start(F.col("j") + 1).alias("next"))
    part = lambda at: packed(F.substring("seq", at + 1, F.lit(h)))
    off = F.col("next") - F.col("i") - k  # letters between the seed and the next piece
    tested = (F.col("e") % 2 == 1) & (off <= ahead - back) if h else F.lit(False)
    mine = {"ra": part(F.col("next")), "rb": part(F.col("next") + h), "la": part(F.col("i") - h), "lb": part(F.col("i") - 2 * h)} if h else {}
    short = short.select(
        F.col("id").alias("b"), "nb", "e", "i", F.xxhash64(F.substring("seq", F.col("i") + 1, F.lit(k))).alias("seed"), off.alias("off"), tested.alias("tested"),
        (F.col("j") < F.col("e")).alias("right"), (F.col("j") > 0).alias("left"), *[v.alias(c) for c, v in mine.items()],
    )
    around = F.concat(F.lit("A" * back), "seq", F.lit("A" * ahead))
    long = rows.where(n >= k).select(F.col("id").alias("a"), n.alias("na"), "seq", around.alias("around"), F.explode(F.sequence(F.lit(0), n - k)).alias("p"))
    near_by = packed(F.concat(F.substring("around", F.col("p") + 1, F.lit(back)), F.substring("around", F.col("p") + (back + k + 1), F.lit(ahead))))
    long = long.select("a", "na", "p", F.xxhash64(F.substring("seq", F.col("p") + 1, F.lit(k))).alias("seed"), near_by.alias("near_by"))
    order = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = F.col("p").between(F.col("i") - F.col("e"), F.col("i") + F.col("na") - F.col("nb") + F.col("e"))
    fits = ~F.col("tested")
    if h:
        at = lambda letter: f"(shiftright(near_by, 2 * ({PACKED - h} - ({letter}))) & {4**h - 1}L)"
        right = " or ".join([f"{at(f'{back} + off')} = ra", *(f"{at(f'{back + h + d} + off')} = rb" for d in (-1, 0, 1))])
        left = " or ".join([f"{at(back - h)} = la", *(f"{at(back - 2 * h + d)} = lb" for d in (-1, 0, 1))])
        fits = fits | F.expr(f"(right and ({right})) or (left and ({left}))")
    # seeds are many times the rows that they are estimated by, so neither side is to be broadcast
    return long.join(short.hint("merge"), "seed").where(order & near & (F.col("nb") >= length_ratio * F.col("na")) & fits).select("a", "b").distinct()


def similar(rows: DataFrame, identity: float, length_ratio: float = 0.0, k: int | None = 5, dna: bool = False) -> DataFrame:
    """(a, b, identity), a before b in (length descending, id): pairs that share a k-mer, verified by infix identity.

    With at most (n - k) / (k + 1) edits, sequences of n letters share one; pairs that share none aren't compared.
    Without k, it is the longest at which all pairs of the identity share one. DNA meets on both strands; an N matches
    any letter in the verification only.
    """
    prepared(rows.sparkSession)
    every = k is None
    k = k or seed_length(rows, identity)
    exact = every and dna and rows.where(F.contains("seq", F.lit("N"))).isEmpty()
    if exact:
        cand = whole_pieces(rows, identity, length_ratio, k)
    else:
        s = seeds(rows, k)
        t = s.unionAll(seeds(rows.select("id", reverse_complement(F.col("seq")).alias("seq")), k)).distinct() if dna else s
        cand = s.select("seed", F.col("id").alias("a")).join(t.select("seed", F.col("id").alias("b")).hint("merge"), "seed").where("a <> b").select("a", "b").distinct()
    x = rows.select(F.col("id").alias("a"), F.col("seq").alias("sa"))
    y = rows.select(F.col("id").alias("b"), F.col("seq").alias("sb"))
    p = cand.join(x, "a").join(y, "b").where((F.length("sa") > F.length("sb")) | ((F.length("sa") == F.length("sb")) & (F.col("a") < F.col("b"))))
    p = p.where(F.length("sb") >= length_ratio * F.length("sa"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = infix_identities(x.column("sa"), x.column("sb"), dna)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(found)], names=["a", "b", "identity"]).filter(pa.array(found >= identity))

    t = rows.schema["id"].dataType.simpleString()
    return p.select("a", "b", "sa", "sb").mapInArrow(verify, f"a {t}, b {t}, identity double")


def greedy(rows: DataFrame, identity: float, length_ratio: float = 0.0, k: int | None = 5, dna: bool = False) -> DataFrame:
    """(id, representative): each sequence, longest first, joins the most similar representative or becomes one.

    Rounds settle a sequence once all earlier similar ones are settled: it is a representative if none of them is.
    """
    pairs = written(similar(rows, identity, length_ratio, k, dna))
    open_, reps = written(rows.select("id")), None
    while True:  # each round settles the longest open sequence at least
        blocked = pairs.join(open_.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = written(open_.join(blocked, "id", "left_anti"))  # nothing before them is open, and no representative covers them
        if new.isEmpty():
            break
        reps = new if reps is None else reps.unionAll(new)
        covered = pairs.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_ = written(open_.join(new, "id", "left_anti").join(covered, "id", "left_anti"))
    if reps is None:
        return rows.select("id", F.col("id").alias("representative"))
    best = pairs.join(reps.select(F.col("id").alias("a")), "a").join(reps.select(F.col("id").alias("b")), "b", "left_anti")
    w = Window.partitionBy("b").orderBy(F.desc("identity"), "a")
    members = best.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("b").alias("id"), F.col("a").alias("representative"))
    return members.unionByName(reps.select("id", F.col("id").alias("representative")))


def word_sketches(rows: DataFrame, k: int, size: int) -> DataFrame:
    """(genome, h): the ``size`` smallest digests of the distinct k-word runs of each genome's texts."""
    w = rows.select("genome", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w")).where(F.size("w") >= k)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.md5(F.array_join(F.slice("w", i, F.lit(k)), " ")))
    h = w.select("genome", F.explode(F.array_distinct(runs)).alias("h"))
    # ranked without a distinct before, so that each task keeps only its own smallest for the shuffle by genome
    r = F.dense_rank().over(Window.partitionBy("genome").orderBy("h"))
    return h.withColumn("r", r).where(F.col("r") <= size).select("genome", "h").distinct()


def sketch_distances(sketches: DataFrame, k: int, size: int) -> DataFrame:
    """(a, b, jaccard, distance) of all pairs of genomes by the ``size`` smallest digests of both together."""
    one = sketches.select("genome").distinct()
    pairs = one.select(F.col("genome").alias("a")).join(one.select(F.col("genome").alias("b")), F.col("a") < F.col("b"))
    both = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("genome"))
    u = both.join(sketches, "genome").groupBy("a", "b", "h").agg(F.count("*").alias("n"))
    u = u.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("h"))).where(F.col("r") <= size)
    j = u.groupBy("a", "b").agg((F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).cast("double") / F.count("*")).alias("j"))
    d = F.when(F.col("j") > 0, -F.log(2 * F.col("j") / (1 + F.col("j"))) / k).otherwise(1.0)
    return j.select("a", "b", F.round("j", 9).alias("jaccard"), (F.round(d, 6) + 0.0).alias("distance"))


def word_runs(rows: DataFrame, key: str, k: int) -> DataFrame:
    w = rows.select(key, F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w")).where(F.size("w") >= k)
    return w.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " ")))).alias("k")).distinct()


def containment(rows: DataFrame, references: DataFrame, k: int, most: int) -> DataFrame:
    """(genome, ref, shared, containment, rank): references whose k-word runs a genome holds, the best ``most`` each."""
    r = word_runs(references, "ref", k)
    shared = word_runs(rows, "genome", k).join(r, "k").groupBy("genome", "ref").agg(F.count("*").alias("shared"))
    out = shared.join(r.groupBy("ref").agg(F.count("*").alias("n")), "ref")
    rank = F.row_number().over(Window.partitionBy("genome").orderBy(F.desc("shared"), "ref"))
    return out.select("genome", "ref", "shared", F.round(F.col("shared") / F.col("n"), 9).alias("containment"), rank.alias("rank")).where(F.col("rank") <= most)


def coarsen(rows: DataFrame, identities: tuple[float, ...], length_ratio: float = 0.0, k: int | None = 5, dna: bool = False) -> DataFrame:
    """(id, representative) at the last of descending identities; each step clusters the representatives of the one before."""
    out, left = rows.select("id", F.col("id").alias("representative")), rows
    for identity in identities:
        step = written(greedy(left, identity, length_ratio, k, dna).select(F.col("id").alias("_old"), F.col("representative").alias("_new")))
        out = written(out.join(step, F.col("representative") == F.col("_old")).select("id", F.col("_new").alias("representative")))
        left = written(left.join(step.where("_old = _new").select(F.col("_old").alias("id")), "id", "left_semi"))
    return out


def hit_prevalence(hits: DataFrame) -> DataFrame:
    """(ref, genomes, shared): in how many genomes a reference is a hit, and what they share with it."""
    return hits.groupBy("ref").agg(F.count("*").alias("genomes"), F.sum("shared").alias("shared"))


def outgroup(hits: DataFrame) -> DataFrame:
    """The genome of the fewest hits of (genome, hits), the least of equals: one row."""
    return hits.groupBy("genome").agg(F.sum("hits").alias("hits")).orderBy("hits", "genome").limit(1)
