"""Statistics over a presence and absence relation (cluster, genome)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .matrix import genome_count, spectrum, support


def cluster_weights(samples: DataFrame) -> DataFrame:
    """(sample, cluster) to (sample, weight): one over the size of the sample's cluster."""
    return samples.select("sample", (1 / F.count("*").over(Window.partitionBy("cluster"))).alias("weight"))


def mutual_information(members: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(a, b, mi) for all pairs of clusters that aren't in every genome, from overlaps and marginals.

    Overlaps come from a join on the genome; a pair without overlap is made of the marginals alone. weights: (genome, w).
    """
    w = weights if weights is not None else members.select("genome").distinct().withColumn("w", F.lit(1.0))
    n = w.agg(F.sum("w").alias("n"), F.count("*").alias("genomes"))
    m = members.join(w, "genome")
    s = m.groupBy("cluster").agg(F.sum("w").alias("s"), F.count("*").alias("k")).join(F.broadcast(n)).where("k < genomes").select("cluster", "s")
    m = m.join(s.select("cluster"), "cluster", "left_semi")
    n11 = m.select("genome", "w", F.col("cluster").alias("a")).join(m.select("genome", F.col("cluster").alias("b")), "genome").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("n11"))
    pairs = s.select(F.col("cluster").alias("a"), F.col("s").alias("sa")).join(s.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b"))
    x = pairs.join(n11, ["a", "b"], "left").join(F.broadcast(n)).withColumn("n11", F.coalesce("n11", F.lit(0.0)))
    x = x.withColumns({"n10": F.col("sa") - F.col("n11"), "n01": F.col("sb") - F.col("n11"), "n00": F.col("n") - F.col("sa") - F.col("sb") + F.col("n11")})
    p = {k: (F.col(f"n{k}") + 0.5) / (F.col("n") + 2) for k in ("11", "10", "01", "00")}
    ma = {"1": p["11"] + p["10"], "0": p["01"] + p["00"]}
    mb = {"1": p["11"] + p["01"], "0": p["10"] + p["00"]}
    mi = sum(p[k] * (F.log(p[k]) - F.log(ma[k[0]]) - F.log(mb[k[1]])) for k in p)
    return x.select("a", "b", mi.alias("mi"))


def keep_quantile(pairs: DataFrame, q: float) -> DataFrame:
    """Pairs whose information reaches the exact quantile."""
    t = pairs.agg(F.expr(f"percentile(mi, {q})").alias("t"))
    return pairs.join(F.broadcast(t)).where("mi - t >= -1e-4").drop("t")


def tukey(pairs: DataFrame) -> DataFrame:
    """(a, b, mi, outlier): 1 beyond 1.5 and 2 beyond 3 interquartile ranges over the third quartile of the maximum per a."""
    best = pairs.groupBy("a").agg(F.max("mi").alias("m")).agg(F.expr("percentile(m, array(0.25, 0.75))").alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    out = F.when(F.col("mi") > q3 + 3 * (q3 - q1), 2).when(F.col("mi") > q3 + 1.5 * (q3 - q1), 1).otherwise(0)
    return pairs.join(F.broadcast(best)).select("a", "b", "mi", out.alias("outlier"))


def aracne(pairs: DataFrame) -> DataFrame:
    """Drops the weakest pair of each triangle: an indirect association."""
    sym = pairs.select("a", "b", "mi").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))
    ac = sym.select("a", F.col("b").alias("c"), F.col("mi").alias("m1"))
    bc = sym.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("mi").alias("m2"))
    weak = pairs.join(ac, "a").where("mi < m1").join(bc, ["b", "c"]).where("mi < m2").select("a", "b").distinct()
    return pairs.join(weak, ["a", "b"], "left_anti")


def richness(members: DataFrame, threshold: int = 10, compatible: bool = False) -> DataFrame:
    """One row: observed, chao2, ice, jack1, jack2. compatible: the number of clusters stands for that of samples."""
    g = spectrum(members)
    rare = support(members).where(F.col("support") <= threshold).select("cluster")
    t = members.join(rare, "cluster", "left_semi").agg(F.countDistinct("genome").cast("double").alias("t"))
    at = lambda k: F.sum(F.when(F.col("k") == k, F.col("genes")).otherwise(0)).cast("double")
    low = F.col("k") <= threshold
    one = g.agg(
        F.sum("genes").cast("double").alias("s"), at(1).alias("q1"), at(2).alias("q2"),
        F.sum(F.when(low, F.col("genes")).otherwise(0)).cast("double").alias("si"), F.sum(F.when(low, 0).otherwise(F.col("genes"))).cast("double").alias("sf"),
        F.sum(F.when(low, F.col("k") * F.col("genes")).otherwise(0)).cast("double").alias("iq"),
        F.sum(F.when(low, F.col("k") * (F.col("k") - 1) * F.col("genes") - (1 if compatible else 0)).otherwise(0)).cast("double").alias("j"),
    ).join(F.broadcast(genome_count(members))).join(F.broadcast(t))
    m = F.col("s") if compatible else F.col("n").cast("double")
    s, q1, q2 = F.col("s"), F.col("q1"), F.col("q2")
    c = 1 - q1 / F.col("iq")
    lam = F.greatest(F.col("si") / c * F.col("t") / (F.col("t") - 1) * F.col("j") / (F.col("iq") * (F.col("iq") - 1)) - 1, F.lit(0.0))
    out = {
        "observed": s, "chao2": s + (m - 1) / m * q1 * (q1 - 1) / (2 * (q2 + 1)), "ice": F.col("sf") + F.col("si") / c + q1 / c * lam,
        "jack1": s + q1 * (m - 1) / m, "jack2": s + q1 * (2 * m - 3) / m - q2 * (m - 2) * (m - 2) / (m * (m - 1)),
    }
    return one.select(*[F.round(v, 4).alias(k) for k, v in out.items()])


def log_factorial(n) -> F.Column:
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), n), F.lit(0.0), lambda a, i: a + F.log(F.greatest(i, F.lit(1)).cast("double")))


def pan_core_curve(members: DataFrame) -> DataFrame:
    """(n, pan, core): expected clusters in any and in all of n genomes drawn without replacement."""
    n_all = genome_count(members)
    g = spectrum(members).join(F.broadcast(n_all)).withColumn("sample", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    lf = lambda x: log_factorial(F.greatest(x, F.lit(0)).cast("bigint"))
    choose = lambda a, b: lf(a) - lf(b) - lf(a - b)
    k, n, s = F.col("k"), F.col("n"), F.col("sample")
    absent = F.when(n - k >= s, F.exp(choose(n - k, s) - choose(n, s))).otherwise(0.0)
    every = F.when(k >= s, F.exp(choose(k, s) - choose(n, s))).otherwise(0.0)
    return g.groupBy(s.alias("n_genomes")).agg(F.round(F.sum(F.col("genes") * (1 - absent)), 4).alias("pan"), F.round(F.sum(F.col("genes") * every), 4).alias("core"))


def accumulation(members: DataFrame, boots: int = 100, seed: str = "7") -> DataFrame:
    """(n_genomes, low, mean, high): clusters in n genomes drawn with replacement; digests stand for a random source.

    Clusters of the same genomes are counted together, so the draws meet each pattern once.
    """
    ordered = members.select("genome").distinct().withColumn("slot", F.row_number().over(Window.orderBy("genome")) - 1)  # a row per genome
    n = genome_count(members)
    draw = n.select("n", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("n"))).alias("n_genomes")).select("*", F.explode(F.sequence(F.lit(1), F.lit(boots))).alias("boot"))
    draw = draw.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_genomes"))).alias("i"))
    key = F.concat_ws("-", F.lit(seed), F.col("n_genomes").cast("string"), F.col("boot").cast("string"), F.col("i").cast("string"))
    draw = draw.select("n_genomes", "boot", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.col("n")).alias("slot")).distinct()
    drawn = draw.join(ordered, "slot").select("n_genomes", "boot", "genome")
    alike = members.groupBy("cluster").agg(F.sort_array(F.collect_list("genome")).alias("g")).groupBy("g").agg(F.count("*").alias("w"))
    alike = alike.select(F.md5(F.array_join(F.transform("g", lambda x: x.cast("string")), "\t")).alias("pattern"), "w", F.explode("g").alias("genome"))
    per = alike.join(drawn, "genome").select("n_genomes", "boot", "pattern", "w").distinct().groupBy("n_genomes", "boot").agg(F.sum("w").alias("c"))
    q = F.expr("percentile(c, array(0.025, 0.975))")
    return per.groupBy("n_genomes").agg(F.round(q[0], 4).alias("low"), F.round(F.avg("c"), 4).alias("mean"), F.round(q[1], 4).alias("high"))


def permuted_curves(members: DataFrame, reps: int = 10) -> DataFrame:
    """(rep, n_genomes, pan, core): clusters in any and in all of the first genomes, under orders by digests of rep and genome.

    A cluster counts for pan from its first genome's place on, and for core up to the place before its first absence.
    """
    genomes = members.select("genome").distinct()
    reps_ = genomes.sparkSession.range(1, reps + 1).select(F.col("id").alias("rep"))
    order = genomes.join(reps_).withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.md5(F.concat_ws("-", F.col("rep").cast("string"), F.col("genome").cast("string"))), "genome")))
    at = members.join(order, "genome")
    # present at the first places without a gap: place equals its rank among the cluster's places
    ranked = at.withColumn("nth", F.row_number().over(Window.partitionBy("rep", "cluster").orderBy("place")))
    per = ranked.groupBy("rep", "cluster").agg(F.min("place").alias("first"), F.sum((F.col("nth") == F.col("place")).cast("int")).alias("upto"))
    pan = per.groupBy("rep", F.col("first").alias("place")).agg(F.count("*").alias("new"))
    core = per.where("upto > 0").groupBy("rep", F.col("upto").alias("place")).agg(F.count("*").alias("lost"))
    grid = order.select("rep", "place").join(pan, ["rep", "place"], "left").join(core, ["rep", "place"], "left")
    w = Window.partitionBy("rep").orderBy("place")
    back = Window.partitionBy("rep").orderBy(F.desc("place"))
    return grid.select("rep", F.col("place").alias("n_genomes"), F.coalesce(F.sum("new").over(w), F.lit(0)).alias("pan"), F.coalesce(F.sum("lost").over(back), F.lit(0)).alias("core"))
