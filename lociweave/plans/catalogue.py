"""Registered queries: each operator over whole driver tables, and the SQL that states the same."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import dna as D, kernels
from ..operators import align, cluster, correct, graph, matrix, models, query, stats
from ..sources import views as V
from ..sources.stage import prepared, written

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _ready(f):
    @functools.wraps(f)
    def run(spark, sf):
        prepared(spark)
        return f(spark, sf)

    return run


def queries() -> dict:
    return {name: _ready(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


MEMBERS = "members as (select distinct cluster, genome from genes), sup as (select cluster, count(*) as support from members group by cluster), n as (select count(distinct genome) as n from members)"
PREV = "prev as (select genome, cluster, lag(cluster) over (partition by genome, contig order by ix) as p from genes)"
EM = "em as (select distinct least(p, cluster) as a, greatest(p, cluster) as b, genome from prev where p is not null and p <> cluster), ed as (select a, b, count(*) as support from em group by a, b)"
SYM = "sym as (select a as node, b as neighbour from ed union all select b, a from ed)"
TOKENS = f"with {V.TOKENS}, {MEMBERS}"
ORDERS = f"with {V.ORDERS}, {MEMBERS}"
EVENTS = f"with {V.EVENTS}, {MEMBERS}"
TEXT_GRAPH = f"{TOKENS}, {PREV}, {EM}, {SYM}"
ORDER_GRAPH = f"{ORDERS}, {PREV}, {EM}, {SYM}"


# presence and absence


@_query(f"""{TOKENS} select count(*) filter (support / n >= 0.99) as core, count(*) filter (support / n >= 0.95 and support / n < 0.99) as soft_core,
  count(*) filter (support / n >= 0.15 and support / n < 0.95) as shell, count(*) filter (support / n < 0.15) as cloud, count(*) as total from sup, n""")
def summary_statistics(spark, sf):
    return matrix.summary(written(matrix.presence(V.token_genes(spark, sf))))


@_query(f"{TOKENS} select cluster, support from sup")
def gene_support(spark, sf):
    return matrix.support(matrix.presence(V.token_genes(spark, sf)))


@_query(f"{TOKENS} select cluster, genome from members")
def gene_presence_absence_long(spark, sf):
    return matrix.presence(V.token_genes(spark, sf))


@_query(f"{ORDERS} select cluster, " + ", ".join(f"count(*) filter (genome = {g}) as g{g}" for g in range(25)) + " from genes group by cluster")
def presence_absence_wide(spark, sf):
    return matrix.wide(V.order_genes(spark, sf), list(range(25)))


@_query(f"{TOKENS} select support as k, count(*) as genes from sup group by support")
def gene_frequency_spectrum(spark, sf):
    return matrix.spectrum(matrix.presence(V.token_genes(spark, sf)))


@_query(f"{TOKENS} select round(avg(c), 6) as mean_size from (select count(*) as c from members group by genome)")
def mean_genome_size(spark, sf):
    return matrix.mean_genome_size(matrix.presence(V.token_genes(spark, sf)))


@_query(f"{ORDERS} select genome, count(*) as genes from genes group by genome")
def genes_per_genome(spark, sf):
    return matrix.genes_per_genome(V.order_genes(spark, sf))


@_query(f"{TOKENS} select genome, count(distinct contig) as contigs from genes group by genome")
def contigs_per_genome(spark, sf):
    return matrix.contigs_per_genome(V.token_genes(spark, sf))


@_query(f"{TOKENS} select cluster, count(*) as genes, count(distinct genome) as genomes from genes group by cluster having count(*) > count(distinct genome)")
def paralog_clusters(spark, sf):
    return matrix.paralogs(V.token_genes(spark, sf))


@_query(f"{TOKENS} select cluster, support from sup, n where support / n >= 0.95")
def core_genes(spark, sf):
    return matrix.core_genes(matrix.presence(V.token_genes(spark, sf)))


@_query(f"{TOKENS} select cluster, support, md5(cluster) as digest from sup, n where support / n >= 0.95 order by digest, cluster limit 50")
def core_subset(spark, sf):
    return matrix.core_subset(matrix.presence(V.token_genes(spark, sf)), 50)


@_query(f"""{EVENTS} select cluster, genome, case when contains(cell, ';') then '' else cell end as cell, fragments from
  (select cluster, genome, string_agg(id, ';' order by id) as cell, count(*) as fragments from
  (select cluster, genome, cast(genome as varchar) || '_' || cast(contig as varchar) || '_' || cast(ix as varchar) as id from genes) group by cluster, genome)""")
def filter_pa(spark, sf):
    return matrix.filter_cells(matrix.cells(V.event_genes(spark, sf)))


_NAMES = "c as (select p_partkey as id, regexp_replace(p_brand || p_type, '[^A-Za-z0-9_~]', '', 'g') as clean from part), o as (select *, row_number() over (partition by lower(clean) order by id) as nth from c)"


@_query(f"with {_NAMES} select id, clean as name from o where clean <> '' and nth = 1 union all select id, 'group_' || cast(row_number() over (order by id) - 1 as varchar) from o where clean = '' or nth > 1")
def gene_names(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("annotation"))
    return matrix.gene_names(p)


_LEN = "x as (select doc_id as id, source as cluster, cast(length(text) as bigint) as length from documents), per as (select cluster, length, count(*) as n from x group by all), m as (select cluster, length as mode from (select *, row_number() over (partition by cluster order by n desc, length) as r from per) where r = 1)"


@_query(f"with {_LEN} select x.id, x.cluster, x.length, m.mode from x join m using (cluster) where abs(x.length - m.mode) > 0.05 * m.mode")
def length_outliers(spark, sf):
    return matrix.length_outliers(_lengths(spark, sf))


@_query(f"with {_LEN} select x.cluster, min(length) as min, max(length) as max, round(avg(length), 6) as mean, count(*) as n, any_value(m.mode) as mode from x join m using (cluster) group by x.cluster")
def length_statistics(spark, sf):
    return matrix.length_stats(_lengths(spark, sf))


def _lengths(spark, sf) -> DataFrame:
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.length("text").cast("bigint").alias("length"))


@_query("""with a as (select distinct p_type as cluster, regexp_replace(lower(p_name), '[0-9|_]', '', 'g') as a from part where lower(p_name) not in ('', 'hypothetical protein'))
  select cluster, count(*) - 1 as conflicts from a group by cluster""")
def annotation_conflicts(spark, sf):
    return matrix.annotation_conflicts(V.table(spark, sf, "part").select(F.col("p_type").alias("cluster"), F.col("p_name").alias("annotation")))


@_query(f"""{TOKENS}, meta as (select distinct source as genome, 'lang' as field, lang as value from documents),
  d as (select distinct cluster, field, value from members join meta using (genome)) select cluster, field, string_agg(value, ';' order by value) as values from d group by cluster, field""")
def metadata_by_node(spark, sf):
    meta = V.table(spark, sf, "documents").select(F.col("source").alias("genome"), F.lit("lang").alias("field"), F.col("lang").alias("value")).distinct()
    return matrix.metadata_by_cluster(matrix.presence(V.token_genes(spark, sf)), meta)


@_query("with x as (select p_type as gene, cast(sum(p_size) as bigint) as length from part group by p_type) select gene, length, cast(coalesce(sum(length) over (order by gene rows between unbounded preceding and 1 preceding), 0) as bigint) as start from x")
def running_offsets(spark, sf):
    return matrix.running_offsets(V.table(spark, sf, "part").groupBy(F.col("p_type").alias("gene")).agg(F.sum("p_size").cast("bigint").alias("length")))


# graph


@_query(f"{TEXT_GRAPH} select a, b, support from ed")
def edge_support(spark, sf):
    return graph.edges(graph.edge_members(V.token_genes(spark, sf)))


@_query(f"{TEXT_GRAPH} select sup.cluster, count(node) as degree from sup left join sym on node = cluster group by sup.cluster")
def node_degree(spark, sf):
    g = written(V.token_genes(spark, sf))
    return graph.degree(g.select("cluster").distinct(), graph.edges(graph.edge_members(g)))


@_query(f"""with {V.TOKENS}, e as (select cluster, lag(ix) over w as p, lead(ix) over w as n from genes window w as (partition by genome, contig order by ix))
  select cluster, count(*) as ends from e where p is null or n is null group by cluster""")
def contig_ends(spark, sf):
    return graph.contig_ends(V.token_genes(spark, sf))


def _round(i: int) -> str:
    """SQL of one trimming round on n{i}, e{i}."""
    return f"""s{i} as (select a as x from e{i} union all select b from e{i}), d{i} as (select cluster from n{i} left join s{i} on x = cluster where support < 3 group by cluster having count(x) <= 1),
  n{i + 1} as (select * from n{i} where cluster not in (select cluster from d{i})), e{i + 1} as (select * from e{i} where a not in (select cluster from d{i}) and b not in (select cluster from d{i}))"""


@_query(f"{TEXT_GRAPH}, n0 as (select * from sup), e0 as (select a, b from ed), {_round(0)}, {_round(1)} select cluster, support from n2")
def trim_two_rounds(spark, sf):
    g = written(V.token_genes(spark, sf))
    return graph.trim(written(matrix.support(matrix.presence(g))), written(graph.edges(graph.edge_members(g))), 3, 2)[0]


@_query(f"{TEXT_GRAPH}, n0 as (select * from sup), e0 as (select a, b from ed), {', '.join(map(_round, range(6)))} select cluster, support from n6")
def trim_to_fixpoint(spark, sf):
    """Two rounds are enough for the given tables; the SQL has six."""
    g = written(V.token_genes(spark, sf))
    return graph.trim(written(matrix.support(matrix.presence(g))), written(graph.edges(graph.edge_members(g))), 3, None, written)[0]


@_query(f"""{TEXT_GRAPH}, en as materialized (select distinct unnest([arg_min(cluster, ix), arg_max(cluster, ix)]) as cluster from genes group by genome, contig), low as materialized (select a, b, support from ed where support < 2),
  x as materialized (select low.a, low.b, low.support, sa.support as sa, sb.support as sb from low join sup sa on sa.cluster = low.a join sup sb on sb.cluster = low.b),
  y as materialized (select x.*, ea.cluster is not null as ea, eb.cluster is not null as eb from x left join en ea on ea.cluster = x.a left join en eb on eb.cluster = x.b)
  select a, b, support from ed where support >= 2 union all select a, b, support from y where not ea and not eb and support >= 0.05 * least(sa, sb)""")
def clean_edges(spark, sf):
    g = written(V.token_genes(spark, sf))
    return graph.clean_edges(matrix.support(matrix.presence(g)), graph.contig_ends(g), graph.edges(graph.edge_members(g)), 2)


_SV = """, st as (select a, b from ed where support >= {k}), ss as (select a as node, b as neighbour from st union all select b, a from st), cn as (select node from sym group by node having count(*) >= 3),
  inc as (select ss.node, ss.neighbour, em.genome from ss join em on em.a = least(ss.node, ss.neighbour) and em.b = greatest(ss.node, ss.neighbour) where ss.node in (select node from cn))
  select x.node as centre, x.neighbour as a, y.neighbour as b, count(*) as support from inc x join inc y on x.node = y.node and x.genome = y.genome and x.neighbour < y.neighbour group by all having count(*) >= {k}"""


@_query(ORDER_GRAPH + _SV.format(k=3))
def structural_variants(spark, sf):
    return graph.structural_variants(written(graph.edge_members(V.order_genes(spark, sf))), 3)


@_query(TEXT_GRAPH + _SV.format(k=8))
def structural_variants_text(spark, sf):
    return graph.structural_variants(written(V.token_edges(spark, sf)), 8)


@_query(f"""{TEXT_GRAPH}, near as (select distinct s.node as cluster, m.genome from sym s join members m on m.cluster = s.neighbour where s.node in (select cluster from sup where support >= 12))
  select near.cluster, near.genome from near anti join members m on m.cluster = near.cluster and m.genome = near.genome""")
def missing_with_neighbour(spark, sf):
    g = written(V.token_genes(spark, sf))
    return graph.missing_with_neighbour(written(matrix.presence(g)), graph.edge_members(g), 12)


_DEAD = "dead as (select cluster from sup where support < 20), sm as (select a as node, b as neighbour, genome from em union all select b, a, genome from em), live as (select * from sm where node in (select cluster from dead) and neighbour not in (select cluster from dead))"


@_query(f"""{ORDER_GRAPH}, {_DEAD}, o as (select a, b, genome from em where a not in (select cluster from dead) and b not in (select cluster from dead) union
  select x.neighbour, y.neighbour, x.genome from live x join live y on x.node = y.node and x.genome = y.genome and x.neighbour < y.neighbour) select a, b, count(*) as support from o group by a, b""")
def delete_node_bridges(spark, sf):
    g = written(V.order_genes(spark, sf))
    m = matrix.presence(g)
    return graph.edges(graph.delete_nodes(m, written(graph.edge_members(g)), matrix.support(m).where("support < 20").select("cluster"))[1])


_STRONG = "st as (select a, b from ed where support >= 5), sy as (select a as x, b as y from st union all select b, a from st)"


@_query(f"{ORDER_GRAPH}, {_STRONG}, h as (select cluster as source, cluster as node, 0 as hops from sup union select s.cluster, x.y, 1 from sup s join sy x on x.x = s.cluster union select s.cluster, z.y, 2 from sup s join sy x on x.x = s.cluster join sy z on z.x = x.y), "
        "b as (select source, node, min(hops) as hops from h group by source, node) select source, hops, count(*) as nodes from b group by source, hops")
def neighbourhood_support(spark, sf):
    g = written(V.order_genes(spark, sf))
    e = written(graph.edges(graph.edge_members(g)).where("support >= 5"))
    return graph.within(e, g.select("cluster").distinct(), 2).groupBy("source", "hops").agg(F.count("*").alias("nodes"))


@_query(f"{ORDER_GRAPH.replace('with ', 'with recursive ', 1)}, {_STRONG}, r as (select cluster as s, cluster as t from sup union select r.s, sy.y from r join sy on sy.x = r.t) select s as cluster, min(t) as component from r group by s")
def connected_components(spark, sf):
    g = V.order_genes(spark, sf)
    return graph.components(graph.edges(graph.edge_members(g)).where("support >= 5"), g.select("cluster").distinct(), written)


@_query(f"{ORDER_GRAPH.replace('with ', 'with recursive ', 1)}, {_STRONG}, r as (select cluster as source, cluster as node, 0 as hops from sup union select r.source, sy.y, hops + 1 from r join sy on sy.x = r.node where hops < 6) select source, node, min(hops) as hops from r group by source, node")
def shortest_hops(spark, sf):
    g = V.order_genes(spark, sf)
    return graph.within(written(graph.edges(graph.edge_members(g)).where("support >= 5")), g.select("cluster").distinct(), 6, written)


@_query("""with g as (select distinct lang, source as genome, unnest(regexp_extract_all(lower(text), '[a-z]+')) as cluster from documents),
  per as (select cluster, lang, count(distinct genome) as n from g group by cluster, lang) select cluster, count(*) as graphs, cast(sum(n) as bigint) as genomes, count(*) > 1 as paralog from per group by cluster""")
def merge_graphs(spark, sf):
    g = V.token_genes(spark, sf).join(V.table(spark, sf, "documents").select(F.col("doc_id").alias("contig"), "lang"), "contig")
    langs = [r[0] for r in V.table(spark, sf, "documents").select("lang").distinct().orderBy("lang").collect()]  # a row per graph
    return graph.merge_graphs([g.where(F.col("lang") == x).select("cluster", "genome") for x in langs])


@_query(f"""{ORDER_GRAPH.replace('with ', 'with recursive ', 1)}, {_STRONG}, r as (select cluster as s, cluster as t from sup union select r.s, sy.y from r join sy on sy.x = r.t), c as (select s as cluster, min(t) as component from r group by s),
  z as (select component, row_number() over (order by count(*) desc, component) as fragment from c group by component) select c.cluster, cast(fragment as integer) as fragment, cast(row_number() over (partition by fragment order by sup.support desc, c.cluster) as integer) as place from c join z using (component) join sup on sup.cluster = c.cluster""")
def component_order(spark, sf):
    g = written(V.order_genes(spark, sf))
    c = graph.components(graph.edges(graph.edge_members(g)).where("support >= 5"), g.select("cluster").distinct(), written)
    return graph.ordered_components(written(c), matrix.support(matrix.presence(g)))


@_query(f"{TOKENS}, {PREV} select least(p, cluster) as a, greatest(p, cluster) as b, genome, count(*) as times from prev where p is not null and p <> cluster group by all having count(*) > 3")
def repeated_edges(spark, sf):
    return graph.repeated_edges(V.token_genes(spark, sf))


# statistics

_MI = f"""{EVENTS}, s as (select cluster, support as s, n from sup, n where support < n),
  o as (select x.cluster as a, y.cluster as b, count(*) as n11 from members x join members y on x.genome = y.genome and x.cluster < y.cluster group by all),
  p as (select x.cluster as a, y.cluster as b, (coalesce(n11, 0) + 0.5) / (x.n + 2.0) as p11, (x.s - coalesce(n11, 0) + 0.5) / (x.n + 2.0) as p10,
    (y.s - coalesce(n11, 0) + 0.5) / (x.n + 2.0) as p01, (x.n - x.s - y.s + coalesce(n11, 0) + 0.5) / (x.n + 2.0) as p00
    from s x join s y on x.cluster < y.cluster left join o on o.a = x.cluster and o.b = y.cluster),
  mi as (select a, b, p11 * (ln(p11) - ln(p11 + p10) - ln(p11 + p01)) + p10 * (ln(p10) - ln(p11 + p10) - ln(p10 + p00))
    + p01 * (ln(p01) - ln(p01 + p00) - ln(p11 + p01)) + p00 * (ln(p00) - ln(p01 + p00) - ln(p10 + p00)) as mi from p)"""


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("mi", F.round("mi", 8) + 0.0)


def _mi(spark, sf) -> DataFrame:
    return stats.mutual_information(matrix.presence(V.event_genes(spark, sf)))


@_query(f"{_MI} select a, b, round(mi, 8) + 0.0 as mi from mi")
def mutual_information(spark, sf):
    return _rounded(_mi(spark, sf))


@_query(f"""{_MI}, b as (select max(mi) as m from mi group by a), q as (select quantile_cont(m, 0.25) as q1, quantile_cont(m, 0.75) as q3 from b)
  select a, b, round(mi, 8) + 0.0 as mi, case when mi > q3 + 3 * (q3 - q1) then 2 when mi > q3 + 1.5 * (q3 - q1) then 1 else 0 end as outlier from mi, q""")
def mi_outliers(spark, sf):
    return _rounded(stats.tukey(written(_mi(spark, sf))))


@_query(f"""{_MI}, t as (select quantile_cont(mi, 0.9) as t from mi), k as (select a, b, round(mi, 8) as mi from mi, t where mi - t >= -1e-4), y as (select a, b, mi from k union all select b, a, mi from k),
  w as (select distinct k.a, k.b from k join y x on x.a = k.a and k.mi < x.mi join y z on z.a = k.b and z.b = x.b and k.mi < z.mi) select k.a, k.b, k.mi + 0.0 as mi from k anti join w on w.a = k.a and w.b = k.b""")
def aracne(spark, sf):
    kept = written(stats.keep_quantile(written(_mi(spark, sf)), 0.9).withColumn("mi", F.round("mi", 8)))
    return _rounded(stats.aracne(kept))


@_query("select doc_id as sample, round(1.0 / count(*) over (partition by source, lang), 9) as weight from documents")
def cluster_weights(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("sample"), F.concat_ws("/", "source", "lang").alias("cluster"))
    return stats.cluster_weights(d).withColumn("weight", F.round("weight", 9))


@_query(f"""{TOKENS}, g as (select support as k, count(*) as g from sup group by support), t as (select count(distinct genome) * 1.0 as t from members where cluster in (select cluster from sup where support <= 10)),
  o as (select sum(g) * 1.0 as s, coalesce(sum(g) filter (k = 1), 0) * 1.0 as q1, coalesce(sum(g) filter (k = 2), 0) * 1.0 as q2, sum(case when k <= 10 then g else 0 end) * 1.0 as si, sum(case when k > 10 then g else 0 end) * 1.0 as sf,
    sum(case when k <= 10 then k * g else 0 end) * 1.0 as iq, sum(case when k <= 10 then k * (k - 1) * g else 0 end) * 1.0 as j from g), x as (select *, cast(n as double) as m, 1 - q1 / iq as c from o, t, n)
  select round(s, 4) as observed, round(s + (m - 1) / m * q1 * (q1 - 1) / (2 * (q2 + 1)), 4) as chao2, round(sf + si / c + q1 / c * greatest(si / c * t / (t - 1) * j / (iq * (iq - 1)) - 1, 0.0), 4) as ice,
    round(s + q1 * (m - 1) / m, 4) as jack1, round(s + q1 * (2 * m - 3) / m - q2 * (m - 2) * (m - 2) / (m * (m - 1)), 4) as jack2 from x""".replace("* 1.0 as", "::double as"))
def richness(spark, sf):
    return stats.richness(written(matrix.presence(V.token_genes(spark, sf))))


@_query(f"""{TOKENS}, g as (select support as k, count(*) as g from sup group by support), x as (select k, g, n, unnest(range(1, n + 1)) as s from g, n), lf as (select i, coalesce(sum(ln(greatest(i, 1))) over (order by i rows unbounded preceding), 0) as l from (select unnest(range(0, n + 1)) as i from n)),
  y as (select s, g, case when n - k >= s then exp(a.l - b.l - (c.l - b2.l)) else 0 end as absent, case when k >= s then exp(d.l - e.l - (c.l - b2.l)) else 0 end as every from x
   join lf a on a.i = greatest(n - k, 0) join lf b on b.i = greatest(n - k - s, 0) join lf c on c.i = n join lf b2 on b2.i = n - s join lf d on d.i = k join lf e on e.i = greatest(k - s, 0))
  select s as n_genomes, round(sum(g * (1 - absent)), 4) as pan, round(sum(g * every), 4) as core from y group by s""")
def pan_core_curve(spark, sf):
    return stats.pan_core_curve(written(matrix.presence(V.token_genes(spark, sf))))


@_query(f"""{ORDERS}, o as (select genome, row_number() over (order by genome) - 1 as slot from (select distinct genome from members)), d as (select n, unnest(range(2, n + 1)) as n_genomes from n), e as (select *, unnest(range(1, 101)) as boot from d), f as (select *, unnest(range(1, n_genomes + 1)) as i from e),
  h as (select distinct n_genomes, boot, cast('0x' || substr(md5('7-' || n_genomes || '-' || boot || '-' || i), 1, 8) as bigint) % n as slot from f), c as (select n_genomes, boot, count(distinct cluster) as c from h join o using (slot) join members using (genome) group by all)
  select n_genomes, round(quantile_cont(c, 0.025), 4) as low, round(avg(c), 4) as mean, round(quantile_cont(c, 0.975), 4) as high from c group by n_genomes""")
def accumulation_bootstrap(spark, sf):
    return stats.accumulation(matrix.presence(V.order_genes(spark, sf)))


@_query(f"""{ORDERS}, g as (select distinct genome from members), reps as (select unnest(range(1, 11)) as rep), o as (select rep, genome, row_number() over (partition by rep order by md5(rep || '-' || genome), genome) as place from g, reps),
  f as (select rep, cluster, min(place) as first from members join o using (genome) group by all), miss as (select rep, cluster, min(place) as gone from (select o.rep, o.place, o.genome, s.cluster from o, sup s) x anti join members m on m.cluster = x.cluster and m.genome = x.genome group by all)
  select o.rep, o.place as n_genomes, (select count(*) from f where f.rep = o.rep and f.first <= o.place) as pan, (select count(*) from f left join miss using (rep, cluster) where f.rep = o.rep and (gone is null or gone > o.place)) as core from o""")
def permuted_curves(spark, sf):
    return stats.permuted_curves(matrix.presence(V.order_genes(spark, sf)))


# sequences

_ACIDS = D.CODES[11][0]
_STARTS = ", ".join(f"'{s}'" for s in D.CODES[11][1])


def _protein(s: str, start: bool = True) -> str:
    """SQL of the protein of an upper-case sequence of A, C, G, T."""
    codon = f"substr('{_ACIDS}', 16 * (strpos('TCAG', substr({s}, i, 1)) - 1) + 4 * (strpos('TCAG', substr({s}, i + 1, 1)) - 1) + strpos('TCAG', substr({s}, i + 2, 1)), 1)"
    p = f"array_to_string([{codon} for i in range(1, length({s}) - 1, 3)], '')"
    return f"case when substr({s}, 1, 3) in ({_STARTS}) then 'M' || substr({p}, 2) else {p} end" if start else p


_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"


@_query(f"with {V.DNA} select record, {_protein('dna')} as protein from dna")
def translate_dna(spark, sf):
    return V.dna_records(spark, sf).select("record", D.translate_dna("dna").alias("protein"))


@_query(f"with {V.DNA} select record, {_RC.format('dna')} as dna from dna")
def reverse_complement(spark, sf):
    return V.dna_records(spark, sf).select("record", D.reverse_complement("dna").alias("dna"))


@_query(f"with {V.DNA}, p as (select record, dna, {_protein('dna')} as p from dna) select record, length(dna) % 3 = 0 and starts_with(p, 'M') and strpos(substr(p, 1, length(p) - 1), '*') = 0 as valid from p")
def valid_gene(spark, sf):
    return V.dna_records(spark, sf).select("record", D.valid_gene(F.col("dna"), D.translate_dna("dna")).alias("valid"))


@_query(f"with {V.DNA}, p as (select record, {_protein('dna')} as p from dna) select record, strpos(substr(p, 2, length(p) - 4), '*') > 0 as internal_stop from p")
def internal_stop(spark, sf):
    return V.dna_records(spark, sf).select("record", D.internal_stop(D.translate_dna("dna")).alias("internal_stop"))


_TARGET = _protein(f"substr({_RC.format('dna')}, 2)", False)
_K3 = "list_distinct([substr({0}, j, 3) for j in range(1, length({0}) - 1)])"


@_query(f"with {V.DNA}, t as (select record, dna, {_TARGET} as target from dna), f as (" + " union all ".join(f"select record, target, {i} as frame, {_protein(f'substr({x}, {i % 3 + 1})', False)} as protein from t" for i, x in enumerate(["dna"] * 3 + [_RC.format("dna")] * 3))
        + f"), s as (select record, frame, protein, cast(len(list_intersect({_K3.format('protein')}, {_K3.format('target')})) as integer) as shared from f) select record, shared, frame, protein from (select *, row_number() over (partition by record order by shared desc, frame) as r from s) where r = 1")
def six_frame_best(spark, sf):
    d = V.dna_records(spark, sf).withColumn("target", D.translate_dna(F.substring(D.reverse_complement("dna"), 2, 1 << 30), start=False))
    b = d.select("record", D.best_frame("dna", F.col("target")).alias("b"))
    return b.select("record", F.col("b.shared").alias("shared"), F.col("b.frame").alias("frame"), F.col("b.protein").alias("protein"))


_COLS = f"""with {V.DNA}, b as (select gene, unnest(range(0, length(dna))) as pos, unnest(string_split(lower(dna), '')) as base from dna),
  c as (select gene, pos, count(*) filter (base = 'a') as a, count(*) filter (base = 'c') as c, count(*) filter (base = 'g') as g, count(*) filter (base = 't') as t, count(*) filter (base not in ('a', 'c', 'g', 't')) as other from b group by gene, pos)"""


def _counts(spark, sf) -> DataFrame:
    return align.column_counts(V.dna_records(spark, sf).select("gene", F.col("dna").alias("aligned")))


@_query(f"{_COLS} select gene, cast(pos as integer) as pos, a, c, g, t, other from c")
def column_counts(spark, sf):
    return _counts(spark, sf)


_H = " + ".join(f"case when {x} > 0 then {x} / n * ln({x} / n) else 0.0 end" for x in "acgt")
_ENT = f"{_COLS}, n as (select *, cast(a + c + g + t + other as double) as n from c), e as (select gene, round(sum((1 - other / n) * -({_H})) / sum(1 - other / n), 6) as entropy from n group by gene)"


@_query(f"{_ENT} select gene, entropy from e")
def alignment_entropy(spark, sf):
    return align.entropy(_counts(spark, sf))


@_query(f"{_ENT}, q as (select quantile_cont(entropy, 0.25) as q1, quantile_cont(entropy, 0.75) as q3 from e) select gene, entropy from e, q where entropy <= round(greatest(0.01, q3 + 1.5 * (q3 - q1)), 9)")
def entropy_filter(spark, sf):
    return align.entropy_filter(align.entropy(_counts(spark, sf)))


@_query(f"""with {V.DNA}, d as (select distinct dna from dna), x as (select x.dna as a, y.dna as b, 1 - levenshtein(x.dna, y.dna) / 96.0 as identity from d x join d y on substr(x.dna, 1, 6) = substr(y.dna, 1, 6) and x.dna < y.dna)
  select a, b, round(cast(identity as double), 6) as identity from x""")
def pairwise_identity(spark, sf):
    d = V.dna_records(spark, sf).select("dna").distinct()
    return cluster.pairs_in_blocks(d.select(F.col("dna").alias("id"), F.col("dna").alias("seq"), F.substring("dna", 1, 6).alias("block")))


_SKETCH = """with w as (select source, regexp_extract_all(lower(text), '[a-z]+') as w from documents), k as (select distinct source, md5(array_to_string(w[i:i + 2], ' ')) as h from (select source, w, unnest(range(1, len(w) - 1)) as i from w)),
  s as (select source, h from (select *, row_number() over (partition by source order by h) as r from k) where r <= 1000)"""


@_query(f"""{_SKETCH}, z as (select x.source as a, y.source as b from (select distinct source from s) x join (select distinct source from s) y on x.source < y.source),
  u as (select a, b, s.h, count(*) as n from z join s on s.source = a or s.source = b group by all), r as (select *, row_number() over (partition by a, b order by h) as r from u),
  j as (select a, b, sum(case when n = 2 then 1 else 0 end)::double / count(*) as j from r where r <= 1000 group by a, b)
  select a, b, round(j, 9) as jaccard, round(case when j > 0 then -ln(2 * j / (1 + j)) / 3 else 1.0 end, 6) + 0.0 as distance from j""")
def kmer_jaccard_distance(spark, sf):
    return cluster.sketch_distances(cluster.word_sketches(V.texts(spark, sf, "documents", F.col("source").alias("genome"), "text"), 3, 1000), 3, 1000)


@_query("""with w as (select source as genome, regexp_extract_all(lower(text), '[a-z]+') as w from documents), d as (select distinct genome, array_to_string(w[i:i + 4], ' ') as k from (select genome, w, unnest(range(1, len(w) - 3)) as i from w)),
  q as (select item_id as ref, regexp_extract_all(lower(text), '[a-z]+') as w from benchmark), r as (select distinct ref, array_to_string(w[i:i + 4], ' ') as k from (select ref, w, unnest(range(1, len(w) - 3)) as i from q)),
  n as (select ref, count(*) as n from r group by ref), c as (select genome, ref, count(*) as shared from d join r using (k) group by all), o as (select genome, c.ref, shared, round(shared::double / n, 9) as containment, row_number() over (partition by genome order by shared desc, c.ref) as rank from c join n using (ref))
  select genome, ref, shared, containment, cast(rank as integer) as rank from o where rank <= 10""")
def containment_screen(spark, sf):
    d = V.texts(spark, sf, "documents", F.col("source").alias("genome"), "text")
    return cluster.containment(d, V.table(spark, sf, "benchmark").select(F.col("item_id").alias("ref"), "text"), 5, 10)


@_query(f"with hits as ({_SQL['containment_screen']}) select ref, count(*) as genomes, cast(sum(shared) as bigint) as shared from hits group by ref")
def hit_prevalence(spark, sf):
    return cluster.hit_prevalence(containment_screen(spark, sf))


@_query(f"with hits as ({_SQL['containment_screen']}) select genome, cast(sum(shared) as bigint) as hits from hits group by genome order by hits, genome limit 1")
def outgroup(spark, sf):
    return cluster.outgroup(containment_screen(spark, sf).withColumnRenamed("shared", "hits"))


@_query(f"{EVENTS} select genome, cast(contig as varchar) as contig, ix, genes.cluster, s.support from genes join sup s on s.cluster = genes.cluster where s.support < 100")
def extract_gene(spark, sf):
    g = V.event_genes(spark, sf)
    rare = matrix.support(matrix.presence(g)).where("support < 100")
    return g.join(rare, "cluster").select("genome", F.col("contig").cast("string").alias("contig"), "ix", "cluster", "support")


@_query(f"""{ORDERS}, p as (select cluster, genome, count(*) > 1 as paralog from genes group by all) select g.genome, g.contig, g.ix, 'ID=' || g.genome || '_' || g.contig || '_' || g.ix || ';cluster=' || g.cluster || case when paralog then ';paralog=true' else '' end as attributes from genes g join p using (cluster, genome)""")
def updated_annotations(spark, sf):
    g = V.order_genes(spark, sf)
    per = g.groupBy("cluster", "genome").agg((F.count("*") > 1).alias("paralog"))
    text = F.concat(F.lit("ID="), F.concat_ws("_", F.col("genome").cast("string"), F.col("contig").cast("string"), F.col("ix").cast("string")), F.lit(";cluster="), "cluster", F.when(F.col("paralog"), ";paralog=true").otherwise(""))
    return g.join(per, ["cluster", "genome"]).select("genome", "contig", "ix", text.alias("attributes"))


# correction, questions and models


@_query(f"{ORDER_GRAPH} select a, b, support from ed")
def integrate_genome(spark, sf):
    g = V.order_genes(spark, sf)
    old = g.where("genome <> 24")
    return graph.edges(correct.integrate(matrix.presence(old), graph.edge_members(old), g.where("genome = 24"))[1])


@_query(f"""{EVENTS}, {PREV}, {EM}, tw as (select cluster from (select cluster, count(*) as c, count(distinct genome) as g from genes group by cluster) where c > g),
  nm as (select cluster, min(case when cluster in (select cluster from tw) then cluster || '#' || genome || '_' || contig || '_' || ix else cluster end) as name from genes group by cluster)
  select least(x.name, y.name) as a, greatest(x.name, y.name) as b, support from ed join nm x on x.cluster = a join nm y on y.cluster = b""")
def merge_paralogs(spark, sf):
    g = written(correct.split_paralogs(V.event_genes(spark, sf)))
    n = correct.as_nodes(g)
    nodes = g.select("node", F.col("cluster").alias("centroid")).distinct()
    return graph.edges(correct.merge_paralogs(nodes, matrix.presence(n), graph.edge_members(n))[1])


@_query()
def collapse_paralogs(spark, sf):
    return correct.collapse_paralogs(V.event_genes(spark, sf))


@_query()
def collapse_families(spark, sf):
    m, em = matrix.presence(V.token_genes(spark, sf)), V.token_edges(spark, sf)
    return correct.collapse_families(m, em, correct.one_edit_apart(m.select("cluster").distinct()))[2]


@_query(f"""{TOKENS.replace('with ', 'with recursive ', 1)}, v as materialized (select distinct cluster, v from (select cluster, unnest([substr(cluster, 1, i - 1) || substr(cluster, i + 1) for i in range(1, length(cluster) + 1)] || [cluster]) as v from sup)),
  p as materialized (select distinct x.cluster as a, y.cluster as b from v x join v y on x.v = y.v and x.cluster < y.cluster where levenshtein(x.cluster, y.cluster) <= 1), sy as materialized (select a as x, b as y from p union all select b, a from p),
  r(k, c) using key (k) as (select cluster, cluster from sup union (select sy.y, min(r.c) from r join sy on sy.x = r.k join recurring.r z on z.k = sy.y where r.c < z.c group by sy.y)) select k as cluster, c as component from r""")
def single_linkage(spark, sf):
    words = written(V.token_genes(spark, sf).select("cluster").distinct())
    return graph.components(correct.one_edit_apart(words), words, written)


@_query()
def greedy_cluster(spark, sf):
    d = V.dna_records(spark, sf).groupBy(F.col("dna").alias("seq")).agg(F.min("record").alias("id"))
    return cluster.greedy(written(d), 0.9, 0.9, None, True)


@_query()
def gene_neighbourhood(spark, sf):
    em = written(graph.edge_members(V.order_genes(spark, sf)))
    target = em.agg(F.min("a")).first()[0]
    return query.neighbourhoods(em, target, 2, written)


@_query()
def infix_identity(spark, sf):
    d = V.dna_records(spark, sf).select(F.col("dna").alias("seq"), F.substring("dna", 1, 6).alias("block")).distinct()
    p = d.select("block", F.col("seq").alias("a")).join(d.select("block", F.col("seq").alias("b")), "block").where("a < b").select("a", F.substring("b", 20, 40).alias("b"))

    def run(batches):
        for x in batches:
            identity = kernels.infix_identities(x.column("a"), x.column("b"), True)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(identity)], names=["a", "b", "identity"])

    prepared(spark)
    return p.mapInArrow(run, "a string, b string, identity double")


@_query(f"with {V.DNA} select record, {_RC.format('substr(dna, 30, 40)')} as sequence, cast(29 as integer) as start, cast(-1 as integer) as strand from dna")
def search_dna(spark, sf):
    """Each record's bases 30 to 69, turned round, are found where they were taken from."""
    d = V.dna_records(spark, sf).select("record", F.col("dna").alias("window"), D.reverse_complement(F.substring("dna", 30, 40)).alias("query"))

    def run(batches):
        for x in batches:
            hits = [kernels.search_dna(w, q, 0.5, 0.9) for w, q in zip(x["window"], x["query"], strict=True)]
            x["sequence"], x["start"], x["strand"] = [h[0] if h else None for h in hits], [h[1][0] if h else -1 for h in hits], [h[2] if h else 0 for h in hits]
            yield x[["record", "sequence", "start", "strand"]]

    prepared(spark)
    return d.mapInPandas(run, "record bigint, sequence string, start int, strand int")


@_query()
def gain_fit(spark, sf):
    """Infinitely many genes: the coalescent's best fit to the spectrum, and its curves."""
    s = {r["k"]: r["genes"] for r in matrix.spectrum(matrix.presence(V.token_genes(spark, sf))).collect()}  # a row per number of genomes
    n = max(s)
    x, error = models.fit_gains(np.array([float(s.get(k, 0)) for k in range(1, n + 1)]))
    pan, core = models.coalescent_curves(n, [(x[0], x[1])], x[2])
    return spark.createDataFrame([(i + 1, float(pan[i]), float(core[i]), float(error)) for i in range(n)], "n_genomes int, pan double, core double, error double")


@_query()
def finite_fit(spark, sf):
    """Finitely many genes on a caterpillar tree of the genomes."""
    m = matrix.presence(V.order_genes(spark, sf))
    names = sorted(str(r[0]) for r in m.select("genome").distinct().collect())  # a row per genome
    text = names[0] + ":1"
    for x in names[1:]:
        text = f"({text},{x}:1):1"
    fit = models.fit_finite(spark, m, models.parse_newick(text + ";"), 20)
    flat = [(k if i is None else f"{k}_{('low', 'high')[i]}", float(x)) for k, v in fit.items() for i, x in (enumerate(v) if isinstance(v, list) else [(None, v)])]
    return spark.createDataFrame(flat, "parameter string, value double")


@_query()
def genome_map(spark, sf):
    """Coordinates of genomes from their distances."""
    rows = kmer_jaccard_distance(spark, sf).collect()  # genomes squared
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    d = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = names.index(r["a"]), names.index(r["b"])
        d[i, j] = d[j, i] = r["distance"]
    x = models.multidimensional_scaling(d)
    return spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in zip(names, x, strict=True)], "genome string, x double, y double")
