"""Queries over the tables of a data folder, one or more for each operator, with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohesia.functions import canonical, seconds
from cohesia.index import Index
from cohesia.operators import analysis, components, coreness, graph, hierarchy, search, workload
from cohesia.plans.graphs import copurchase, customer_supplier, order_queries, raw_copurchase
from cohesia.plans.oracle import with_answers, with_comp, with_core, with_graph, with_tree
from cohesia.sources import binary, readers, writers
from cohesia.storage import cut, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Graph preparation


@query(with_graph("select u, v from e0"))
def canonical_edges(spark, d):
    return copurchase(spark, d)


@query(with_graph("select u as src, v as dst from e"))
def symmetric_edges(spark, d):
    return graph.symmetric(copurchase(spark, d))


@query("select distinct unnest([l_partkey, l_suppkey]) as orig from lineitem")
def vertex_set(spark, d):
    return graph.vertex_set(spark.read.parquet(f"{d}/lineitem.parquet"), "l_partkey", "l_suppkey")


@query(with_graph("select row_number() over (order by u) - 1 as id, u as orig from (select distinct u from e)"))
def dense_ids(spark, d):
    return graph.dense_ids(graph.vertex_set(copurchase(spark, d)))


@query(with_graph(", m as (select row_number() over (order by u) - 1 as id, u as orig from (select distinct u from e)) select a.id u, b.id v from e0 join m a on a.orig = e0.u join m b on b.orig = e0.v"))
def relabel_edges(spark, d):
    edges = cut(copurchase(spark, d))
    return graph.relabel(edges, graph.dense_ids(graph.vertex_set(edges)))


@query(with_graph("select u as id, count(*) as degree from e group by u"))
def degree(spark, d):
    return graph.degree(graph.symmetric(copurchase(spark, d)))


RAW = "raw as (select a.l_partkey u, b.l_partkey v from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey where a.l_quantity > 45 and b.l_quantity > 45)"


@query(f"with {RAW} select id, count(*) as degree from (select u id from raw union all select v from raw) group by id")
def degree_multiset(spark, d):
    return graph.degree_multiset(raw_copurchase(spark, d, 45))


@query(with_graph(", g as (select u id, count(*) degree from e group by u), r as (select degree, row_number() over (order by degree) - 1 i, count(*) over () n from g) select id, degree from g where degree >= (select min(degree) from r where i >= round_even(0.99 * (n - 1), 0))"))
def high_degree_p99(spark, d):
    return workload.high_degree(graph.degree(graph.symmetric(cut(copurchase(spark, d)))))


@query(with_graph(", top as (select u id from e group by u order by count(*) desc, u limit 10), h1 as (select distinct v id from e join top on e.u = top.id), h2 as (select distinct v id from e join h1 on e.u = h1.id), a as (select id, 0 hop from top union all select id, 1 from h1 union all select id, 2 from h2) select id, min(hop)::int as hop from a group by id"))
def k_hop(spark, d):
    edges = cut(copurchase(spark, d))
    adj = graph.symmetric(edges)
    return graph.k_hop(adj, workload.ranked_singletons(graph.degree(adj), 10).select("id"), 2)


@query(with_core("select distinct id from (select id from core where core = (select max(core) from core) union all select e.v from e join core on core.id = e.u where core.core = (select max(core) from core))"))
def closed_neighborhood(spark, d):
    x = Index(copurchase(spark, d))
    top = x.core.agg(F.max("core").alias("core"))
    return graph.closed_neighbourhood(x.adj, x.core.join(top, "core").select("id"))


@query(with_graph(", m as (select distinct l_partkey id from lineitem where l_quantity > 49) select u, v from e0 where u in (select id from m) and v in (select id from m)"))
def induced_subgraph(spark, d):
    parts = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return graph.induced(copurchase(spark, d), parts)


@query(with_graph(", cc(it, id, lab) as (select 0, u, u from (select distinct u from e) union all select it + 1, id, nl from (select it, id, nl, bool_or(nl < lab) over () chg from (select a.it, a.id, a.lab, least(a.lab, min(b.lab)) nl from cc a join e on e.u = a.id join cc b on b.id = e.v group by a.it, a.id, a.lab)) where chg) select id, min(lab) as component from cc group by id"))
def connected_components(spark, d):
    return components.connected_components(copurchase(spark, d), "u", "v", components.SMALL)


@query(ORACLES["connected_components"])
def connected_components_rounds(spark, d):
    """By rounds, whatever the size."""
    return components.connected_components(copurchase(spark, d), "u", "v")


@query(with_graph("select id from (select distinct u id from e) where id not in (select l_partkey from lineitem where l_quantity > 49)"))
def set_difference(spark, d):
    parts = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_partkey").alias("orig"))
    return graph.vertex_set(copurchase(spark, d)).join(parts, "orig", "left_anti").withColumnRenamed("orig", "id")


# Core decomposition and hierarchy


@query(with_core("select id, core from core"))
def coreness_copurchase(spark, d):
    return coreness.coreness(graph.symmetric(copurchase(spark, d)))


@query(with_core("select id, core from core", 40))
def coreness_rounds(spark, d):
    """The way for tables of any size, whatever the size."""
    return coreness.coreness(graph.symmetric(copurchase(spark, d, 40)), small=0)


DEEP = with_core("select id, core from core")
DEEP = "with recursive\ne0 as (select distinct -l_suppkey - 1 u, o_custkey v from lineitem join orders on o_orderkey = l_orderkey)," + DEEP[DEEP.index("\ne as (") :]


@query(DEEP)
def coreness_deep(spark, d):
    return coreness.coreness(graph.symmetric(customer_supplier(spark, d)))


@query()
def kcore_components_deep(spark, d):
    """Components of every level of the graph of all order lines; its SQL takes too long on whole tables, so a small graph is compared with brute force."""
    return Index(customer_supplier(spark, d)).comp


@query()
def max_core_community_deep(spark, d):
    """The community of every customer and supplier over all order lines, tested in the same way."""
    x = Index(customer_supplier(spark, d))
    return search.max_core_community(_singles(x), x.members)


@query(with_core("select core, count(*) as nvert from core group by core"))
def core_histogram(spark, d):
    return coreness.core_histogram(Index(copurchase(spark, d)).core)


@query(with_core("select id from core where core = (select max(core) from core)"))
def k_shell_top(spark, d):
    core = Index(copurchase(spark, d)).core
    return core.join(core.agg(F.max("core").alias("core")), "core").select("id")


@query(with_core("select id from core where core = 2"))
def k_shell(spark, d):
    return coreness.k_shell(Index(copurchase(spark, d)).core, 2)


@query(with_core("select u, v, w from w where u < v"))
def edge_weight_min_core(spark, d):
    return Index(copurchase(spark, d)).weights


@query(with_core("select u, v from w where u < v and w >= 2"))
def k_core_edges(spark, d):
    return coreness.k_core(Index(copurchase(spark, d)).weights, 2)


@query(with_comp("select k, id, label from comp"))
def kcore_components(spark, d):
    return Index(copurchase(spark, d)).comp


@query(with_comp("select k, id, label from comp", 40))
def kcore_components_rounds(spark, d):
    """Spanning forest and labels by rounds, whatever the size."""
    x = Index(copurchase(spark, d, 40))
    return hierarchy.components_by_level(x.edges, x.core, x.weights, small=0)


@query(with_comp("select k, count(distinct label) as ncomm, count(*) as nvert from comp group by k"))
def component_counts_by_k(spark, d):
    return Index(copurchase(spark, d)).comp.groupBy("k").agg(F.countDistinct("label").alias("ncomm"), F.count("*").alias("nvert"))


@query(with_comp("select sum(c.n)::bigint as edges, sum(c.n * c.k)::bigint as weight from (select k, count(*) - count(distinct label) m, (count(*) - count(distinct label)) - coalesce(lag(count(*) - count(distinct label)) over (order by k desc), 0) n from comp group by k) c"))
def maximum_spanning_forest(spark, d):
    """Number of edges and total weight, which are the same for every maximum spanning forest."""
    forest = hierarchy.maximum_spanning_forest(Index(copurchase(spark, d)).weights)
    return forest.agg(F.count("*").alias("edges"), F.sum("w").cast("long").alias("weight"))


@query(with_tree("select core, label, parent_core, parent_label, depth, size from nodes"))
def shell_nodes(spark, d):
    return Index(copurchase(spark, d)).nodes


@query(with_tree("select core, label, parent_core, parent_label, depth, size from nodes", 40))
def shell_nodes_dense(spark, d):
    return Index(copurchase(spark, d, 40)).nodes


@query(with_tree("select id, core, label from members"))
def shell_members(spark, d):
    return Index(copurchase(spark, d)).members


@query(with_tree("select core, label, anc_core, anc_label from anc"))
def shell_ancestors(spark, d):
    return Index(copurchase(spark, d)).ancestors


@query(with_tree("select parent_core, parent_label, count(*) as nchild from nodes where parent_core <> core or parent_label <> label group by parent_core, parent_label"))
def shell_children(spark, d):
    nodes = Index(copurchase(spark, d)).nodes.select(F.struct("core", "label").alias("node"), F.struct(F.col("parent_core").alias("core"), F.col("parent_label").alias("label")).alias("parent"))
    return graph.children(nodes).groupBy("parent").agg(F.count("*").alias("nchild")).select(F.col("parent.core").alias("parent_core"), F.col("parent.label").alias("parent_label"), "nchild")


@query(with_tree("select n.core, n.label, c.id from nodes0 n join comp c on c.k = n.core and c.label = n.label"))
def subtree_vertices(spark, d):
    x = Index(copurchase(spark, d))
    return hierarchy.subtree_vertices(x.ancestors, x.members)


@query(with_tree("select r.core, count(n.label) as ncomm, coalesce(sum(n.size), 0)::bigint as nvert from (select unnest(range(0, (select max(core) + 1 from nodes)))::int core) r left join nodes n on n.core = r.core group by r.core"))
def core_profile(spark, d):
    return hierarchy.core_profile(Index(copurchase(spark, d)).nodes)


@query(with_core("select core, nvert, sum(nvert) over (order by core)::bigint as upto from (select core, count(*) nvert from core group by core)"))
def shell_offsets(spark, d):
    """Prefix sums of the sizes of the shells."""
    sizes = coreness.core_histogram(Index(copurchase(spark, d)).core)
    return sizes.withColumn("upto", F.sum("nvert").over(Window.orderBy("core")))


@query(with_core("select id, row_number() over (order by core, id) - 1 as rank from core"))
def coreness_rank(spark, d):
    return graph.numbered(Index(copurchase(spark, d)).core, ["core", "id"], "rank").select("id", "rank")


# Search


def _singles(x: Index) -> DataFrame:
    return x.core.select(F.col("id").alias("query_id"), F.lit(0).alias("kmin"), "id")


@query(with_tree("select id as query_id, core as k, label from members"))
def max_core_community(spark, d):
    x = Index(copurchase(spark, d))
    return search.max_core_community(_singles(x), x.members)


@query(with_comp("select id as query_id, 2::int as k, case when core >= 2 then 2 end::int as level, label from core left join (select * from comp where k = 2) using (id)"))
def fixed_k_community(spark, d):
    x = Index(copurchase(spark, d))
    return search.fixed_k_community(x.core.select(F.col("id").alias("query_id"), "id", F.lit(2).alias("k")), x.comp, x.core)


@query(with_tree("select id as query_id, core as k, core as level, label from members"))
def default_k_community(spark, d):
    x = Index(copurchase(spark, d))
    return search.fixed_k_community(x.core.select(F.col("id").alias("query_id"), "id", F.lit(-1).alias("k")), x.comp, x.core)


@query(with_answers("select query_id, found, k from answers"))
def multi_query_kstar(spark, d):
    x = Index(copurchase(spark, d))
    return search.multi_search(order_queries(spark, d), x.comp, x.core).select("query_id", "found", "k")


@query(with_answers("select query_id, found, k, any_label as label from answers"))
def multi_query_answers(spark, d):
    x = Index(copurchase(spark, d))
    return search.multi_search(order_queries(spark, d).withColumn("kmin", F.lit(0)), x.comp, x.core)


@query(with_answers("select query_id, found, k, label from answers"))
def kmin_filtered_answers(spark, d):
    x = Index(copurchase(spark, d))
    return search.multi_search(order_queries(spark, d), x.comp, x.core)


@query(with_answers("select query_id, found, k, label from answers"))
def shell_lca(spark, d):
    """The same batch through the shell tree."""
    x = Index(copurchase(spark, d))
    return search.index_search(order_queries(spark, d), x.members, x.ancestors, x.core)


@query(with_answers("select comp.k, comp.label, comp.id from comp join (select distinct k, label from answers where label is not null) a on a.k = comp.k and a.label = comp.label"))
def multi_query_communities(spark, d):
    x = Index(copurchase(spark, d))
    return search.communities(search.multi_search(order_queries(spark, d), x.comp, x.core), x.comp)


@query(with_answers("select query_id, found, k, label, comm_id from answers left join (select k, label, row_number() over (order by k desc, label) - 1 as comm_id from (select distinct k, label from answers where label is not null)) using (k, label)"))
def community_numbers(spark, d):
    x = Index(copurchase(spark, d))
    return search.community_ids(search.multi_search(order_queries(spark, d), x.comp, x.core))


@query(with_comp("select a.k, a.label, e0.u, e0.v from e0 join comp a on a.id = e0.u join comp b on b.id = e0.v and a.k = b.k and a.label = b.label"))
def community_edge_list(spark, d):
    """Edges inside the components of every level."""
    x = Index(copurchase(spark, d))
    return search.community_edges(x.edges, x.comp)


def _local(spark, d):
    """Local searches from the hundred vertices of highest degree, each for its core number."""
    edges = cut(copurchase(spark, d))
    adj = graph.symmetric(edges)
    asked = workload.ranked_singletons(graph.degree(adj), 100).select(F.col("id").alias("query_id"), "id", F.lit(1).alias("k"))
    return search.local_search(asked, edges, adj)


TOP = ", top as (select u id from e group by u order by count(*) desc, u limit 100)"


@query(with_comp(TOP + " select top.id as query_id, core::int as k from top join core using (id)"))
def local_kcore(spark, d):
    return _local(spark, d)[0].select("query_id", "k")


@query(with_comp(TOP + " select top.id as query_id, b.id from top join core using (id) join comp a on a.id = top.id and a.k = core.core join comp b on b.k = a.k and b.label = a.label"))
def local_kcore_communities(spark, d):
    return _local(spark, d)[1]


@query()
def local_kcore_visited(spark, d):
    """Vertices that each local search entered; what the bounds spare has no twin in SQL."""
    return _local(spark, d)[0]


@query(with_graph(", m as (select row_number() over (order by u) - 1 as id, u as orig from (select distinct u from e)), " + "t as (select u id, count(*) degree from e group by u) select m.orig as id, degree from m join t on t.id = m.orig"))
def original_ids(spark, d):
    """Degrees found in dense ids, back in original ids."""
    edges = cut(copurchase(spark, d))
    vertices = cut(graph.dense_ids(graph.vertex_set(edges)))
    degrees = graph.degree(graph.symmetric(graph.relabel(edges, vertices)))
    return graph.restore(degrees, vertices).select("id", "degree")


# Workloads and analysis


@query(with_graph("select row_number() over (order by degree desc, id) - 1 as rank, id, degree from (select u id, count(*) degree from e group by u order by count(*) desc, u limit 100)"))
def workload_singletons(spark, d):
    return workload.ranked_singletons(graph.degree(graph.symmetric(copurchase(spark, d))), 100)


@query(with_graph(", top as (select u id from e group by u order by count(*) desc, u limit 10) select top.id as query_id, list(e.v order by e.v)::bigint[] as q from top join e on e.u = top.id group by top.id"))
def workload_sets(spark, d):
    adj = graph.symmetric(cut(copurchase(spark, d)))
    return workload.neighbour_sets(adj, workload.ranked_singletons(graph.degree(adj), 10))


@query(with_graph(", top as (select u id from e group by u order by count(*) desc, u limit 10), r as (select top.id, e.v, row_number() over (partition by top.id order by e.v) i from top join e on e.u = top.id) select id as query_id, list(v order by v)::bigint[] as q from r where i <= 5 group by id"))
def workload_sampled_sets(spark, d):
    adj = graph.symmetric(cut(copurchase(spark, d)))
    return workload.neighbour_sets(adj, workload.ranked_singletons(graph.degree(adj), 10), 5)


def _sampled(size: int, seed: int, high: bool) -> str:
    """Query text: vertices sampled by the MD5 of seed and id, of the top percent by degree or of all."""
    limit = ", g as (select u id, count(*) degree from e group by u), r as (select degree, row_number() over (order by degree) - 1 i, count(*) over () n from g)"
    where = "where degree >= (select min(degree) from r where i >= round_even(0.99 * (n - 1), 0))" if high else ""
    return f"{limit}, picked as (select id, row_number() over (order by md5('{seed}:' || id), id) - 1 as place from g {where} order by place limit {size})"


def _workload(name: str, size: int, seed: int, high: bool, k: int | None) -> None:
    """Register ``size`` seeded singleton queries."""

    def f(spark, d):
        return workload.singletons(graph.degree(graph.symmetric(cut(copurchase(spark, d)))), size, seed, high=high, k=k)

    f.__name__ = name
    query(with_graph(_sampled(size, seed, high) + f" select place as query_id, {'null' if k is None else k}::int as kmin, [id]::bigint[] as q from picked"))(f)


_workload("workload_random", 50, 1337, False, 10)
for _n in (1, 10, 100):
    _workload(f"workload_high_{_n}", _n, 1234, True, None)
    _workload(f"workload_rand_{_n}", _n, 5678, False, None)


def _high_roots(adj: DataFrame) -> DataFrame:
    return workload.sample(workload.high_degree(graph.degree(adj)), 10, 1234).select("id")


@query(with_graph(_sampled(10, 1234, True) + " select picked.id as query_id, list(e.v order by e.v)::bigint[] as q from picked join e on e.u = picked.id group by picked.id"))
def workload_high_sets(spark, d):
    """All neighbours of ten roots sampled from the top percent by degree."""
    adj = graph.symmetric(cut(copurchase(spark, d)))
    return workload.neighbour_sets(adj, _high_roots(adj))


@query(
    with_graph(
        _sampled(10, 1234, True)
        + ", near as (select picked.id, e.v, row_number() over (partition by picked.id order by md5('5678:' || picked.id || ':' || e.v), e.v) i from picked join e on e.u = picked.id) select id as query_id, list(v order by v)::bigint[] as q from near where i <= 5 group by id"
    )
)
def workload_high_sampled_sets(spark, d):
    """Five sampled neighbours of each of the same roots."""
    adj = graph.symmetric(cut(copurchase(spark, d)))
    return workload.neighbour_sets(adj, _high_roots(adj), 5, 5678)


SIZES = ", nb as (select k, label, id from comp union select c.k, c.label, e.v from comp c join e on e.u = c.id) select k, label, nodes, nbrhood from (select k, label, count(*) nodes from comp group by k, label) join (select k, label, count(*) nbrhood from nb group by k, label) using (k, label)"


@query(with_comp(SIZES))
def community_sizes(spark, d):
    x = Index(copurchase(spark, d))
    return analysis.community_sizes(x.comp, x.adj)


@query(
    with_tree(
        ", sz as (select k, label, count(*) n from comp group by k, label), two as (select id, label from comp where k = 2) "
        "select m.id as query_id, case when two.label is null then 1.0 else 1 - (select count(*) from comp a join comp b on a.id = b.id and a.k = m.core and a.label = m.label and b.k = 2 and b.label = two.label) "
        "/ (s1.n + s2.n - (select count(*) from comp a join comp b on a.id = b.id and a.k = m.core and a.label = m.label and b.k = 2 and b.label = two.label))::double end as distance "
        "from members m left join two on two.id = m.id left join sz s1 on s1.k = m.core and s1.label = m.label left join sz s2 on s2.k = 2 and s2.label = two.label"
    )
)
def jaccard_distance(spark, d):
    """For every vertex, the distance between its community at its own core number and that at k = 2."""
    x = Index(copurchase(spark, d))
    own = search.max_core_community(_singles(x), x.members)
    two = search.fixed_k_community(x.core.select(F.col("id").alias("query_id"), "id", F.lit(2).alias("k")), x.comp, x.core)
    return analysis.jaccard_of_answers(own, two.select("query_id", F.coalesce("level", F.lit(0)).alias("k"), "label"), x.comp)


@query(with_answers("select query_id, case when k > 0 and any_label is not null and label is null then 1.0 else 0.0 end::double as d12, 0.0::double as d13, case when k > 0 and any_label is not null and label is null then 1.0 else 0.0 end::double as d23 from answers"))
def agreement(spark, d):
    """Three implementations of one batch: components with the kmin rule, components without it, and the shell tree with it."""
    x = Index(copurchase(spark, d))
    batch = order_queries(spark, d)
    with_rule = cut(search.multi_search(batch, x.comp, x.core))
    without = cut(search.multi_search(batch.withColumn("kmin", F.lit(0)), x.comp, x.core))
    tree = cut(search.index_search(batch, x.members, x.ancestors, x.core))
    return analysis.agreement(with_rule, without, tree, x.comp)


@query("with a as (select distinct l_orderkey k, l_partkey id from lineitem where l_quantity > 25), b as (select distinct l_orderkey k, l_partkey id from lineitem where l_discount > 0.04), j as (select coalesce(a.k, b.k) k, count(*) filter (a.id is not null and b.id is not null) i, count(*) u from a full join b on a.k = b.k and a.id = b.id group by 1) select k as l_orderkey, 1 - i / u::double as distance from j")
def set_overlap(spark, d):
    """Distance of two result sets for each key, over whole tables."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("id", F.col("l_partkey"))
    return analysis.jaccard_of_sets(lines.where("l_quantity > 25"), lines.where("l_discount > 0.04"), ["l_orderkey"])


# Files


@query(with_graph("select u, v from e0"))
def edge_file_round_trip(spark, d):
    path = new_path(spark, "edges-csv")
    writers.edges_csv(copurchase(spark, d), path, ";", True)
    return readers.delimited_edges(spark, path, ";", True).select(*canonical("u", "v"))


@query("select row_number() over (order by l_orderkey) - 1 as query_id, least(count(distinct l_partkey), 3)::int as kmin, list(distinct l_partkey order by l_partkey)::bigint[] as q from lineitem where l_quantity > 40 group by l_orderkey")
def query_file_round_trip(spark, d):
    """Queries written one a line into a folder of files and read back, numbered by their lines."""
    path = new_path(spark, "queries")
    writers.queries_text(order_queries(spark, d), path)
    return readers.query_file(spark, path)


@query(with_graph(", m as (select row_number() over (order by u) - 1 as id, u as orig from (select distinct u from e)) select a.id as src, b.id as dst from e join m a on a.orig = e.u join m b on b.orig = e.v"))
def binary_round_trip(spark, d):
    """Adjacency over dense ids written to one binary file and read back by ranges."""
    edges = cut(copurchase(spark, d))
    vertices = cut(graph.dense_ids(graph.vertex_set(edges)))
    path = new_path(spark, "adjacency")
    binary.write_adjacency(cut(graph.symmetric(graph.relabel(edges, vertices))), vertices.count(), path)
    return binary.adjacency_file(spark, path)


@query(with_core("select row_number() over (order by id) - 1 as id, core::bigint as core from core"))
def positional_round_trip(spark, d):
    """Core numbers of dense ids written one a line into a folder of files and read back by their places."""
    x = Index(copurchase(spark, d))
    path = new_path(spark, "positions")
    writers.positional_text(x.core, "core", path)
    return readers.positional(spark, path, "core")


@query(
    with_tree(
        "select 'core' as part, id as a, core::bigint as b, null::bigint as c, null::bigint as d, null::int as depth, null::bigint as size from core "
        "union all select 'comp', k, id, label, null, null, null from comp union all select 'members', id, core, label, null, null, null from members "
        "union all select 'ancestors', core, label, anc_core, anc_label, null, null from anc union all select 'nodes', core, label, parent_core, parent_label, depth, size from nodes"
    )
)
def index_round_trip(spark, d):
    """All tables of an index, written and read back, one below the other."""
    path = new_path(spark, "index")
    writers.save_index(Index(copurchase(spark, d)).tables(), path)
    out = None
    for name, table in readers.load_index(spark, path).items():
        keys = [c for c in table.columns if c not in ("depth", "size")]
        four = [F.col(c).cast("long").alias(x) for c, x in zip(keys, "abcd", strict=False)] + [F.lit(None).cast("long").alias(x) for x in "abcd"[len(keys) :]]
        rest = [(F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in (("depth", "int"), ("size", "long"))]
        part = table.select(F.lit(name).alias("part"), *four, *rest)
        out = part if out is None else out.unionAll(part)
    return out


@query("select o_orderkey as file, ((o_orderkey % 100) * 3600 + (o_custkey % 60) * 60 + (o_orderkey % 60) + 0.5)::double as time from orders")
def wall_clock_times(spark, d):
    """Clock lines written for every order, parsed back to seconds."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    clock = F.concat_ws(":", F.col("o_orderkey") % 100, F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit(".5")))
    text = F.concat(F.lit("Elapsed (wall clock) time (h:mm:ss or m:ss): "), clock)
    noise = F.lit("Maximum resident set size (kbytes): 1024")
    lines = orders.select(F.col("o_orderkey").alias("file"), F.explode(F.array(noise, text)).alias("value"))
    return readers.wall_clock(lines)


@query("select ((s_suppkey % 100) * 3600 + (s_nationkey % 60) * 60 + (s_suppkey % 60) + 0.5)::double as time, count(*) as n from supplier group by all")
def wall_clock_log_files(spark, d):
    """The same read from a folder of log files, one for every supplier."""
    suppliers = spark.read.parquet(f"{d}/supplier.parquet")
    two = lambda c: F.lpad((F.col(c) % 60).cast("string"), 2, "0")
    clock = F.concat_ws(":", F.col("s_suppkey") % 100, two("s_nationkey"), F.concat(two("s_suppkey"), F.lit(".5")))
    path = new_path(spark, "logs")
    lines = F.array(F.lit("Maximum resident set size (kbytes): 1024"), F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock))
    suppliers.select("s_suppkey", F.array_join(lines, "\n").alias("value")).write.partitionBy("s_suppkey").text(path)
    return readers.wall_clock_files(spark, f"{path}/*").groupBy("time").agg(F.count("*").alias("n"))


@query("select n_name as network, 'search' as op, (n_nationkey * 1.5)::double as a, (n_regionkey * 60)::double as b from nation")
def timing_table(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    a = nation.select(F.col("n_name").alias("network"), F.lit("search").alias("op"), F.lit("a").alias("impl"), (F.col("n_nationkey") * 1.5).alias("time"))
    b = nation.select(F.col("n_name").alias("network"), F.lit("search").alias("op"), F.lit("b").alias("impl"), seconds(F.concat(F.col("n_regionkey").cast("string"), F.lit(":00"))).alias("time"))
    return analysis.timing_table(a.unionAll(b))
