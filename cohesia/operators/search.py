"""Community search: the largest k for which all query vertices lie in one component of the k-core, and that component.

Query batches are frames ``(query_id, kmin, q array<long>)``.  Answers are normalised: ``answers(query_id, found, k, label)`` names a
component by its level and smallest vertex, and ``communities(k, label, id)`` lists each named component once, however many queries share it.
An empty answer has a null label: unknown vertex, disconnected query, k of 0, or k below kmin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.coreness import SMALL as PEELED
from cohesia.operators.coreness import coreness, edge_weights, lower, peel
from cohesia.operators.graph import numbered, symmetric
from cohesia.operators.hierarchy import components_by_level
from cohesia.storage import cut


def query_vertices(queries: DataFrame) -> DataFrame:
    """``(query_id, id)``, each vertex of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct("q")).alias("id"))


def _complete(queries: DataFrame, best: DataFrame, core: DataFrame) -> DataFrame:
    """Rows for all queries; ``best(query_id, k, label)`` before the kmin rule."""
    known = query_vertices(queries).join(core, "id").groupBy("query_id").agg(F.count("*").alias("known"))
    rows = queries.select("query_id", F.coalesce("kmin", F.lit(0)).alias("kmin"), F.size(F.array_distinct("q")).alias("n"))
    rows = rows.join(known, "query_id", "left").join(best, "query_id", "left")
    found = (F.col("n") > 0) & (F.coalesce("known", F.lit(0)) == F.col("n"))
    k = F.coalesce("k", F.lit(0))
    return rows.select("query_id", found.alias("found"), k.cast("int").alias("k"), F.when((k > 0) & (k >= F.col("kmin")), F.col("label")).alias("label"))


def multi_search(queries: DataFrame, comp: DataFrame, core: DataFrame) -> DataFrame:
    """Answers of a whole batch by one join with the components of all levels."""
    wanted = queries.select("query_id", F.size(F.array_distinct("q")).alias("n"))
    hits = query_vertices(queries).join(comp, "id").groupBy("query_id", "k", "label").agg(F.count("*").alias("c"))
    best = hits.join(wanted, "query_id").where("c = n").groupBy("query_id").agg(F.max(F.struct("k", "label")).alias("b")).select("query_id", "b.k", "b.label")
    return _complete(queries, best, core)


def index_search(queries: DataFrame, members: DataFrame, ancestors: DataFrame, core: DataFrame) -> DataFrame:
    """The same answers through the shell tree: the deepest node above all query vertices (lowest common ancestor)."""
    wanted = queries.select("query_id", F.size(F.array_distinct("q")).alias("n"))
    above = query_vertices(queries).join(members, "id").join(ancestors, ["core", "label"])
    hits = above.groupBy("query_id", "anc_core", "anc_label").agg(F.count("*").alias("c"))
    best = hits.join(wanted, "query_id").where("c = n").groupBy("query_id").agg(F.max(F.struct("anc_core", "anc_label")).alias("b")).select("query_id", F.col("b.anc_core").alias("k"), F.col("b.anc_label").alias("label"))
    return _complete(queries, best, core)


def communities(answers: DataFrame, comp: DataFrame) -> DataFrame:
    """``(k, label, id)`` of every component that an answer names."""
    return comp.join(answers.where("label is not null").select("k", "label").distinct(), ["k", "label"], "left_semi").select("k", "label", "id")


def answer_vertices(answers: DataFrame, comp: DataFrame) -> DataFrame:
    """``(query_id, k, id)``: the community of every query written out."""
    return answers.where("label is not null").join(comp, ["k", "label"]).select("query_id", "k", "id")


def community_ids(answers: DataFrame) -> DataFrame:
    """Answers with ``comm_id``: 0, 1, … over the named components, by level from the top, then by label."""
    ids = numbered(answers.where("label is not null").select("k", "label").distinct(), [F.desc("k"), "label"], "comm_id")
    return answers.join(ids, ["k", "label"], "left").select("query_id", "found", "k", "label", "comm_id")


def max_core_community(queries: DataFrame, members: DataFrame) -> DataFrame:
    """Singleton queries ``(query_id, kmin, id)`` at the core number of their vertex: ``(query_id, k, label)``."""
    rows = queries.join(members, "id", "left")
    k = F.coalesce("core", F.lit(0))
    return rows.select("query_id", k.cast("int").alias("k"), F.when((k > 0) & (k >= F.coalesce("kmin", F.lit(0))), F.col("label")).alias("label"))


def fixed_k_community(queries: DataFrame, comp: DataFrame, core: DataFrame) -> DataFrame:
    """Singleton queries ``(query_id, id, k)`` at exactly k: ``(query_id, k, level, label)``.

    A missing k or -1 stands for the core number of the vertex and is resolved first.  Between two core values the k-core is that of the next value
    that occurs (``level``).  No component: null level and label."""
    rows = queries.join(core, "id", "left").select("query_id", "id", "core", F.coalesce(F.when(F.col("k") >= 0, F.col("k")), F.col("core")).cast("int").alias("k"))
    levels = rows.where("core >= k and core > 0").select("query_id", "id", F.greatest("k", F.lit(1)).alias("least")).join(comp.withColumnRenamed("k", "level"), "id").where("level >= least")
    best = levels.groupBy("query_id").agg(F.min(F.struct("level", "label")).alias("b")).select("query_id", "b.level", "b.label")
    return rows.join(best, "query_id", "left").select("query_id", "k", "level", "label")


def community_edges(edges: DataFrame, named: DataFrame) -> DataFrame:
    """``(k, label, u, v)``: edges inside each component of ``named(k, label, id)``."""
    at = lambda c: named.select("k", "label", F.col("id").alias(c))
    return edges.join(at("u"), "u").join(at("v"), ["k", "label", "v"]).select("k", "label", "u", "v")


def local_search(queries: DataFrame, edges: DataFrame, adj: DataFrame, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Search without an index, for singleton queries ``(query_id, id, k)``, by two bounds.

    Every query grows from its vertex, one step a round.  Above, the core number of a vertex is bounded by the h-index of its neighbours'
    degrees; below, that of the query's vertex by its core number among the vertices reached so far, and by the k asked for.  Vertices whose upper bound is below the
    query's lower bound are neither entered nor passed through: none of them is in the community.  When nothing is left to enter, the core
    decomposition of what was reached gives the exact answer.

    Returns ``(query_id, k, visited)``, k being the core number of the vertex (0: none, or below the k asked for), visited the vertices entered,
    and ``(query_id, id)`` of the communities.  A graph measured to have at most ``small`` directed edges is searched in one task."""
    asked = cut(queries.select("query_id", F.col("id").cast("long"), F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)).cast("long").alias("t")), "local-asked")
    if adj.count() <= (PEELED if small is None else small):
        tagged = adj.select(F.lit(None).cast("long").alias("query_id"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
        both = tagged.unionAll(asked.select(F.col("query_id").cast("long"), "id", "t")).coalesce(1)
        found = cut(both.mapInArrow(_local_task, "query_id long, k int, visited long, id long"), "local-found")
        return found.where("id is null").select("query_id", "k", "visited"), found.where("id is not null").select("query_id", "id")
    degrees = adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("h")).withColumn("moved", F.lit(True))
    upper = cut(lower(adj, degrees).select("id", F.col("h").alias("upper")), "local-upper")
    low = cut(asked.select("query_id", F.col("id").alias("root"), F.col("t").alias("low")), "local-low")
    seen = new = cut(asked.join(upper, "id").where(F.col("upper") >= F.col("t")).select("query_id", "id", "upper"), "local-seen")
    while True:
        live = new.join(low, "query_id").where(F.col("upper") >= F.col("low")).select("query_id", F.col("id").alias("src"), "low")
        near = live.join(adj, "src").select("query_id", F.col("dst").alias("id"), "low").distinct().join(upper, "id").where(F.col("upper") >= F.col("low"))
        new = cut(near.join(seen, ["query_id", "id"], "left_anti").select("query_id", "id", "upper"), "local-new")
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new), "local-seen")
        _, _, core = _regions(seen, low, edges)
        low = cut(low.join(core, "query_id", "left").select("query_id", "root", F.greatest("low", F.coalesce("root_core", F.lit(0)).cast("long")).alias("low")), "local-low")
    keys, region, core = _regions(seen, low, edges)
    visited = seen.groupBy("query_id").agg(F.count("*").alias("visited"))
    k = F.when(F.coalesce("root_core", F.lit(0)) >= F.col("t"), F.col("root_core")).otherwise(0).cast("int")
    rows = cut(asked.join(core, "query_id", "left").join(visited, "query_id", "left").select("query_id", k.alias("k"), F.coalesce("visited", F.lit(0)).alias("visited"), "root_key"), "local-rows")
    cores = cut(coreness(symmetric(region)), "local-core")
    comp = cut(components_by_level(region, cores, edge_weights(region, cores)), "local-comp").withColumnRenamed("id", "key")
    own = rows.where("k > 0").join(comp, (F.col("key") == F.col("root_key")) & (rows["k"] == comp["k"])).select("query_id", rows["k"], "label")
    return rows.select("query_id", "k", "visited"), own.join(comp, ["k", "label"]).join(keys.select("key", "id"), "key").select("query_id", "id")


def _regions(seen: DataFrame, low: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each query may still need: ``(query_id, id, key)`` with keys of its own, edges ``(u, v)`` of keys, and ``(query_id, root_key, root_core)``."""
    kept = seen.join(low, "query_id").where(F.col("upper") >= F.col("low")).select("query_id", "id", (F.col("id") == F.col("root")).alias("is_root"))
    keys = cut(kept.withColumn("key", F.monotonically_increasing_id()), "local-keys")
    of = lambda c: keys.select("query_id", F.col("id").alias(c), F.col("key").alias(c + "_key"))
    region = cut(edges.join(of("u"), "u").join(of("v"), ["query_id", "v"]).select(F.col("u_key").alias("u"), F.col("v_key").alias("v")), "local-region")
    root = keys.where("is_root").select("query_id", F.col("key").alias("root_key"))
    core = coreness(symmetric(region)).select(F.col("id").alias("root_key"), F.col("core").alias("root_core"))
    return keys, region, root.join(core, "root_key")


def _local_task(batches):
    """:func:`local_search` of a small graph: rows ``(null, src, dst)`` and ``(query, vertex, k)``."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not parts:
        return
    query, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    is_edge = np.isnan(query) if query.dtype.kind == "f" else np.zeros(len(query), bool)
    order = np.argsort(a[is_edge], kind="stable")
    src, dst = a[is_edge][order], b[is_edge][order]
    ids, starts, degree = np.unique(src, return_index=True, return_counts=True)
    near = np.searchsorted(ids, dst)
    falling = degree[near]
    place = {int(x): i for i, x in enumerate(ids)}
    upper: dict[int, int] = {}

    def bound(v: int) -> int:
        if v not in upper:
            d = np.sort(falling[starts[v] : starts[v] + degree[v]])[::-1]
            upper[v] = int((d >= np.arange(1, len(d) + 1)).sum())
        return upper[v]

    def beside(v: int) -> list[int]:
        return near[starts[v] : starts[v] + degree[v]].tolist()

    def cores(members: set[int]) -> dict[int, int]:
        pairs = [(v, w) for v in members for w in beside(v) if w in members]
        found = peel(*(np.array(x) for x in zip(*pairs, strict=True))) if pairs else ((), ())
        return dict(zip(*(list(map(int, x)) for x in found), strict=True))

    for q, vertex, low in zip(query[~is_edge].astype(np.int64).tolist(), a[~is_edge].tolist(), b[~is_edge].tolist(), strict=True):
        asked, root = low, place.get(vertex)
        seen = {root} if root is not None and bound(root) >= low else set()
        new = set(seen)
        while new:
            new = {w for v in new if bound(v) >= low for w in beside(v) if w not in seen and bound(w) >= low}
            if new:
                seen |= new
                low = max(low, cores({v for v in seen if bound(v) >= low}).get(root, 0))
        core = cores({v for v in seen if bound(v) >= low})
        k = core.get(root, 0) if core.get(root, 0) >= asked else 0
        found, todo = ({root}, [root]) if k else (set(), [])
        while todo:
            more = {w for w in beside(todo.pop()) if core.get(w, 0) >= k} - found
            found |= more
            todo += more
        n = 1 + len(found)
        yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), pa.array([k] * n, pa.int32()), pa.array([len(seen)] * n, pa.int64()), pa.array([None, *ids[sorted(found)].tolist()], pa.int64())], names=["query_id", "k", "visited", "id"])
