"""The hierarchy of k-core components.

``comp(k, id, label)`` names, for every core value k and every vertex of core at least k, its component in the k-core by the smallest id in it.
The table has as many rows as all core values add up to, so at most twice the edges.  Components of all levels depend only on a
maximum spanning forest of the edge weights; it is built by rounds of contraction, and all levels are then labelled at once.  Graphs of at most ``SMALL`` edges are
labelled in one task.

The shell tree has a node for each component that owns a vertex of its level, keyed by (core, label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.components import connected_components, merge_labels
from cohesia.operators.graph import numbered
from cohesia.storage import cut, drop

SMALL = 2_000_000


def _label_levels(batches):
    """Rows ``(u, v, w)``: edges with their weight, and each vertex with its core as ``(id, id, core)``."""
    parts = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches]
    if not parts:
        return
    u, v, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = inverse[: len(u)], inverse[len(u) :]
    core = np.zeros(len(ids), np.int64)
    loop = u == v
    core[u[loop]] = w[loop]
    u, v, w = u[~loop], v[~loop], w[~loop]
    label = np.arange(len(ids))
    for k in np.unique(core)[::-1]:
        label = merge_labels(label, u[w == k], v[w == k])
        at = np.flatnonzero(core >= k)
        for j in range(0, len(at), 100_000):
            part = at[j : j + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(ids[part]), pa.array(ids[label[part]])], names=["k", "id", "label"])


def _forest_task(batches):
    parts = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches]
    if not parts:
        return
    u, v, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, order = at[: len(u)], at[len(u) :], np.lexsort((v, u, -w))
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    label, taken = np.arange(len(ids)), np.zeros(len(u), bool)
    live = np.arange(len(u))
    while len(live):
        best = np.full(len(ids), len(u))
        np.minimum.at(best, label[a[live]], place[live])
        np.minimum.at(best, label[b[live]], place[live])
        picked = order[np.unique(best[best < len(u)])]
        taken[picked] = True
        label = merge_labels(label, a[picked], b[picked])
        live = live[label[a[live]] != label[b[live]]]
    t = np.flatnonzero(taken)
    for k in range(0, len(t), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[t[k : k + 100_000]]) for x in (u, v, w)], names=["u", "v", "w"])


def maximum_spanning_forest(weights: DataFrame, small: int | None = None) -> DataFrame:
    """``(u, v, w)``: a spanning forest of largest total weight, ties by the smaller ends, by Borůvka rounds.

    In each round every component takes its best edge; components joined by taken edges become one.  A table of at most ``SMALL`` edges is
    worked on in one task."""
    weights = cut(weights.select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("w").cast("long")), "forest-w")
    if weights.count() <= (SMALL if small is None else small):
        return weights.coalesce(1).mapInArrow(_forest_task, "u long, v long, w long")
    live = cut(weights.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w"), "forest-live")
    taken = None
    while not live.isEmpty():
        best = F.max(F.struct("w", (-F.col("u")).alias("mu"), (-F.col("v")).alias("mv"))).alias("e")
        ends = live.select(F.explode(F.array("a", "b")).alias("c"), "w", "u", "v")
        picked = cut(ends.groupBy("c").agg(best).select((-F.col("e.mu")).alias("u"), (-F.col("e.mv")).alias("v"), F.col("e.w").alias("w")).distinct(), "forest-picked")
        taken = picked if taken is None else taken.unionAll(picked)
        joined = picked.join(live.select("a", "b", "u", "v"), ["u", "v"])
        merged = cut(connected_components(joined, "a", "b"), "forest-merged")
        to = lambda c: merged.select(F.col("id").alias(c), F.col("component").alias("new_" + c))
        moved = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "u", "v", "w")
        live, old = cut(moved.where("a <> b"), "forest-live"), live
        drop(old)
    return weights.limit(0) if taken is None else taken


def components_by_level(edges: DataFrame, core: DataFrame, weights: DataFrame, small: int | None = None) -> DataFrame:
    """``(k int, id long, label long)`` for every core value k that occurs."""
    weights = cut(weights.select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("w").cast("long")), "levels-w")
    if weights.count() <= (SMALL if small is None else small):
        own = core.select(F.col("id").alias("u"), F.col("id").alias("v"), F.col("core").cast("long").alias("w"))
        return weights.unionAll(own).coalesce(1).mapInArrow(_label_levels, "k int, id long, label long")
    forest = maximum_spanning_forest(weights, 0)
    # A vertex of the i-th core value is in the components of the first i values.
    rank = cut(numbered(core.select(F.col("core").alias("k")).distinct(), ["k"], "rank"), "levels-rank")
    upto = lambda frame, column: frame.join(rank.withColumnRenamed("k", column), column).withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), "rank"))).join(rank, "rank")
    member = cut(upto(core, "core").select("k", "id").withColumn("key", F.monotonically_increasing_id()), "levels-members")
    edge = upto(forest, "w").select("k", "u", "v")
    of = lambda c: member.select("k", F.col("id").alias(c), F.col("key").alias(c + "_key"))
    keyed = edge.join(of("u"), ["k", "u"]).join(of("v"), ["k", "v"]).select("u_key", "v_key")
    merged = connected_components(keyed, "u_key", "v_key").withColumnRenamed("id", "key")
    labelled = member.join(merged, "key", "left").withColumn("c", F.coalesce("component", "key"))
    low = labelled.groupBy("c").agg(F.min("id").alias("label"))
    return labelled.join(low, "c").select("k", "id", "label")


def shell_members(comp: DataFrame, core: DataFrame) -> DataFrame:
    """``(id, core, label)``: the tree node that owns each vertex."""
    return core.join(comp, "id").where(F.col("k") == F.col("core")).select("id", "core", "label")


def shell_ancestors(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``(core, label, anc_core, anc_label)``: every node with itself and all nodes above it."""
    nodes = members.select("core", "label").distinct()
    above = nodes.select("core", "label", F.col("label").alias("id")).join(comp.withColumnRenamed("label", "anc_label"), "id").where("k <= core")
    return above.join(nodes.select(F.col("core").alias("k"), F.col("label").alias("anc_label")), ["k", "anc_label"], "left_semi").select("core", "label", F.col("k").alias("anc_core"), "anc_label")


def shell_nodes(members: DataFrame, ancestors: DataFrame, virtual_root: bool = True) -> DataFrame:
    """``(core, label, parent_core, parent_label, depth, size)`` of every tree node; ``size``: vertices it owns.

    If several components have nothing above them, a virtual root ``(0, -1)`` of no vertices is added above them; else the top node is its own parent."""
    size = members.groupBy("core", "label").agg(F.count("*").alias("size"))
    up = ancestors.where("anc_core < core").groupBy("core", "label").agg(F.max(F.struct("anc_core", "anc_label")).alias("p"), F.count("*").alias("above"))
    nodes = size.join(up, ["core", "label"], "left")
    if not virtual_root:
        return nodes.select("core", "label", F.coalesce("p.anc_core", "core").alias("parent_core"), F.coalesce("p.anc_label", "label").alias("parent_label"), F.coalesce("above", F.lit(0)).cast("int").alias("depth"), "size")
    nodes = cut(nodes, "shell-nodes")
    many = nodes.where("p is null").limit(2).count() > 1
    nodes = nodes.withColumn("root", F.lit(many))
    own = nodes.select(
        "core",
        "label",
        F.when(F.col("p").isNotNull(), F.col("p.anc_core")).when(F.col("root"), 0).otherwise(F.col("core")).alias("parent_core"),
        F.when(F.col("p").isNotNull(), F.col("p.anc_label")).when(F.col("root"), -1).otherwise(F.col("label")).alias("parent_label"),
        (F.coalesce("above", F.lit(0)) + F.col("root").cast("int")).cast("int").alias("depth"),
        "size",
    )
    root = nodes.sparkSession.createDataFrame([(0, -1, 0, -1, 0, 0)] if many else [], own.schema)
    return own.unionAll(root)


def subtree_vertices(ancestors: DataFrame, members: DataFrame) -> DataFrame:
    """``(core, label, id)``: all vertices at or below each node, which are the vertices of its component."""
    return ancestors.join(members, ["core", "label"]).select(F.col("anc_core").alias("core"), F.col("anc_label").alias("label"), "id")


def core_profile(nodes: DataFrame) -> DataFrame:
    """``(core, ncomm, nvert)`` for every core value from 0 to the largest; a virtual root counts at 0."""
    seen = nodes.groupBy("core").agg(F.count("*").alias("ncomm"), F.sum("size").alias("nvert"))
    every = nodes.agg(F.max("core").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("core"))
    return every.join(seen, "core", "left").select("core", F.coalesce("ncomm", F.lit(0)).cast("long").alias("ncomm"), F.coalesce("nvert", F.lit(0)).cast("long").alias("nvert"))


def draw(nodes: DataFrame, most: int = 1000) -> str:
    """The tree as indented text, for trees of at most ``most`` nodes."""
    rows = nodes.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the tree has more than {most} nodes")
    below: dict = {}
    tops = []
    for r in sorted(rows, key=lambda r: (r.core, r.label)):
        own, up = (r.core, r.label), (r.parent_core, r.parent_label)
        if own == up:
            tops.append(r)
        else:
            below.setdefault(up, []).append(r)
    lines = []

    def show(r, indent):
        lines.append(f"{'  ' * indent}{r.core}:{r.label} ({r['size']})")
        for c in below.get((r.core, r.label), []):
            show(c, indent + 1)

    for r in tops:
        show(r, 0)
    return "\n".join(lines)
