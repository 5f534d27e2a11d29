"""Graph preparation: cleaning, ids, degrees, neighbourhoods.

Edges are frames ``(u, v)`` of longs; ``adj`` frames ``(src, dst)`` hold both directions of a simple graph.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.functions import canonical
from cohesia.storage import cut

#: Rows that one task numbers in :func:`numbered`.
BIN_ROWS = 1_000_000


def canonical_edges(raw: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Simple undirected edges, smaller end first: no loops, no repeats, no null ends."""
    return raw.where(F.col(u) != F.col(v)).select(*canonical(u, v)).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of canonical edges; one pass, no shuffle."""
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def vertex_set(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Distinct end points ``(orig)`` of any edge frame, loops included."""
    return edges.select(F.explode(F.array(u, v)).alias("orig")).where("orig is not null").distinct()


def numbered(frame: DataFrame, order: list, name: str) -> DataFrame:
    """``frame`` with a column of places 0, 1, … in the given order, the same however the rows are partitioned (ties: any way).

    Rows are dealt into ranges of the order and kept so; counts of the ranges give each range its first place, and each range is
    numbered by itself, so no task sorts all rows."""
    bins = max(1, math.ceil(frame.count() / BIN_ROWS))
    ranged = cut(frame.repartitionByRange(bins, *order).withColumn("_bin", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_bin").count()
    before = counts.select("_bin", (F.sum("count").over(Window.orderBy("_bin")) - F.col("count")).alias("_before"))
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_bin").orderBy(*order)) - 1)
    return inside.join(before, "_bin").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_bin", "_before", "_at")


def dense_ids(vertices: DataFrame) -> DataFrame:
    """``(id, orig)``: ids 0, 1, … in the order of ``orig``."""
    return numbered(vertices.select("orig"), ["orig"], "id").select("id", "orig")


def relabel(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with original ends replaced by dense ids; ends without an id are dropped with their edge."""
    to = lambda c: vertices.select(F.col("orig").alias(c), F.col("id").alias(c + "_id"))
    return edges.join(to("u"), "u").join(to("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))


def restore(frame: DataFrame, vertices: DataFrame, id_col: str = "id") -> DataFrame:
    """Replace dense ids by original ids."""
    to = vertices.select(F.col("id").alias("_id"), F.col("orig").alias("_orig"))
    return frame.join(to, F.col(id_col) == F.col("_id")).drop("_id", id_col).withColumnRenamed("_orig", id_col)


def degree(adj: DataFrame) -> DataFrame:
    """``(id, degree)`` in a simple graph."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_multiset(raw: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(id, degree)`` over all rows as they are: repeats count, a loop counts twice."""
    return raw.select(F.explode(F.array(u, v)).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def quantile_nearest(frame: DataFrame, column: str, q: float):
    """Value at place ``round(q * (n - 1))`` in sorted order (half to even), from counts per value; null for an empty frame."""
    counts = frame.groupBy(column).count()
    n = frame.count()
    place = round(q * (n - 1)) if n else 0
    upto = counts.withColumn("upto", F.sum("count").over(Window.orderBy(column)))
    return upto.where(F.col("upto") > place).agg(F.min(column).alias("t")).first()["t"]


def neighbours(adj: DataFrame, frontier: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Neighbours of ``frontier(*by, id)``, each once per ``by``."""
    by = by or []
    return frontier.join(adj, F.col("id") == F.col("src")).select(*by, F.col("dst").alias("id")).distinct()


def k_hop(adj: DataFrame, start: DataFrame, hops: int, by: list[str] | None = None) -> DataFrame:
    """``(*by, id, hop)``: vertices within ``hops`` steps of ``start(*by, id)`` and their distance."""
    by = by or []
    seen = cut(start.select(*by, "id").distinct().withColumn("hop", F.lit(0)), "hop")
    for h in range(1, hops + 1):
        new = neighbours(adj, seen.where(F.col("hop") == h - 1), by).withColumn("hop", F.lit(h))
        seen = cut(seen.unionByName(new).groupBy(*by, "id").agg(F.min("hop").alias("hop")), "hop")
    return seen


def closed_neighbourhood(adj: DataFrame, members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, id)``: the members and everything beside them."""
    by = by or []
    return neighbours(adj, members, by).unionByName(members.select(*by, "id")).distinct()


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members(id)``."""
    one = lambda c: members.select(F.col("id").alias(c)).distinct()
    return edges.join(one("u"), "u", "left_semi").join(one("v"), "v", "left_semi").select("u", "v")


def children(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """``(parent, child)`` of a parent column; roots point at themselves or at null and have no row."""
    return nodes.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(parent).alias("parent"), F.col(node).alias("child"))
