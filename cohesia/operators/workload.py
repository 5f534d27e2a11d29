"""Query workloads: high-degree and random singletons, neighbourhood sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.functions import seeded_order
from cohesia.operators.graph import quantile_nearest


def sample(frame: DataFrame, n: int, seed: int, column: str = "id") -> DataFrame:
    """n rows chosen by a seeded hash of a column: the same rows on every run; all rows if there are no more."""
    return frame.orderBy(seeded_order(seed, column), column).limit(n)


def high_degree(degrees: DataFrame, q: float = 0.99) -> DataFrame:
    """Vertices whose degree is at least the nearest-rank quantile q."""
    limit = quantile_nearest(degrees, "degree", q)
    return degrees.where(F.col("degree") >= F.lit(limit))


def singletons(degrees: DataFrame, n: int, seed: int, high: bool, k: int | None = None) -> DataFrame:
    """``(query_id, kmin, q)`` of n sampled vertices, of high degree or of any."""
    picked = sample(high_degree(degrees) if high else degrees, n, seed)
    rank = F.row_number().over(Window.orderBy(seeded_order(seed, "id"), "id")) - 1
    return picked.select(rank.cast("long").alias("query_id"), F.lit(k).cast("int").alias("kmin"), F.array("id").alias("q"))


def ranked_singletons(degrees: DataFrame, n: int) -> DataFrame:
    """``(rank, id, degree)`` of the n vertices of highest degree, smaller ids first."""
    top = degrees.orderBy(F.desc("degree"), "id").limit(n)
    return top.select((F.row_number().over(Window.orderBy(F.desc("degree"), "id")) - 1).cast("long").alias("rank"), "id", "degree")


def neighbour_sets(adj: DataFrame, roots: DataFrame, most: int | None = None, seed: int | None = None) -> DataFrame:
    """``(query_id, q)`` for each root: its neighbours in ascending order, or ``most`` of them (lowest ids, or seeded)."""
    near = roots.join(adj, F.col("id") == F.col("src")).select(F.col("id").alias("query_id"), "dst")
    if most is not None:
        order = [F.col("dst")] if seed is None else [seeded_order(seed, "query_id", "dst"), F.col("dst")]
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= most)
    return near.groupBy("query_id").agg(F.sort_array(F.collect_list("dst")).alias("q"))
