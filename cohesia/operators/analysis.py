"""Comparison and statistics of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.graph import closed_neighbourhood

#: Implementations that a timing table has columns for.
MOST_COLUMNS = 1000


def jaccard_of_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, distance)`` between result sets ``(*keys, id)``; a key that occurs on one side only has distance 1."""
    left = a.select(*keys, "id").distinct().withColumn("a", F.lit(1))
    right = b.select(*keys, "id").distinct().withColumn("b", F.lit(1))
    both = left.join(right, [*keys, "id"], "full").groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("i"), F.count("*").alias("u"))
    return both.select(*keys, (1 - F.coalesce("i", F.lit(0)) / F.col("u")).alias("distance"))


def jaccard_of_answers(a: DataFrame, b: DataFrame, comp: DataFrame) -> DataFrame:
    """``(query_id, distance)`` between two answer frames ``(query_id, k, label)`` over the same components.

    Sizes and overlaps are taken once for each pair of components, not for each query; two empty answers have distance 0, one empty 1."""
    pairs = a.select("query_id", F.col("k").alias("ka"), F.col("label").alias("la")).join(b.select("query_id", F.col("k").alias("kb"), F.col("label").alias("lb")), "query_id", "full")
    named = pairs.where("la is not null and lb is not null").select("ka", "la", "kb", "lb").distinct()
    size = comp.groupBy("k", "label").agg(F.count("*").alias("n"))
    left = comp.select(F.col("k").alias("ka"), F.col("label").alias("la"), "id")
    right = comp.select(F.col("k").alias("kb"), F.col("label").alias("lb"), "id")
    shared = named.join(left, ["ka", "la"]).join(right, ["kb", "lb", "id"]).groupBy("ka", "la", "kb", "lb").agg(F.count("*").alias("i"))
    sized = named.join(shared, ["ka", "la", "kb", "lb"], "left").join(size.toDF("ka", "la", "na"), ["ka", "la"]).join(size.toDF("kb", "lb", "nb"), ["kb", "lb"])
    i = F.coalesce("i", F.lit(0))
    distance = sized.select("ka", "la", "kb", "lb", (1 - i / (F.col("na") + F.col("nb") - i)).alias("d"))
    out = pairs.join(distance, ["ka", "la", "kb", "lb"], "left")
    empty = F.when(F.col("la").isNull() & F.col("lb").isNull(), 0.0).otherwise(1.0)
    return out.select("query_id", F.coalesce("d", empty).alias("distance"))


def agreement(a: DataFrame, b: DataFrame, c: DataFrame, comp: DataFrame) -> DataFrame:
    """``(query_id, d12, d13, d23)``: distances between the answers of three implementations to each query."""
    pair = lambda x, y, name: jaccard_of_answers(x, y, comp).withColumnRenamed("distance", name)
    return pair(a, b, "d12").join(pair(a, c, "d13"), "query_id", "full").join(pair(b, c, "d23"), "query_id", "full").select("query_id", "d12", "d13", "d23")


def community_sizes(named: DataFrame, adj: DataFrame) -> DataFrame:
    """``(k, label, nodes, nbrhood)`` of components ``named(k, label, id)``: vertices, and vertices with those beside them."""
    nodes = named.groupBy("k", "label").agg(F.count("*").alias("nodes"))
    near = closed_neighbourhood(adj, named, ["k", "label"]).groupBy("k", "label").agg(F.count("*").alias("nbrhood"))
    return nodes.join(near, ["k", "label"])


def timing_table(times: DataFrame) -> DataFrame:
    """``(network, op)`` with one column of seconds for each implementation, from ``(network, op, impl, time)``; MOST_COLUMNS implementations at most."""
    impls = [r.impl for r in times.select("impl").distinct().orderBy("impl").limit(MOST_COLUMNS + 1).collect()]
    if len(impls) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} implementations")
    return times.groupBy("network", "op").pivot("impl", impls).agg(F.min("time"))
