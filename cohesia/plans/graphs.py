"""Graphs derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesia.operators.graph import canonical_edges


def raw_copurchase(spark: SparkSession, folder: str, above: float) -> DataFrame:
    """``(u, v)``, u < v, for every two lines of an order that sell different parts, more than ``above`` pieces each; repeats stay."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where(F.col("l_quantity") > above)
    a, b = (lines.select("l_orderkey", F.col("l_partkey").alias(c)) for c in "uv")
    return a.join(b, "l_orderkey").where("u < v").select("u", "v")


def copurchase(spark: SparkSession, folder: str, above: float = 45) -> DataFrame:
    """Parts bought in one order, simple edges."""
    return canonical_edges(raw_copurchase(spark, folder, above))


def customer_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers that met in an order; supplier ids are made negative, as the ranges overlap."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    return lines.join(orders, "l_orderkey").select((-F.col("l_suppkey") - 1).alias("u"), F.col("o_custkey").alias("v")).distinct()


def order_queries(spark: SparkSession, folder: str, above: float = 40) -> DataFrame:
    """``(query_id, kmin, q)``: the parts of every order with more than ``above`` pieces; kmin is their number, at most 3."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where(F.col("l_quantity") > above)
    sets = lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("q"))
    return sets.select("query_id", F.least(F.size("q"), F.lit(3)).cast("int").alias("kmin"), "q")
