"""Writers.  Every one replaces what stood at its path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX_SCHEMAS = {
    "core": "id long, core int",
    "comp": "k int, id long, label long",
    "members": "id long, core int, label long",
    "ancestors": "core int, label long, anc_core int, anc_label long",
    "nodes": "core int, label long, parent_core int, parent_label long, depth int, size long",
}


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of an index as Parquet; components are laid out by level for row-group skipping."""
    for name in INDEX_SCHEMAS:
        frame = tables[name]
        if name == "comp":
            frame = frame.sortWithinPartitions("k", "label")
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def edges_csv(edges: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    edges.select("u", "v").write.mode("overwrite").csv(path, sep=sep, header=header)


def vertices_csv(vertices: DataFrame, path: str, header: bool = True) -> None:
    """The node map with its ids in a column of their own."""
    vertices.select("orig", F.col("id").alias("new")).write.mode("overwrite").csv(path, header=header)


def core_tsv(core: DataFrame, path: str) -> None:
    core.select(F.col("id").alias("node"), "core").write.mode("overwrite").csv(path, sep="\t", header=True)


def positional_text(frame: DataFrame, column: str, path: str) -> None:
    """One value a line in the order of the id; files follow each other by name."""
    frame.orderBy("id").select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def communities_text(vertices: DataFrame, path: str) -> None:
    """``(query_id, k, id)`` as a folder for each query and level, one id a line in ascending order."""
    vertices.repartition("query_id", "k").sortWithinPartitions("query_id", "k", "id").select("query_id", "k", F.col("id").cast("string").alias("value")).write.mode("overwrite").partitionBy("query_id", "k").text(path)


def report_csv(frame: DataFrame, path: str) -> None:
    """Statistics (profile, summary, timing, sizes) with a header."""
    frame.write.mode("overwrite").csv(path, header=True)


def queries_text(queries: DataFrame, path: str, layout: str = "kmin_first") -> None:
    """One query a line, in the order of the query id; files follow each other by name."""
    ids = F.array_join(F.col("q").cast("array<string>"), ",")
    k = F.col("kmin").cast("string")
    line = F.concat_ws(" ", k, ids) if layout == "kmin_first" else F.concat_ws(" ", ids, k)
    queries.orderBy("query_id").select(line.alias("value")).write.mode("overwrite").text(path)
