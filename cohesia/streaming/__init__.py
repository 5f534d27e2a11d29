"""Edges from a stream of files.

The graph operators are batch operators; a stream only keeps the edge table they start from up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohesia.operators.graph import canonical_edges


def edge_stream(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """``(u, v)`` of delimited files as they arrive in a folder."""
    return spark.readStream.schema("u long, v long").option("sep", sep).option("header", header).csv(path)


def keep_edges(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch's canonical edges to a Parquet table.

    An edge that several batches hold is stored several times; readers take ``canonical_edges`` of the table.  A batch that is run again after a failure
    replaces its own folder, so it is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        canonical_edges(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
