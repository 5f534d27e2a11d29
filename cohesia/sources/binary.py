"""Adjacency in one binary file of 64-bit words: for every vertex 0, 1, … the place of its first neighbour, then the neighbours of all vertices
one after the other.  Places count words from the beginning of the file, so the first word is the number of vertices.

The file is read in ranges by many tasks, none of which holds more than a range and the places that belong to it.  It is written as parts by many tasks; the parts are
then strung together through a buffer.  Files are reached by ``pyarrow.fs``.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohesia.operators.graph import BIN_ROWS
from cohesia.storage import cut, new_path, reach_workers, remove

WORD = np.dtype("<u8")
#: Words that a task reads or copies at a time.
RANGE = 1 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def _words(stream, low: int, high: int) -> np.ndarray:
    stream.seek(8 * low)
    return np.frombuffer(stream.read(8 * (high - low)), WORD).astype(np.int64)


def _owner(stream, vertices: int, place: int) -> int:
    """The last vertex whose neighbours begin at ``place`` or before."""
    low, high = 0, vertices
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if int(_words(stream, middle, middle + 1)[0]) <= place else (low, middle)
    return low


def adjacency_file(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of every neighbour in a file; an empty file has none.  A file whose first word points beyond its end is an error."""
    reach_workers(spark)
    system, name = _at(path)
    total = (system.get_file_info(name).size or 0) // 8
    with system.open_input_file(name) as stream:
        vertices = int(_words(stream, 0, 1)[0]) if total else 0
    if vertices > total:
        raise ValueError(f"{path}: {vertices} vertices in {total} words")
    ranges = max(1, math.ceil((total - vertices) / RANGE))

    def run(batches):
        system, name = _at(path)
        with system.open_input_file(name) as stream:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    low, high = vertices + k * RANGE, min(total, vertices + (k + 1) * RANGE)
                    if low >= high:
                        continue
                    dst, src, first = _words(stream, low, high), np.empty(high - low, np.int64), _owner(stream, vertices, low)
                    done = low
                    while done < high:
                        last = min(vertices, first + RANGE)
                        starts = _words(stream, first, last)
                        end = high if last == vertices else min(high, int(_words(stream, last, last + 1)[0]))
                        src[done - low : end - low] = first + np.searchsorted(starts, np.arange(done, end), "right") - 1
                        done, first = max(done, end), last
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return spark.range(0, ranges, 1, ranges).mapInArrow(run, "src long, dst long")


def write_adjacency(adj: DataFrame, vertices: int, path: str) -> None:
    """Write ``adj(src, dst)`` over the ids 0 to ``vertices`` - 1; neighbours in ascending order, ids without any have none."""
    spark = adj.sparkSession
    degree = spark.range(vertices).join(adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("id") / BIN_ROWS).alias("bin"))
    degree = cut(degree, "csr-degree")
    before = degree.groupBy("bin").agg(F.sum("n").alias("sum")).select("bin", (F.sum("sum").over(Window.orderBy("bin")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("bin").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = degree.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "bin").select("id", (F.col("before") + F.col("inside") + vertices).alias("word"))
    folder = new_path(spark, "csr")

    def write(frame: DataFrame, order: list[str], kind: str) -> list[str]:
        def run(batches):
            out, name = None, ""
            for batch in batches:
                if out is None:
                    system, at = _at(folder)
                    system.create_dir(at, recursive=True)
                    # The least key names the part; every attempt of a task has a file of its own.
                    name = f"{kind}-{batch.column(0)[0].as_py():020d}-{os.urandom(8).hex()}"
                    out = system.open_output_stream(f"{at}/{name}")
                out.write(batch.column(1).to_numpy().astype(WORD).tobytes())
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        parts = frame.repartitionByRange(max(1, math.ceil(frame.count() / BIN_ROWS)), order[0]).sortWithinPartitions(*order)
        return sorted(r.name for r in parts.mapInArrow(run, "name string").collect())

    names = write(offsets, ["id", "word"], "a") + write(adj.select("src", "dst"), ["src", "dst"], "b")
    system, at = _at(path)
    with system.open_output_stream(at, compression=None) as out:
        for name in names:
            source, part = _at(f"{folder}/{name}")
            with source.open_input_stream(part, compression=None) as stream:
                while block := stream.read(8 * RANGE):
                    out.write(block)
    if names:
        remove(spark, folder)
