"""Connected components of an edge table of any size, by rounds of contraction.

Each round hooks every vertex to its smallest neighbour, follows these pointers twice, and replaces the end points of
all edges; vertices that met become one.  Ids are first mixed by an invertible xor-shift, so that the order among
neighbours is as good as random and chains of consecutive ids shrink by a constant factor a round.  Rounds work on
tables in the shared folder; nothing but the number of remaining edges comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.storage import cut, drop

#: Edges up to which a caller may let one task label the graph (16 bytes each).
SMALL = 2_000_000


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the ends of edges ``(a, b)``, each the smallest of its class; ``label[label] == label``."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _label_task(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = ids[merge_labels(np.arange(len(ids)), at[: len(a)], at[len(a) :])]
        for k in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(label[k : k + 100_000])], names=["id", "component"])


def _mix(c):
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = 0) -> DataFrame:
    """``(id long, component long)`` for every end point of ``edges`` (long ids, any direction, repeats, loops; rows
    with a null end are ignored); ``component`` is the smallest id reachable.  An empty table gives an empty table.
    A table measured to have at most ``small`` rows is labelled in one task; by default none is."""
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    base = cut(pairs.select("a", "b", _mix(F.col("a")).alias("u"), _mix(F.col("b")).alias("v")), "cc-base")
    if small and base.count() <= small:
        return base.select("a", "b").coalesce(1).mapInArrow(_label_task, "id long, component long")
    vertices = base.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("u").alias("at")), F.struct(F.col("b").alias("id"), F.col("v").alias("at")))).alias("x")).select("x.*").distinct()
    live, steps = cut(_ordered(base.select("u", "v")), "cc-edges"), []
    while not live.isEmpty():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "cc-hook")
        twice = _follow(hook, hook)
        step = cut(_follow(twice, twice), "cc-step")
        drop(hook)
        to = lambda c: step.select(F.col("u").alias(c), F.col("p").alias("new_" + c))
        moved = live.join(to("u"), "u").join(to("v"), "v").select(F.col("new_u").alias("u"), F.col("new_v").alias("v"))
        live, old = cut(_ordered(moved), "cc-edges"), live
        drop(old)
        steps.append(step)
    label = vertices
    for step in steps:
        label = label.join(step.withColumnRenamed("u", "at"), "at", "left").select("id", F.coalesce("p", "at").alias("at"))
    label = cut(label, "cc-label")
    for x in (*steps, live, base):
        drop(x)
    smallest = label.groupBy("at").agg(F.min("id").alias("component"))
    return label.join(smallest, "at").select("id", "component")


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """Pointers ``(u, p)`` of two pointer tables in a row; every target has a pointer."""
    return first.join(then.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))


def _ordered(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
