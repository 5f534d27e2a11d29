"""Core decomposition.

The general way works on tables of any size: upper bounds start at the degrees and fall to the h-index of the neighbours'
bounds until nothing changes (Montresor et al. 2013; Lü et al. 2016).  The h-index is taken from counts per (vertex, bound), so a
hub needs no list of its neighbours, and a vertex that has settled among settled neighbours is not looked at again.

A graph whose edge table is measured to have at most ``SMALL`` rows is peeled in one task instead: its arrays fit into a few dozen MB,
and the rounds cost more than the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.plans.fixpoint import fixpoint
from cohesia.storage import cut

#: Directed edges up to which one task peels the graph (16 bytes each).
SMALL = 4_000_000


def peel(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and core numbers of a simple graph given in both directions, by waves of removals."""
    ids, s = np.unique(src, return_inverse=True)
    d = np.searchsorted(ids, dst)
    order = np.argsort(s, kind="stable")
    near = d[order]
    deg = np.bincount(s, minlength=len(ids))
    start = np.concatenate([[0], np.cumsum(deg)])
    core, alive, k = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), 0
    wave = np.zeros(0, np.int64)
    while True:
        if not len(wave):
            rest = np.flatnonzero(alive)
            if not len(rest):
                return ids, core
            k = max(k, int(deg[rest].min()))
            wave = rest[deg[rest] <= k]
        core[wave], alive[wave] = k, False
        size = start[wave + 1] - start[wave]
        at = np.repeat(start[wave] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        hit, times = np.unique(near[at], return_counts=True)
        hit, times = hit[alive[hit]], times[alive[hit]]
        deg[hit] -= times
        wave = hit[deg[hit] <= k]


def _peel_task(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        ids, core = peel(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for k in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(core[k : k + 100_000])], names=["id", "core"])


def lower(adj: DataFrame, state: DataFrame) -> DataFrame:
    """One round: ``state(id, h, moved)`` to the bounds that the neighbours allow; ``moved``: whether the bound fell.

    Only vertices with a neighbour that moved can fall."""
    touched = adj.join(state.where("moved").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    own = state.join(touched, "id", "left_semi").select(F.col("id").alias("src"), F.col("h").alias("own"))
    near = adj.join(own, "src").join(state.select(F.col("id").alias("dst"), F.col("h").alias("near")), "dst")
    counts = near.groupBy("src", F.least("own", "near").alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("x")))
    fallen = counts.withColumn("k", F.least("x", upto)).groupBy(F.col("src").alias("id")).agg(F.max("k").alias("new"))
    new = F.coalesce("new", "h")
    return state.join(fallen, "id", "left").select("id", new.alias("h"), (new < F.col("h")).alias("moved"))


def coreness(adj: DataFrame, small: int | None = None) -> DataFrame:
    """``(id long, core int)`` of every vertex of a simple graph given in both directions."""
    table = cut(adj.select(F.col("src").cast("long"), F.col("dst").cast("long")), "core-adj")
    if table.count() <= (SMALL if small is None else small):
        return table.coalesce(1).mapInArrow(_peel_task, "id long, core long").select("id", F.col("core").cast("int").alias("core"))
    degrees = table.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("h")).withColumn("moved", F.lit(True))
    state = fixpoint(degrees, lambda s: lower(table, s), lambda s: s.where("moved"), name="core")
    return state.select("id", F.col("h").cast("int").alias("core"))


def edge_weights(edges: DataFrame, core: DataFrame) -> DataFrame:
    """``(u, v, w)``: the largest k whose core holds the edge."""
    of = lambda c: core.select(F.col("id").alias(c), F.col("core").alias(c + "_core"))
    return edges.join(of("u"), "u").join(of("v"), "v").select("u", "v", F.least("u_core", "v_core").alias("w"))


def k_core(weights: DataFrame, k: int) -> DataFrame:
    """Edges of the k-core."""
    return weights.where(F.col("w") >= k).select("u", "v")


def k_shell(core: DataFrame, k: int) -> DataFrame:
    """Vertices of core number k."""
    return core.where(F.col("core") == k).select("id")


def core_histogram(core: DataFrame) -> DataFrame:
    """``(core, nvert)``."""
    return core.groupBy("core").agg(F.count("*").alias("nvert"))
