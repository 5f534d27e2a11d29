"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors are merged first and carry their number.  Each table hashes a vector to the signs of ``bits`` random
projections.  What travels to the buckets of all tables is not the vector but its name and a sketch, the signs of 128 further projections; two names of a bucket whose
sketches differ in few enough signs are candidates.  ``bits`` grows with the logarithm of the number of vectors, so that buckets keep their mean size, and the
number of tables and the signs allowed follow from the wanted recall at the threshold itself (pairs that are closer are found more surely).

A bucket emits its candidates as a forest, never as pairs.  The components of all candidates hold all links found, so each vector that has a candidate travels once, to its
component, where all pairs are compared by their cosine in double precision.  A component above ``DIRECT`` vectors, such as a long chain of
candidates, is not compared as a whole: its vectors travel to the buckets of narrower tables and are compared there; a pair that meets in several
of them counts in the first only.  Either way links are counted without listing pairs, and a spanning forest of them is kept.

Buckets above ``BLOCK`` (of sketches: ``SKETCH_BLOCK``) are cut into blocks, and pairs of blocks are separate groups, so one hot bucket spreads over many
tasks and no task holds more than two blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.components import connected_components, merge_labels
from cohesia.storage import cut, drop

COSINE, RECALL = 0.95, 0.99999
#: Rows of a block of a bucket, vectors of a component compared as a whole, and those of a part of it.
BLOCK, DIRECT, PART = 1024, 1024, 128
#: Rows of a block of a bucket of sketches, which are narrow.
SKETCH_BLOCK = 2048
#: Wanted mean size of a bucket in which vectors are compared, and of one in which sketches are.
MEAN_BUCKET, MEAN_SKETCHED = 24, 192
SKETCH = 128


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL, mean: int = MEAN_BUCKET) -> tuple[int, int]:
    """Bits a table and number of tables for n vectors: a pair at the threshold is missed with chance 1 - recall at most."""
    bits = min(30, max(6, round(math.log2(max(n, 1) / mean))))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def plan_sketch(cosine: float = COSINE, miss: float = (1 - RECALL) / 10) -> int:
    """Signs of SKETCH in which a pair at the threshold differs at most, but for a chance of ``miss``."""
    p = math.acos(cosine) / math.pi
    left = 1.0
    for k in range(SKETCH + 1):
        left -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if left <= miss:
            return k
    return SKETCH


@lru_cache(maxsize=8)
def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 * dim + bits).standard_normal((dim, bits * tables))


@lru_cache(maxsize=8)
def _sketch_planes(dim: int) -> np.ndarray:
    return np.random.default_rng(7_000_003 * dim + 5).standard_normal((dim, SKETCH))


def sketches(vectors: np.ndarray) -> np.ndarray:
    """SKETCH signs of each vector as two words (rows x 2)."""
    return np.packbits(vectors @ _sketch_planes(vectors.shape[1]) >= 0, axis=1).view(np.int64)


def _by_dimension(batch: pa.RecordBatch, column: str):
    """``(rows, matrix)`` of the vectors of each length, some thousand at a time."""
    flat, ends = batch.column(column).flatten().to_numpy(), np.cumsum(batch.column(column).value_lengths().to_numpy())
    dims = np.diff(ends, prepend=0)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for k in range(0, len(rows), 1000):
            at = rows[k : k + 1000]
            yield at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def _once(batches):
    """Batches with one row of each ``cls`` that a task has."""
    done: set[int] = set()
    for batch in batches:
        cls = batch.column("cls").to_numpy()
        new = np.zeros(len(cls), bool)
        new[np.unique(cls, return_index=True)[1]] = True
        new &= np.array([c not in done for c in cls.tolist()], bool)
        done.update(cls[new].tolist())
        if new.any():
            yield batch.filter(pa.array(new))


def _sketched(bits: int, tables: int):
    """One row per distinct vector of a task and table: (key, cls, s1, s2); ``key`` is made of length, table and bucket."""

    def run(batches):
        for batch in _once(batches):
            cls = batch.column("cls").to_numpy()
            for at, m in _by_dimension(batch, "vec"):
                own = cls[at]
                sig, sketch = signatures(m, bits, tables), sketches(m)
                for t in range(tables):
                    key = ((m.shape[1] * tables + t) << 30) | sig[:, t]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=["key", "cls", "s1", "s2"])

    return run


def near_sketches(sketch: np.ndarray, most: int) -> np.ndarray:
    """Labels (smallest place) of the components of sketches (rows x 2) that differ in ``most`` signs or fewer."""
    label, sketch = np.arange(len(sketch)), sketch.view(np.uint64)
    for k in range(0, len(sketch), 256):
        apart = np.bitwise_count(sketch[k : k + 256, None, 0] ^ sketch[None, k:, 0]).astype(np.uint8)
        apart += np.bitwise_count(sketch[k : k + 256, None, 1] ^ sketch[None, k:, 1])
        a, b = np.nonzero(apart <= most)
        label = merge_labels(label, a + k, b + k)
    return label


def _grouped(batches, keys: int):
    """Arrays of the columns of each run of equal keys; rows come sorted by the first ``keys`` columns, which hold integers."""
    held: list[list[np.ndarray]] = []

    def whole():
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(columns[:keys], held[-1], strict=False))
        edges = np.flatnonzero(change)
        bounds = [0, *edges.tolist(), batch.num_rows]
        for low, high in zip(bounds, bounds[1:], strict=False):
            if low in edges and held:
                yield whole()
                held = []
            if high > low:
                held.append([c[low:high] for c in columns])
    if held:
        yield whole()


def _sketch_groups(most: int):
    """Forest ``(a, b)`` of the candidates of groups ``(key, x, y, cls, s1, s2)``."""

    def run(batches):
        for g in _grouped(batches, 3):
            cls, first = np.unique(g[3], return_index=True)
            if len(cls) > 1:
                label = near_sketches(np.stack([g[4][first], g[5][first]], axis=1), most)
                at = np.flatnonzero(label != np.arange(len(cls)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(cls[label[at]]), pa.array(cls[at])], names=["a", "b"])

    return run


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (vectors @ _planes(vectors.shape[1], bits, tables)) >= 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _spread(bits: int, tables: int):
    """One row per vector and table: (dim, tab, bucket, cls, number, vector, all buckets)."""

    def run(batches):
        for batch in batches:
            cls, number = batch.column("cls").to_numpy(), batch.column("number").to_numpy()
            for at, m in _by_dimension(batch, "vec"):
                sig = signatures(m, bits, tables)
                every = [x.astype(np.int32).tobytes() for x in sig]
                raw = _packed(m)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), m.shape[1], np.int32)), pa.array(np.full(len(at), t, np.int32)), pa.array(sig[:, t]), pa.array(cls[at]), pa.array(number[at]), raw, pa.array(every, pa.binary())],
                        names=["dim", "tab", "bucket", "cls", "number", "raw", "every"],
                    )

    return run


def _packed(m: np.ndarray) -> pa.Array:
    """Vectors as bytes, in single precision where that is exact."""
    short = m.astype(np.float32)
    return pa.array([x.tobytes() for x in (short if (short == m).all() else m)], pa.binary())


def _unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raw], dtype=np.float64)


def compare(tab: int, cls, number, vectors, sig, side, cosine: float, across: bool = False):
    """Counts and forest of the links of one group.  ``side``: block of each row; ``across``: only pairs of different blocks count."""
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    ok = (vectors @ vectors.T) / np.outer(norm, norm) >= cosine
    np.fill_diagonal(ok, False)
    if across:
        ok &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(ok, 1))
    if not len(a):
        return None
    new = ~(sig[a, :tab] == sig[b, :tab]).any(axis=1) if tab else np.ones(len(a), bool)
    a, b = a[new], b[new]
    if not len(a):
        return None
    count = np.bincount(a, number[b], len(cls)) + np.bincount(b, number[a], len(cls))
    # Spanning forest: label by the smallest neighbour until nothing changes, keeping one link for each merge.
    label = np.arange(len(cls))
    left, right = [], []
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        hi, lo = np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
        root, first = np.unique(hi, return_index=True)
        left.append(cls[root])
        right.append(cls[lo[first]])
        to = np.arange(len(cls))
        to[root] = lo[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    got = np.flatnonzero(count)
    return cls[got], count[got].astype(np.int64), np.concatenate(left), np.concatenate(right)


def _emitted(found) -> pa.RecordBatch:
    one, n, a, b = found
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, a])), pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(b, pa.int64())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(a), pa.int64())])], names=["a", "b", "n"])


def _compare_groups(cosine: float):
    """Counts and forest of groups ``(dim, tab, bucket, x, y, side, cls, number, raw, every)``."""

    def run(batches):
        for g in _grouped(batches, 5):
            if len(g[0]) > 1:
                sig = np.frombuffer(b"".join(g[9]), np.int32).reshape(len(g[0]), -1)
                found = compare(int(g[1][0]), g[6], g[7], _unpacked(g[8], int(g[0][0])), sig, g[5], cosine, g[3][0] != g[4][0])
                if found is not None:
                    yield _emitted(found)

    return run


def _compare_components(cosine: float):
    """Counts and forest of components or pairs of their parts ``(component, x, y, dim, side, cls, number, vec)``."""

    def run(batches):
        for g in _grouped(batches, 4):
            if len(g[0]) > 1:
                found = compare(0, g[5], g[6], np.stack(g[7]).astype(np.float64), np.zeros((len(g[0]), 1), np.int32), g[4], cosine, g[1][0] != g[2][0])
                if found is not None:
                    yield _emitted(found)

    return run


def _blocked(spread: DataFrame, keys: list[str], name: str, block: int) -> DataFrame:
    """Rows of buckets above ``block`` once for every pair of blocks ``(x, y)`` that theirs belongs to; other buckets are one block."""
    # Hashing again is cheaper than storing the rows.
    hot = cut(spread.groupBy(*keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks")), name)
    return _in_pairs(spread.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Rows dealt to one of ``blocks`` by a hash of ``cls``, once for every pair of blocks ``(x, y)`` that theirs belongs to."""
    cells = rows.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")})


def _links_in_tables(vectors: DataFrame, number: int, cosine: float, recall: float) -> DataFrame:
    """``(a, b, n)`` of links among ``(cls, number, vec)``, each vector compared in the buckets of all tables."""
    bits, tables = plan_tables(number, cosine, recall)
    spread = vectors.repartition(F.col("cls")).mapInArrow(_spread(bits, tables), "dim int, tab int, bucket long, cls long, number long, raw binary, every binary")
    key = ["dim", "tab", "bucket", "x", "y"]
    cells = _blocked(spread, key[:3], "embed-hot", BLOCK).select(*key, "side", "cls", "number", "raw", "every")
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare_groups(cosine), "a long, b long, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    ``n_links``: other rows linked directly, equal vectors included.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, as do vectors of different lengths.  Repeated rows are vectors of their own; null ids
    never name a component that has another id."""
    v = F.col("v")
    double = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    single = df.schema[vec_col].dataType.simpleString() == "array<float>"
    read = df.select(F.col(id_col).cast("long").alias("id"), double.alias("v"), (F.col(vec_col) if single else double).alias("vec")).withColumn("fit", F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(fit, F.lit(False)))
    # Vectors are known by one hash; another tells whether two unlike ones share it, in which case a differently seeded one is taken.
    salt = 0
    while True:
        named = lambda c, salt=salt: c.withColumn("cls", F.when(F.col("fit"), F.xxhash64(F.lit(salt), v)))
        rows = cut(named(read).select("id", "cls", F.when(F.col("fit"), F.xxhash64(F.lit("second"), v)).alias("second")), "embed-rows")
        classes = cut(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("low"), F.count("*").alias("number"), F.min("second").alias("s1"), F.max("second").alias("s2")), "embed-classes")
        if classes.where("s1 <> s2").isEmpty():
            break
        salt += 1
    vectors = named(read).where("fit").select("cls", F.col("vec"))
    bits, tables = plan_tables(classes.count(), cosine, 1 - 0.9 * (1 - recall), MEAN_SKETCHED)
    sketched = vectors.mapInArrow(_sketched(bits, tables), "key long, cls long, s1 long, s2 long")
    key = ["key", "x", "y"]
    cells = _blocked(sketched, ["key"], "embed-hot-sketches", SKETCH_BLOCK).select(*key, "cls", "s1", "s2")
    likely = cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sketch_groups(plan_sketch(cosine, (1 - recall) / 10)), "a long, b long")
    likely = cut(likely.distinct(), "embed-likely")
    groups = cut(connected_components(likely, "a", "b").withColumnRenamed("id", "cls").withColumnRenamed("component", "group"), "embed-groups")
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    placed = groups.join(sizes, "group").join(classes.select("cls", "number"), "cls")
    # One row of each class that has a candidate; equal vectors are merged where they are read, before they travel.
    once = vectors.mapInArrow(_once, vectors.schema)
    met = placed.join(once, "cls").groupBy("cls").agg(F.any_value("group").alias("group"), F.any_value("size").alias("size"), F.any_value("number").alias("number"), F.any_value("vec").alias("vec"))
    met = cut(met, "embed-met")
    whole = met.where(F.col("size") <= DIRECT).withColumn("blocks", F.ceil(F.col("size") / PART).cast("int"))
    whole = _in_pairs(whole).select("group", "x", "y", F.size("vec").alias("dim"), "side", "cls", "number", "vec")
    found = whole.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "dim").mapInArrow(_compare_components(cosine), "a long, b long, n long")
    many = met.where(F.col("size") > DIRECT).select("cls", "number", "vec")
    number = many.count()
    if number:
        found = found.unionAll(_links_in_tables(many, number, cosine, recall))
    found = cut(found, "embed-links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("id", "cls")
    of = cut(classes.select("cls", "low", "number").join(comp, "cls", "left").join(counts, "cls", "left"), "embed-of")
    for x in (likely, groups, met, classes, found):
        drop(x)
    lows = of.groupBy(F.coalesce("component", "cls").alias("component")).agg(F.min("low").alias("component_id"))
    by_class = of.withColumn("component", F.coalesce("component", "cls")).join(lows, "component").select("cls", (F.coalesce("n", F.lit(0)) + F.col("number") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "cls").join(by_class, "cls", "left")
    # A class without any id stands for itself; so does a vector that links with nothing.
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


ORACLE = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) s from v where list_dot_product(e, e) > 0),
l as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.95),
c(it, id, low) as (
  select 0, vec_id, vec_id from embeddings
  union all
  select it + 1, id, new from (
    select it, id, new, bool_or(new < low) over () more from (
      select c.it, c.id, c.low, least(c.low, coalesce(min(o.low), c.low)) new
      from c left join l on l.a = c.id left join c o on o.id = l.b group by c.it, c.id, c.low)) where more),
m as (select id, min(low) component_id from c group by id),
k as (select a, count(*) links from l group by a)
select vec_id, coalesce(links, 0)::bigint n_links, component_id, vec_id = component_id as kept
from embeddings join m on m.id = vec_id left join k on k.a = vec_id
"""
