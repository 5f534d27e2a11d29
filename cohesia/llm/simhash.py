"""SimHash near-dedup through an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes.  The index keeps
posting lists for sets of 4 byte positions: the 14 four-subsets of the positions whose numbers xor to zero (the Steiner
system S(3,4,8)), in which every choice of 3 differing bytes leaves at least one set untouched, so that every linked pair meets in a
list, and pairs with exactly 3 differing bytes in one list only.  Inside a list the shared positional bytes of a pair are tallied,
pairs below 5 are dropped, and the rest are verified by their differing bits.

Equal fingerprints are merged before the index, so copies never form pairs.  Lists longer than ``HOT`` are divided by a
fifth byte, after which 24 free bits bound a list to 2**24 fingerprints (128 MB) however large the table is; such a list is searched in
time proportional to its length.  A list emits the components of its links as a forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohesia.llm.common import add_columns, words
from cohesia.operators.components import connected_components, merge_labels
from cohesia.storage import cut, drop

MAX_BITS, SHARED_BYTES, SHINGLE = 3, 5, 3
#: Posting lists above this length are divided by one more byte.
HOT = 4096
#: Lists up to this length are compared together with others in vector passes over neighbours.
SMALL = 48

BLOCKS4 = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
BLOCKS5 = list(combinations(range(8), 5))


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of a text: XXH64 (seed 42) of its word shingles, repeats included; a bit is set if it is set in over
    half of them.  Fewer words than ``size``: the whole sequence; no words: 0."""
    w = words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    n = max(len(w) - size + 1, 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 14):
        part = h[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", without: tuple[str, ...] = ()) -> DataFrame:
    """Append the fingerprint as a signed long.  Null and empty texts: 0."""

    def start():
        return lambda batch: [pa.array(np.array([fingerprint(x) for x in batch.column(0).to_pylist()], dtype=np.uint64).view(np.int64), pa.int64())]

    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(out, T.LongType())], start, without)


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    near = np.bitwise_count(x) <= MAX_BITS
    out = np.zeros(x.shape, bool)
    if near.any():
        out[near] = (np.ascontiguousarray(x[near]).view(np.uint8).reshape(-1, 8) == 0).sum(axis=-1) >= SHARED_BYTES
    return out


def _merge_pairs(fps: np.ndarray) -> np.ndarray:
    """Labels (smallest place of the component) of one list, each row against all others, a block of rows at a time."""
    label = np.arange(len(fps))
    for k in range(0, len(fps), 256):
        a, b = np.nonzero(_linked(fps[k : k + 256, None], fps[None, k:]))
        label = merge_labels(label, a + k, b + k)
    return label


def _merge_flips(fps: np.ndarray, free: list[int]) -> np.ndarray:
    """The same for a list whose fingerprints differ in the three ``free`` bytes only: the 24 free bits address a table, in which the
    neighbours at every flip of 3 bits or fewer are looked up.  The work is proportional to the length of the list, the table takes 64 MB."""
    value = sum(((fps >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * i) for i, p in enumerate(free)).astype(np.int64)
    place = np.full(1 << 24, -1, np.int32)
    place[value] = np.arange(len(fps), dtype=np.int32)
    label = np.arange(len(fps))
    varying = [i for i in range(24) if len(np.unique(value >> i & 1)) > 1]
    for n in range(1, MAX_BITS + 1):
        for flip in combinations(varying, n):
            other = place[value ^ sum(1 << i for i in flip)]
            at = np.flatnonzero(other > np.arange(len(fps)))
            label = merge_labels(label, at, other[at])
        if (label == 0).all():
            break
    return label


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links among distinct fingerprints of one list, as pairs of a member and the first of its component: one fewer than
    members, however many links there are."""
    varying = np.bitwise_or.reduce(fps ^ fps[0]) if len(fps) else np.uint64(0)
    free = [p for p in range(8) if int(varying) >> (8 * p) & 0xFF]
    label = _merge_flips(fps, free) if len(fps) > HOT and len(free) <= 3 else _merge_pairs(fps)
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[at]], fps[at]


def _short_lists(fps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`forest` of many lists at once; ``own``: list of each row, rows of a list together, SMALL at most."""
    label = np.arange(len(fps))
    for d in range(1, SMALL):
        same = np.flatnonzero(own[d:] == own[:-d])
        if not len(same):
            break
        ok = same[_linked(fps[same], fps[same + d])]
        label = merge_labels(label, ok, ok + d)
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[at]], fps[at]


def _links(batches):
    """Links of each list; the rows come sorted by list and fingerprint."""

    def finish(block, key, fp):
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(first, len(fp)))
        fps = fp.view(np.uint64)
        few = np.repeat(size <= SMALL, size)
        found = [_short_lists(fps[few], np.repeat(np.arange(len(first)), size)[few])]
        found += [forest(fps[first[i] : first[i] + size[i]]) for i in np.flatnonzero(size > SMALL)]
        a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])

    held, rows = [], 0
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(new[0]):
            continue
        if held and rows + len(new[0]) >= 100_000:
            # All whole lists go; of a list that goes on, the parts are joined once, at its end.
            edge = np.flatnonzero((new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1]))
            starts_new = new[0][0] != held[-1][0][-1] or new[1][0] != held[-1][1][-1]
            if starts_new or len(edge):
                n = edge[-1] + 1 if len(edge) else 0
                yield from finish(*(np.concatenate([*[h[i] for h in held], new[i][:n]]) for i in range(3)))
                held, rows, new = [], 0, [x[n:] for x in new]
        held.append(new)
        rows += len(new[0])
    if held:
        yield from finish(*(np.concatenate([h[i] for h in held]) for i in range(3)))


def link_fingerprints(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """``(a, b)``: links among distinct fingerprints that leave the components of all links unchanged."""
    fps = distinct.select(F.col(fp).alias("fp"))
    post = lambda sets, shift, src: src.select("fp", F.explode(F.array(*[F.struct(F.lit(shift + i).cast("int").alias("block"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key")) for i, s in enumerate(sets)])).alias("x")).select("x.block", "x.key", "fp")
    lists = post(BLOCKS4, 0, fps)
    hot = cut(lists.groupBy("block", "key").count().where(F.col("count") > HOT).select("block", "key"), "simhash-hot")
    if hot.isEmpty():
        all_lists = lists
    else:
        cold = lists.join(hot, ["block", "key"], "left_anti")
        inside = F.array(*[F.array(*[F.lit(j) for j, five in enumerate(BLOCKS5) if set(four) < set(five)]) for four in BLOCKS4])
        masks = F.array(*[F.lit(_mask(s)) for s in BLOCKS5])
        split = lists.join(hot, ["block", "key"], "left_semi").select("fp", F.explode(F.element_at(inside, F.col("block") + 1)).alias("j"))
        split = split.select((F.col("j") + len(BLOCKS4)).cast("int").alias("block"), F.col("fp").bitwiseAND(F.element_at(masks, F.col("j") + 1)).alias("key"), "fp").distinct()
        all_lists = cold.union(split)
    sorted_lists = all_lists.repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    return sorted_lists.mapInArrow(_links, "a long, b long")


def classes(rows: DataFrame, best: F.Column, fp: str = "fp") -> tuple[DataFrame, DataFrame]:
    """``(fp, component, best)`` of every fingerprint and ``(component, best)`` of every component, with the least value of
    ``best`` (nulls last) among the rows."""
    distinct = cut(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(best).alias("best")), "simhash-fps")
    links = cut(link_fingerprints(distinct), "simhash-links")
    found = connected_components(links, "a", "b").withColumnRenamed("id", "fp")
    of = cut(distinct.join(found, "fp", "left").select("fp", "best", F.coalesce("component", "fp").alias("component")), "simhash-of")
    drop(links)
    drop(distinct)
    return of, of.groupBy("component").agg(F.min("best").alias("best"))


def components(df: DataFrame, id_col: str = "doc_id", fp: str = "fp") -> DataFrame:
    """Append ``component_id``: the smallest id reachable over links of at most 3 differing bits (null ids never
    win; a group without any id has null).  Rows, repeats included, stay as they are."""
    of, low = classes(df, F.col(id_col), fp)
    by_fp = of.drop("best").join(low, "component").select(F.col("fp").alias("_fp"), F.col("best").alias("component_id"))
    return df.drop("component_id").join(by_fp, F.col(fp) == F.col("_fp"), "left").drop("_fp")


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` of every row; an empty table gives an empty table."""
    rows = cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", without=("t",)), "simhash-rows")
    return components(rows, "id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id last.

    A row is known by two hashes over all its columns, not by its id: rows of one id with unlike texts are rows of their own, and of rows that
    are equal in every column any one stays."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    # Whether a column is null goes into the hash too: hashes pass over nulls.
    nulls = F.concat_ws("", *[c.isNull().cast("int") for c in columns])
    keys = {"_k1": F.xxhash64(*columns, nulls), "_k2": F.xxhash64(F.lit("second"), nulls, *columns)}
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"), *[v.alias(k) for k, v in keys.items()])
    rows = cut(fingerprints(named, "t", without=("t",)), "simhash-rows")
    # Of structs the least has the least first field; false comes before true.
    _, low = classes(rows, F.struct(F.col("id").isNull(), "id", "_k1", "_k2"))
    kept = low.select(F.col("best._k1").alias("_k1"), F.col("best._k2").alias("_k2"))
    packed = df.select(F.struct(*columns).alias("c"), *[v.alias(k) for k, v in keys.items()])
    return packed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*[F.col(f"c.`{c}`").alias(c) for c in df.columns])
