"""Sharding by vector bin packing.

Groups of equal texts are placed whole where the dot product of their (bytes, tokens, rows) with the residual capacity of
the shards is highest.  What is packed is bounded however large the table is: groups above ``1 / LARGE`` of a shard's
capacity are packed one by one (a group larger than a shard in some dimension can't be placed whole and is first divided by a hash of
the ids), and all other groups travel in cells of a hash of the text.  Cells halve in size from level to level, so that the last ones placed
are tiny and the shards end nearly equal.  Only sums per unit come to the driver.

Slots are dealt per shard from 0 without gaps through counts per (shard, bin of ids), so no task numbers a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.storage import cut

#: Groups above this fraction of a shard in any dimension are packed on their own.
LARGE = 64
#: Cells of small groups: levels, and cells a level.
LEVELS, CELLS = 14, 128
#: Steps of levelling, units of a shard looked at for a swap, and how far tokens and rows may be off for the sake of bytes.
MOST_STEPS, PAIRED, SLACK = 1500, 400, 0.005
#: Rows in a bin that one task numbers.
BIN_ROWS = 200_000


def pack(units: list[tuple], shards: int) -> dict:
    """Place ``(key, bytes, tokens, rows)`` into shards, largest first; returns key -> shard.

    Vectors are in shares of a shard's capacity.  Among the shards that stay within capacity in every dimension, the highest dot product with
    the residual wins; if none does, the one that exceeds it by least.  :func:`_level` then mends what the order of placing left uneven."""
    if not units:
        return {}
    units = sorted(units)  # the same places whatever the order of the units
    keys = [u[0] for u in units]
    size = np.array([u[1:] for u in units], dtype=np.float64)
    v = size * shards / np.maximum(size.sum(axis=0), 1)
    left = np.ones((shards, 3))
    where = np.zeros(len(keys), np.int64)
    for i in sorted(range(len(keys)), key=lambda i: (-v[i].max(), keys[i])):
        after = left - v[i]
        fits = (after >= -1e-12).all(axis=1)
        best = int(np.argmax(np.where(fits, left @ v[i], -np.inf))) if fits.any() else int(np.argmax(after.min(axis=1)))
        where[i] = best
        left[best] = after[best]
    _level(v, where, shards)
    return dict(zip(keys, where.tolist(), strict=True))


def _level(v: np.ndarray, where: np.ndarray, shards: int) -> None:
    """Even out all dimensions by moving units or swapping two.

    First the sum of the squared deviations of all shards falls, over all dimensions alike.  Then the bytes, to which the law holds, are
    made as even as they get by steps that leave no other dimension further off than SLACK, or than it was."""
    load = np.zeros((shards, 3))
    np.add.at(load, where, v)
    aim = v.sum(axis=0) / shards

    norm = (v * v).sum(axis=1)
    for _ in range(MOST_STEPS):
        # Change of the sum of squares if unit i moves to shard t, halved.
        change = v @ load.T - (v * load[where]).sum(axis=1)[:, None] + norm[:, None]
        change[np.arange(len(v)), where] = 0
        i, t = np.unravel_index(int(np.argmin(change)), change.shape)
        if change[i, t] < -1e-12:
            load[where[i]] -= v[i]
            load[t] += v[i]
            where[i] = t
            continue
        if not _swap(v, where, load, aim, lambda d: (d * d).sum(axis=-1)):
            break
    others = np.maximum(np.abs(load - aim)[:, 1:].max(axis=0), SLACK)
    for _ in range(MOST_STEPS):
        if not _swap(v, where, load, aim, lambda d: np.where((np.abs(d[..., 1:]) <= others).all(axis=-1), d[..., 0] ** 2, np.inf)):
            break


def _swap(v: np.ndarray, where: np.ndarray, load: np.ndarray, aim: np.ndarray, cost) -> bool:
    """Move a unit, or swap two, between the shard that is furthest off in some dimension and the one furthest off to the other side, if
    that lowers the cost of the two; ``cost`` is of deviations.  At most PAIRED units of each side, those that come closest to what is wanted, are paired."""
    off = load - aim
    pairs = [(int(np.argmax(off[:, d])), int(np.argmin(off[:, d]))) for d in range(3)]
    for hi, lo in dict.fromkeys(pairs):
        if hi == lo:
            continue
        want = (off[hi] - off[lo]) / 2
        a, b = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        nothing = np.zeros((1, 3))
        if len(a) > PAIRED:
            a = a[np.argsort(np.abs(v[a] - want).sum(axis=1), kind="stable")[:PAIRED]]
        if len(b) > PAIRED:
            b = b[np.argsort(v[b].sum(axis=1), kind="stable")[:PAIRED]]
        give, take = np.concatenate([nothing, v[a]]), np.concatenate([nothing, v[b]])
        moved = give[:, None] - take[None]
        now = cost(off[hi]) + cost(off[lo])
        new = cost(off[hi] - moved) + cost(off[lo] + moved)
        i, j = np.unravel_index(int(np.argmin(new)), new.shape)
        if new[i, j] < now * (1 - 1e-9) - 1e-15:
            if i:
                where[a[i - 1]] = lo
            if j:
                where[b[j - 1]] = hi
            load[hi] -= moved[i, j]
            load[lo] += moved[i, j]
            return True
    return False


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, size, text_crc32, tokens, shard, slot)`` for every row.

    ``size``: UTF-8 bytes plus 1 (null text: 1).  ``tokens``: runs of characters other than white space.  Null texts form a group like equal
    texts.  Repeated rows each have a slot.  An empty table gives an empty table."""
    t = F.coalesce(F.col(text), F.lit(""))
    marked = F.when(F.col(text).isNull(), F.lit(1)).otherwise(F.lit(0))
    base = cut(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t).alias("text_crc32"),
            F.regexp_count(t, F.lit(r"[^ \t-\r]+")).cast("long").alias("tokens"),
            F.xxhash64(t, marked).alias("h1"),
            F.xxhash64(marked, F.lit("second"), t).alias("h2"),
        ),
        "shard-rows",
    )
    groups = cut(base.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "shard-groups")
    all_ = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens", "rows")]).first()
    share = F.greatest(*[F.col(c) * F.lit(shards / max(1, all_[c])) for c in ("size", "tokens", "rows")])
    # At most 3 * shards * LARGE groups can be above 1 / LARGE in some dimension.
    large = groups.withColumn("share", share).where(F.col("share") > 1 / LARGE).select("h1", "h2", F.when(F.col("share") > 1, F.ceil(F.col("share") * 4)).otherwise(1).cast("int").alias("pieces"))
    large = large.withColumn("large", F.concat_ws(":", F.lit("g"), F.hex("h1"), F.hex("h2")))
    # Level: leading zeros of a hash; cell: other bits of it.
    level = F.least(F.lit(LEVELS - 1), F.lit(31) - F.floor(F.log2(F.shiftrightunsigned("h2", 33).cast("double") + 1)).cast("int"))
    cell = F.concat_ws(":", F.lit("c"), level, F.pmod("h1", F.lit(CELLS)))
    piece = F.pmod(F.xxhash64("id", "text_crc32"), F.col("pieces"))
    placed = base.join(F.broadcast(large), ["h1", "h2"], "left").withColumn("unit", F.coalesce(F.concat_ws(":", "large", F.when(F.col("large").isNotNull(), piece)), F.lit("")))
    placed = placed.withColumn("unit", F.when(F.col("large").isNull(), cell).otherwise(F.col("unit")))
    most = LEVELS * CELLS + 3 * shards * LARGE * 5 + 3 * shards * 4
    units = placed.groupBy("unit").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()
    if len(units) > most:
        raise ValueError(f"{len(units)} units to pack, {most} at most expected")
    where = pack([tuple(u) for u in units], shards)
    spark = df.sparkSession
    to = spark.createDataFrame(list(where.items()) or [("", 0)], "unit string, shard int")
    bins = max(1, math.ceil(all_["rows"] / BIN_ROWS))
    dealt = cut(
        placed.join(F.broadcast(to), "unit").select("id", "size", "text_crc32", "tokens", "shard", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(bins)).cast("int").alias("bin")),
        "shard-dealt",
    )
    sizes = dealt.groupBy("shard", "bin").count()
    before = sizes.select("shard", "bin", (F.sum("count").over(Window.partitionBy("shard").orderBy("bin")) - F.col("count")).alias("before"))
    order = Window.partitionBy("shard", "bin").orderBy("id", "text_crc32")
    slots = dealt.withColumn("at", F.row_number().over(order) - 1)
    return slots.join(before, ["shard", "bin"]).select("id", "size", "text_crc32", "tokens", "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"))
