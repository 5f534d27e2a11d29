"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(u: str, v: str) -> tuple[Column, Column]:
    """End points of an undirected edge, smaller first."""
    return F.least(F.col(u), F.col(v)).alias("u"), F.greatest(F.col(u), F.col(v)).alias("v")


def h_index(values: Column) -> Column:
    """Largest k such that at least k of the values of an array are at least k."""
    falling = F.sort_array(values, asc=False)
    capped = F.transform(falling, lambda x, i: F.least(x.cast("long"), (i + 1).cast("long")))
    return F.aggregate(capped, F.lit(0).cast("long"), lambda s, x: F.greatest(s, x))


def seeded_order(seed: int, *columns: str) -> Column:
    """A pseudo-random order that is the same on every run, every partitioning and every engine: MD5 of the seed and the values."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def seconds(text: Column) -> Column:
    """Seconds of a clock reading ``H:M:S[.f]`` or ``M:S[.f]``; anything else: null."""
    h = F.regexp_extract(text, r"^(?:([0-9]+):)?([0-9]+):([0-9]+(?:\.[0-9]+)?)$", 1)
    m = F.regexp_extract(text, r"^(?:([0-9]+):)?([0-9]+):([0-9]+(?:\.[0-9]+)?)$", 2)
    s = F.regexp_extract(text, r"^(?:([0-9]+):)?([0-9]+):([0-9]+(?:\.[0-9]+)?)$", 3)
    number = lambda c: F.when(c == "", 0.0).otherwise(c.try_cast("double"))
    return F.when(s != "", number(h) * 3600 + number(m) * 60 + number(s))
