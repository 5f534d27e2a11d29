"""Shared text conventions and Arrow helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohesia.storage import reach_workers

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased (null: none).

    ``bytes.split()`` splits on exactly these six bytes, none of which occurs inside a multi-byte character."""
    return text.translate(LOWER).split() if text else []


class Remembered(dict):
    """Answers of a function for the keys asked for lately: two generations of ``half`` keys each, so that keys asked for again and again stay.

    Keys longer than ``longest`` are answered but not kept; both only bound memory."""

    def __init__(self, answer: Callable, half: int, longest: int):
        super().__init__()
        self.answer, self.half, self.longest, self.before = answer, half, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.answer(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def table(spark, folder: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (any file system)."""
    reach_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: str = "text") -> F.Column:
    """The text as UTF-8 bytes, so that Python workers need not decode and encode it."""
    return F.col(column).cast("binary")


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most about ``limit`` bytes in a binary column (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def add_columns(df: DataFrame, payload: dict[str, F.Column], new: list[T.StructField], fn: Callable[[], Callable], without: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed by Arrow batches, whatever the names of the other columns are.

    ``payload`` names the inputs of the computation.  ``fn()`` is called once per task and returns a function from
    a record batch with the payload columns to a list of arrays for ``new``.  Existing columns travel along in one
    struct, so clashing names cannot disturb the computation; a new column replaces an old one of its name.
    Columns in ``without`` are left out of the result and do not travel."""
    reach_workers(df.sparkSession)
    keep = [c for c in df.columns if c not in {f.name for f in new} and c not in without]
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    packed = df.select(rest.alias("rest"), *[v.alias(k) for k, v in payload.items()])
    schema = T.StructType([packed.schema["rest"], *new])
    names = [f.name for f in schema.fields]

    def run(batches):
        work = None
        for batch in batches:
            if work is None:
                work = fn()
            for part in slices(batch, 1):
                arrays = work(part.select(list(range(1, part.num_columns))))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in keep], *[F.col(f"`{f.name}`") for f in new])
