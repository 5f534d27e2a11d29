"""Benchmark decontamination: short test items inside long documents.

An item of n distinct 5-word shingles is contained in a document if at least 80 % of them occur there.  Items are partitioned by
size; in the class of sizes up to u each item is sketched by its ``floor(0.2 u) + SPARE`` smallest shingle hashes (a
bottom-k MinHash of the small set).  The part of a sketch that occurs in a document estimates how far the document contains the item,
whatever the document's length.  A contained item can miss at most floor(0.2 n) shingles, so of a sketch of s hashes at least
s - floor(0.2 n) occur in the document: candidates below that go, and the search loses nothing.  Candidates are verified by their
shingles themselves, not by hashes.

Documents never move: the sketches of a block of items travel to them.  A block is bounded in bytes (one item more at
most); a larger benchmark is taken in several blocks, one pass over the documents for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.llm.common import Remembered, slices, words

SHINGLE, CONTAINED = 5, 0.8
#: Hashes of a sketch beyond those that a contained item may lack.
SPARE = 4
#: UTF-8 bytes of item texts in one block.
BLOCK_BYTES = 16 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 ** (i + 1) % (1 << 64) for i in range(SHINGLE)], dtype=np.uint64)


_hash_of = Remembered(lambda word: xxhash.xxh64_intdigest(word, 7), 125_000, 64)


def shingle_hashes(w: list[bytes]) -> np.ndarray:
    """64-bit hashes of the word 5-shingles (fewer words: of the whole sequence; none: empty)."""
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, w), dtype=np.uint64, count=len(w))
    k = min(SHINGLE, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _MULTIPLIERS[i]
    out ^= out >> np.uint64(29)
    return out + np.uint64(k)


def shingles(w: list[bytes]) -> set[bytes]:
    if not w:
        return set()
    return {b" ".join(g) for g in zip(*(islice(w, i, None) for i in range(SHINGLE)), strict=False)} if len(w) >= SHINGLE else {b" ".join(w)}


def missing(n: int) -> int:
    """Most shingles of n that a contained item may lack."""
    return n - math.ceil(CONTAINED * n - 1e-9)


class Index:
    """Sketches and shingles of one block of items, ``(item_id, text bytes)``."""

    def __init__(self, items: list[tuple]):
        self.items = []
        hashes, owners, least = [], [], []
        for item_id, text in items:
            w = words(text)
            grams = shingles(w)
            if not grams:
                continue
            upper = (1 << len(grams).bit_length()) - 1  # the largest size of its class
            own = np.unique(shingle_hashes(w))
            sketch = own[: max(missing(upper), missing(len(grams))) + SPARE]
            hashes.append(sketch)
            owners.append(np.full(len(sketch), len(self.items)))
            self.items.append((item_id, grams))
            least.append(max(1, len(sketch) - missing(len(grams)) - (len(grams) - len(own))))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], (np.concatenate(owners) if owners else np.zeros(0, int))[order]
        self.least = np.array(least, dtype=np.int64)

    def search(self, text: bytes | None) -> list[tuple]:
        """``(item, shingles, shared)`` of the contained items.  Items of fewer than 5 words match documents of the same words only."""
        w = words(text)
        if not w or not len(self.hashes):
            return []
        h = shingle_hashes(w)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.unique(h[self.hashes[at] == h])
        if not len(hit):
            return []
        left, right = np.searchsorted(self.hashes, hit), np.searchsorted(self.hashes, hit, "right")
        at, times = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(left, right, strict=True)]), return_counts=True)
        found = at[times >= self.least[at]]
        if not len(found):
            return []
        grams, out = shingles(w), []
        for i in found.tolist():
            item_id, own = self.items[i]
            shared = len(own & grams)
            if shared >= len(own) - missing(len(own)):
                out.append((item_id, len(own), shared))
        return out


def blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple]]:
    """The items ``(id, text)`` in blocks of at most BLOCK_BYTES, or one item; the driver holds a block and a partition of the items at a time."""
    pairs = items.select(F.col(id_col).alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null")
    block, size, any_ = [], 0, False
    for r in pairs.toLocalIterator():
        n = len(r.t) + 64
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size, any_ = [], 0, True
        block.append((r.i, bytes(r.t)))
        size += n
    if block or not any_:
        yield block


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for every document row and contained item.

    Null, empty and blank texts contain nothing and are contained nowhere; an item without an id is reported with a null item_id;
    repeated document rows and items give repeated results."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    out = None
    for block in blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in batches:
                for part in slices(batch, 1):
                    got = [(d, *x) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True) for x in index.search(t.as_py())]
                    if got:
                        d, i, n, s = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array([b / a for a, b in zip(n, s, strict=True)], pa.float64())], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows that contain no item, all columns kept; row order and ids, those of the items too, play no part."""
    spark, kept = docs.sparkSession, docs
    for block in blocks(items, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)
        at = docs.columns.index(text)

        def run(batches, shared=shared, at=at):
            index = Index(shared.value)
            for batch in batches:
                clean = [not index.search(t.as_py().encode() if t.is_valid else None) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from benchmark),
ds as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
s as (select distinct item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from i),
n as (select item_id, count(*)::bigint n_shingles from s group by item_id),
c as (select doc_id, item_id, count(*)::bigint n_shared from ds join s using (g) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared::double / n_shingles::double as containment
from c join n using (item_id) where 5 * n_shared >= 4 * n_shingles
"""
