import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from cohesia.llm import queries, shards


def check(rows, texts, n):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(n))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def spread(rows, most=1.02):
    """Whether bytes, tokens and rows of the shards are within a factor of each other."""
    total = [Counter(), Counter(), Counter()]
    for r in rows:
        for t, n in zip(total, (r["size"], r.tokens, 1), strict=True):
            t[r.shard] += n
    return [max(t.values()) <= most * min(t.values()) for t in total]


def test_all_dimensions_of_a_corpus(spark):
    out = shards.shard_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 16).collect()
    assert spread(out) == [True] * 3


def naive_pack(units, n):
    """Placing without levelling, in plain Python."""
    total = [sum(u[d] for u in units) for d in (1, 2, 3)]
    left, where = [[1.0] * 3 for _ in range(n)], {}
    for u in sorted(units, key=lambda u: (-max(u[d + 1] * n / total[d] for d in range(3)), u[0])):
        v = [u[d + 1] * n / total[d] for d in range(3)]
        fits = [s for s in range(n) if all(left[s][d] - v[d] >= -1e-12 for d in range(3))]
        s = max(fits, key=lambda s: (sum(a * b for a, b in zip(v, left[s], strict=True)), -s)) if fits else max(range(n), key=lambda s: (min(left[s][d] - v[d] for d in range(3)), -s))
        left[s] = [a - b for a, b in zip(left[s], v, strict=True)]
        where[u[0]] = s
    return where


def test_pack_against_naive(monkeypatch):
    rnd = random.Random(2)
    units = [(f"u{i:04d}", rnd.randint(1, 10**6) // rnd.choice([1, 50]), rnd.randint(1, 10**5) // rnd.choice([1, 50]), rnd.randint(1, 300)) for i in range(400)]
    packed = shards.pack(units, 7)
    off = lambda where: max(abs(sum(u[d] for u in units if where[u[0]] == s) * 7 / sum(u[d] for u in units) - 1) for s in range(7) for d in (1, 2, 3))
    assert off(packed) < off(naive_pack(units, 7)) and off(packed) < 0.01
    monkeypatch.setattr(shards, "MOST_STEPS", 0)
    assert shards.pack(units, 7) == naive_pack(units, 7)
    assert shards.pack([], 3) == {}


def test_query_against_plain_python(spark, data):
    """Groups, cells and units by plain Python; the packing itself is compared with a naive one above."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chained(*parts):
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.to_bytes(4, "little"), h)
        return signed(h)

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    key = lambda t: (chained((t or "").encode(), int(t is None)), chained(int(t is None), b"second", (t or "").encode()))
    vector = lambda t: np.array([len((t or "").encode()) + 1, len((t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ").count(""), 1])
    groups, total = {}, np.zeros(3, int)
    for t in rows.values():
        groups[key(t)] = groups.get(key(t), 0) + vector(t)
        total += vector(t)
    units, unit_of = {}, {}
    for (h1, h2), v in groups.items():
        share = max(v * 16 / total)
        assert share <= 1  # none is divided here
        if share > 1 / shards.LARGE:
            unit = f"g:{h1 % (1 << 64):X}:{h2 % (1 << 64):X}:0"
        else:
            level = min(shards.LEVELS - 1, 31 - math.floor(math.log2((h2 % (1 << 64) >> 33) + 1)))
            unit = f"c:{level}:{h1 % shards.CELLS}"
        units[unit] = units.get(unit, 0) + v
        unit_of[h1, h2] = unit
    where = shards.pack([(u, *map(int, v)) for u, v in units.items()], 16)
    for r in queries.op2_shards(spark, data).collect():
        assert r.shard == where[unit_of[key(rows[r.doc_id])]]


def test_query(spark, data):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op2_shards(spark, data).collect()
    check(rows, text, 16)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
    total = Counter()
    for r in rows:
        total[r.shard] += r["size"]
    assert max(total.values()) - min(total.values()) <= max(r["size"] for r in rows)
    where = defaultdict(set)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_balance_and_hot_group(spark):
    rows = [(i, "same text of all" if i % 3 == 0 else f"text {i} " + "w " * (i % 97), "en", "s", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = shards.shard_documents(df, 8).collect()
    check(out, rows, 8)
    assert spread(out) == [True] * 3


def test_odd(spark, odd_docs):
    out = shards.shard_documents(odd_docs, 4)
    check(out.collect(), odd_docs.collect(), 4)
    assert shards.shard_documents(odd_docs.limit(0), 4).count() == 0
    assert out.where("id = 1").first()["size"] == 1
