import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from cohesia.llm import queries, simhash
from cohesia.llm.common import LOWER


def brute_fp(text):
    w = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_query(spark, data):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op3_simhash(spark, data).collect()
    fps = {i: brute_fp(t) for i, t in text.items()}
    want = brute_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in text}


def near(rnd, n, spread):
    base = rnd.getrandbits(64)
    out = [base]
    for _ in range(n):
        x = out[rnd.randrange(len(out))] if spread else base
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    fps = near(rnd, 250, True) + near(rnd, 250, False) + [rnd.getrandbits(64) for _ in range(400)] + [0, 0, (1 << 64) - 1, 7]
    rows = {i: f for i, f in enumerate(fps)}
    signed = [(i, int(np.uint64(f).view(np.int64))) for i, f in rows.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    want = brute_components(rows)
    for hot in (simhash.HOT, 20):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
        assert got == want


def test_forest_ways_agree(monkeypatch):
    rnd = random.Random(9)
    fps = np.unique(np.array([x & 0xFFFFFF for x in near(rnd, 300, True)] + [rnd.getrandbits(24) for _ in range(300)], dtype=np.uint64))

    def groups():
        a, b = simhash.forest(fps)
        up = brute_components({int(x): int(x) for x in fps})
        assert all(up[int(x)] == up[int(y)] for x, y in zip(a, b, strict=True))
        return len(a) == len(set(b.tolist())) == len(fps) - len(set(up.values()))

    assert groups()
    monkeypatch.setattr(simhash, "HOT", 1)
    assert groups()


def test_long_list_in_time_of_its_length():
    rnd = np.random.default_rng(3)
    fps = np.unique(rnd.integers(0, 1 << 24, 100_000, dtype=np.uint64) << np.uint64(40))
    began = time.time()
    a, b = simhash.forest(fps)
    assert time.time() - began < 60
    assert len(a) == len(set(b.tolist())) and not np.isin(a, b).any()
    # 2,324 neighbours within 3 bits of 24: a random list of this length hangs together but for few.
    assert len(fps) - len(a) < 50


def test_lists_across_batches_of_rows():
    rnd = random.Random(4)
    lists = [(0, k, sorted({rnd.getrandbits(20) for _ in range(n)})) for k, n in enumerate([3, 70_000, 1, 60_000, 40])]
    rows = [(b, k, f) for b, k, fps in lists for f in fps]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 9_000], strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["block", "key", "fp"]) for i in range(0, len(rows), 9_000)]
    got = sum(x.num_rows for x in simhash._links(batches))
    assert got == sum(len(simhash.forest(np.array(fps, np.uint64))[0]) for _, _, fps in lists)


def test_keep_first_looks_at_rows_not_ids(spark):
    schema = "doc_id long, text string, lang string"
    copy, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "xyz")
    rows = [(3, copy, "en"), (5, copy, "en"), (5, other, "en"), (None, copy, "en"), (None, third, None), (None, third, None), (7, third + " a", "en"), (9, other, None), (9, other, None)]
    kept = simhash.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(3, "x"), (5, "y"), (7, "z")]
    twice = [(1, copy, "en")] * 3 + [(1, other, "en")]
    assert sorted(r.text[0] for r in simhash.keep_first(spark.createDataFrame(twice, schema)).collect()) == ["x", "y"]


def test_odd(spark, odd_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r.id].add((r.fp, r.component_id))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert by[4] == {(by[5].copy().pop()[0], 4)}
    assert simhash.near_groups(odd_docs.limit(0)).count() == 0
    kept = simhash.keep_first(odd_docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 6, 7, 8]
    assert [r.text for r in kept if r.doc_id is None] == ["no id here at all"]
