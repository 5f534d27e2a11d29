import numpy as np

from cohesia.llm import embed_dedup, queries


def brute(rows, cosine=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))
    n = [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(good):
        a = np.array(rows[i][1], dtype=np.float64)
        for j in good[k + 1 :]:
            if len(rows[j][1]) != len(a):
                continue
            b = np.array(rows[j][1], dtype=np.float64)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                up[find(j)] = find(i)
    low = {}
    for i, (v, _) in enumerate(rows):
        low.setdefault(find(i), []).append(v)
    out = []
    for i, (v, _) in enumerate(rows):
        ids = [x for x in low[find(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((v, n[i], c, v is not None and v == c))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist()) for i in range(300)]
    base = rng.standard_normal(dim)
    rows += [(1000 + i, (base + 0.12 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(2000 + i, rows[7][1]) for i in range(200)]
    chain = rng.standard_normal(dim)
    for i in range(30):
        chain = chain + 0.25 * rng.standard_normal(dim)
        rows.append((500 - i, chain.astype(np.float32).tolist()))
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [None] + [1.0] * (dim - 1)), (3004, [float("nan")] * dim), (3005, [float("inf")] * dim), (None, rows[3][1]), (None, [1.0, 2.0]), (3006, rows[4][1]), (3006, rows[4][1]), (3007, (2 * np.array(rows[4][1])).tolist())]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    assert got(embed_dedup.near_vectors(df)) == want
    monkeypatch.setattr(embed_dedup, "PART", 30)
    assert got(embed_dedup.near_vectors(df)) == want
    monkeypatch.setattr(embed_dedup, "DIRECT", 20)
    assert got(embed_dedup.near_vectors(df)) == want
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "SKETCH_BLOCK", 16)
    assert got(embed_dedup.near_vectors(df)) == want
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(queries.op4_embeddings(spark, data)) == brute(rows)


def test_plan():
    bits, tables = embed_dedup.plan_tables(50_000)
    met = (1 - np.arccos(0.95) / np.pi) ** bits
    assert 1 - (1 - met) ** tables >= 0.99999
