from cohesia.llm import decontam, queries
from cohesia.llm.common import words


def brute(docs, items):
    out = []
    for d, t in docs:
        a = decontam.shingles(words(t.encode() if t is not None else None))
        for i, s in items:
            b = decontam.shingles(words(s.encode() if s is not None else None))
            if b and 5 * len(a & b) >= 4 * len(b):
                out.append((d, i, len(b), len(a & b)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()), key=str)


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want and got(queries.op10_decontam(spark, data)) == want


def test_partial_copies_and_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(base[100 * k : 100 * k + n])) for k, n in enumerate([5, 6, 9, 14, 25, 36, 64, 80])] + [(90, None), (91, ""), (92, "two Words"), (None, "x y z a b c")]
    docs = []
    for k, (i, t) in enumerate(items[:8]):
        w = t.split()
        for cutoff in range(0, len(w), max(1, len(w) // 12)):
            docs.append((1000 * k + cutoff, "pad " * 400 + " ".join(w[cutoff:]).upper() + "\n" + " ".join(f"z{j}" for j in range(500))))
            broken = list(w)
            broken[cutoff] = "changed"
            docs.append((1000 * k + 500 + cutoff, " ".join(broken) + " tail"))
    docs += [(55, "in it: x y z a b c and on"), (None, items[5][1]), (7, None), (8, " "), (9, "TWO words")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    s = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(decontam.contained(d, s)) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    assert got(decontam.contained(d, s)) == want
    dirty = {x[0] for x in want}
    kept = decontam.drop_contaminated(d, s).collect()
    assert sorted(r.doc_id for r in kept) == sorted(x[0] for x in docs if x[0] not in dirty)


def test_odd(spark, odd_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(odd_docs, items).count() == 0
    assert decontam.drop_contaminated(odd_docs, items).count() == odd_docs.count()
    assert decontam.contained(odd_docs.limit(0), items).count() == 0
