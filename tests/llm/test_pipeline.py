from collections import defaultdict

import corpus_pipeline
from cohesia.llm import bpe, decontam, quality, queries
from cohesia.llm.common import words
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    items = [decontam.shingles(words(r.text.encode())) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = stages["quality"](spark, docs, data)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    scores = model.scores([(r.text or "").encode() for r in rows.values()])
    assert kept == {i for i, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}

    one = stages["simhash"](spark, good, data)
    group = brute_components({i: brute_fp(rows[i].text) for i in kept})
    kept = {i for i in kept if group[i] == i}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept and one.count() == len(kept)

    clean = stages["decontaminate"](spark, one, data)
    shingles = {i: decontam.shingles(words((rows[i].text or "").encode())) for i in kept}
    kept = {i for i in kept if not any(b and 5 * len(b & shingles[i]) >= 4 * len(b) for b in items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == kept

    private = stages["pii"](spark, clean, data)
    assert private.columns == columns
    texts = {r.doc_id: r.text for r in private.collect()}
    assert set(texts) == kept and all(r.n_chars == len(r.text) for r in private.collect())

    final = corpus_pipeline.run(spark, data).collect()
    tok = bpe.tokenizer(queries.BYTE_BPE)
    assert {r.doc_id: r.tokens for r in final} == {i: tok.encode(t).tolist() for i, t in texts.items()}
    assert all(r.exact and r.n_tokens == len(r.tokens) for r in final)


def test_odd_rows(spark, odd_docs, data):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert name == "bpe" or docs.columns == odd_docs.columns
    ids = defaultdict(int)
    for r in docs.collect():
        ids[r.doc_id] += 1
    assert all(n == 1 for i, n in ids.items() if i is not None)
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0
