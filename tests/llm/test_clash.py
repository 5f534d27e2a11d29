"""Extra columns whose names the operators use inside do no harm."""

from pyspark.sql import functions as F

import corpus_pipeline
from cohesia.llm import bpe, decontam, embed_dedup, lm_score, pii, quality, queries, shards, simhash, toxicity, warc

NAMES = ["rest", "row", "c", "c0", "fp", "id", "t", "a", "b", "component_id", "shard", "slot", "unit", "spans", "score", "held_out", "label", "tokens", "k", "start", "end", "hit", "none"]


def crowded(df):
    return df.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES)])


def test_documents(spark, odd_docs, data):
    docs, labels = crowded(odd_docs), spark.createDataFrame([(4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some benchmark item of more than five words")], "item_id long, text string")
    n = docs.count()
    assert bpe.encode(docs, queries.BYTE_BPE).count() == n
    assert shards.shard_documents(docs, 4).count() == n
    assert simhash.near_groups(docs).count() == n
    assert lm_score.score_documents(docs).count() == n
    assert toxicity.classify(docs, crowded(labels)).count() == n
    assert quality.classify(docs, labels).count() == n
    assert pii.find(docs).count() == n
    assert decontam.contained(docs, crowded(items)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == odd_docs.columns + NAMES
        assert all(r[m] == f"x{i}" for r in docs.collect() for i, m in enumerate(NAMES))


def test_other_tables(spark, data):
    vectors = crowded(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.001])], "vec_id long, embedding array<float>"))
    assert sorted(r.n_links for r in embed_dedup.near_vectors(vectors).collect()) == [1, 1]
    pages = crowded(spark.createDataFrame([(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000)], "page_id long, url string, html string"))
    assert sorted(r.record_type for r in warc.round_trip(pages).collect()) == ["response", "revisit"]
