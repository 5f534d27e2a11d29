"""Queries of the training-data operators, for the registry in ``__spark_entry__.py``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cohesia.llm import bpe, decontam, embed_dedup, lm_score, pii, quality, shards, simhash, toxicity, warc
from cohesia.llm.common import table

#: Vocabulary file; a parameter of the BPE operators.
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, BYTE_BPE, without=("text",))
    return out.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_shards(spark, sf_dir):
    out = shards.shard_documents(table(spark, sf_dir, "documents"), 16)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op3_simhash(spark, sf_dir):
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_embeddings(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_lm_score(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark, sf_dir):
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontam(spark, sf_dir):
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_shards, op3_simhash, op4_embeddings, op5_lm_score, op6_toxicity, op7_pii, op8_warc, op9_quality, op10_decontam)}
ORACLES: dict[str, str] = {"op4_embeddings": embed_dedup.ORACLE, "op8_warc": warc.ORACLE, "op10_decontam": decontam.ORACLE}
