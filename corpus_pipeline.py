"""A training-data pipeline of five stages over ``documents``.

Each stage works on all rows its predecessor kept and applies its decision: rows of low quality go, one row of each group of near
copies stays, rows that contain a benchmark item go, personal data is replaced, and the texts are encoded.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesia.llm import bpe, decontam, pii, quality, simhash
from cohesia.llm.common import table
from cohesia.llm.queries import BYTE_BPE
from cohesia.storage import cut, drop


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that of the smallest doc_id, rows without one last."""
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that contain a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with whether they decode to it."""
    out = bpe.round_trip(docs.select("doc_id", "text"), BYTE_BPE)
    return out.select("doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality", keep_quality), ("simhash", keep_one_copy), ("decontaminate", drop_benchmark), ("pii", redact), ("bpe", encode)]

#: The random field of the first stage has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
