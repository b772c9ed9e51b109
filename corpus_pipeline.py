"""Corpus pipeline over `documents`: filter, drop near copies, cut repeats, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.llm import mixing, near_copies, packing, quality_rules, simhash_dedup, suffix_dedup
from locusweave.llm.common import small_batches, written

#: SQL can't express perplexity models, SimHash or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group joined by resemblance 0.8 or more of 5-word shingles."""
    small_batches(spark)
    return simhash_dedup.keep_one(docs, near_copies.near_copies(docs, words=5, least=0.8))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 240 bytes, a few words under fifty; n_chars follows, no row goes."""
    small_batches(spark)
    got = suffix_dedup.remove_repeats(docs, width=240, gram=96).withColumn("text", F.col("_d.kept_text"))
    return got.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again, so that weights are met and none is read more than twice as often."""
    return mixing.mix(docs, repeats=2.0).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
