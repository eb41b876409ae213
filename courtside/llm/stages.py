"""The stages of corpus_pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import byte_bpe, minhash_dedup, quality_rules, secret_scan, source_mix


#: Bytes of one Arrow batch of texts. Documents differ in length a thousandfold, so a bound in rows alone bounds no memory.
BATCH_BYTES = 4 << 20


#: Workers have been through four other stages by the time they encode, so their memos are smaller than alone.
MEMO = 100_000


def bounded(spark: SparkSession) -> None:
    """The session's Arrow batches hold BATCH_BYTES at most, from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go."""
    bounded(spark)
    entries = quality_rules.ledger(docs, whole_rows=True)
    return quality_rules.apply_policy(entries, "v1").filter("kept").select("doc.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    bounded(spark)
    return minhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are masked in its text."""
    bounded(spark)
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    bounded(spark)
    mixed = source_mix.mix_sources(docs, whole_rows=True).filter("repeats > 0")
    return mixed.select(F.explode(F.array_repeat("doc", F.col("repeats"))).alias("doc")).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    bounded(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, memo=MEMO)
