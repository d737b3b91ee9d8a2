"""The ten operators as queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import digest_index, hmm, language_id, license_digest, ordinal, positional_index, simhash, token_counts, token_store, trie_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(_table(spark, sf_dir, "documents"))


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.license_scan(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(_table(spark, sf_dir, "documents"), _remainder(5) == 1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), _remainder(4) == 2)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches, so that the second meets what the first has left in the index."""
    return digest_index.exact_dedup(_table(spark, sf_dir, "documents"), batches=2).drop("text_hash")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_bpe_trie, op3_token_counts, op4_quality, op5_decontamination, op6_license_digest, op7_simhash, op8_hmm, op9_language_id, op10_exact_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": positional_index.ORACLE, "op6_license_digest": license_digest.oracle(), "op10_exact_dedup": digest_index.ORACLE}
