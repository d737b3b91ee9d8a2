"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

In every stage a null text counts as empty, null ids are carried, extra columns of any name stay, and an empty table gives
an empty one. Rows that repeat id and text are judged alike; exact_dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumbre.llm import _shared, digest_index, near_copies, ordinal, positional_index, trie_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic or of low quality go."""
    return ordinal.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return digest_index.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the row with the smallest id stays.

    By op7's method, SimHash with pivot distance tables before every candidate pair, on fingerprints of 256 bits as
    texts of that similarity differ in more than op7's 3 of 64; the similarity of what is left is exact.
    """
    return near_copies.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return positional_index.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of what is left."""
    return trie_bpe.encode_decode(docs, full=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]
#: The classifier and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents, each stage written to the shared folder and read by the next. A stage's table is deleted once the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = _shared.store(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            _shared.discard(last)
        last = docs
    return docs
