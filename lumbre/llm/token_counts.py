"""Token counts by an exact length histogram.

Every document is encoded once, only its length is kept, and lengths are aggregated map-side: what moves is one row per
task and distinct length. Sums over the histogram's suffixes answer, for every context limit at once, how many documents
are longer, how many tokens they hold, and what remains if all are cut at the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbre.llm import _shared as S
from lumbre.llm import unit_encoder as U


def _lengths(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = U.encoder(path)
        for b in S.batches_of(batches, 10 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(b.column(0)))], names=["n_tokens"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length. Null texts count as empty."""
    lengths = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(tokenizer or U.default_path()), "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def length_report(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L, read as a context limit:

    docs, tokens            documents of exactly L tokens, and their tokens
    docs_at_least, tokens_at_least   suffix sums over lengths >= L
    truncated_tokens        tokens left if every document is cut at L
    rank_from, rank_to      ranks of those documents by length, from 1: the quantile q is the L whose range holds ceil(q n)

    Repeated rows count each; an empty table gives no rows. The suffix sums run over ranges of 256 lengths, so no task
    holds more than that however long the longest document is.
    """
    h = S.store(histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / 256).alias("cell")), "lengths")
    cells = h.groupBy("cell").agg(F.sum("docs").alias("cell_docs"), F.sum("tokens").alias("cell_tokens"))
    beyond = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = cells.select("cell", F.coalesce(F.sum("cell_docs").over(beyond), zero).alias("docs_beyond"), F.coalesce(F.sum("cell_tokens").over(beyond), zero).alias("tokens_beyond"), F.sum("cell_docs").over(Window.partitionBy(F.lit(1))).alias("total_docs"), F.sum("cell_tokens").over(Window.partitionBy(F.lit(1))).alias("total_tokens"))
    within = Window.partitionBy("cell").orderBy(F.col("n_tokens").desc())
    out = h.join(cells, "cell").select(
        "n_tokens", "docs", "tokens", "total_docs", "total_tokens",
        (F.sum("docs").over(within) + F.col("docs_beyond")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_beyond")).alias("tokens_at_least"),
    )
    shorter = F.col("total_docs") - F.col("docs_at_least")
    return out.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (shorter + 1).alias("rank_from"), (shorter + F.col("docs")).alias("rank_to"),
    )


def answer(report: DataFrame, limits: list[int], quantiles: list[float]) -> tuple[dict[int, dict], dict[float, int]]:
    """Totals for context limits (any, also between lengths) and exact quantiles (nearest rank) from the report."""
    total = report.agg(F.sum("docs").alias("n"), F.sum("tokens").alias("t")).collect()[0]
    by_limit = {}
    for limit in limits:
        # Documents over the limit are those at least as long as the next length.
        row = report.filter(F.col("n_tokens") > limit).orderBy("n_tokens").limit(1).collect()
        over, over_tokens = (row[0]["docs_at_least"], row[0]["tokens_at_least"]) if row else (0, 0)
        by_limit[limit] = {"docs_over": over, "tokens_kept": (total["t"] or 0) - over_tokens + limit * over}
    by_quantile = {}
    for q in quantiles:
        rank = max(1, -(-int(round(q * (total["n"] or 0) * 10**9)) // 10**9))
        row = report.filter((F.col("rank_from") <= rank) & (F.col("rank_to") >= rank)).collect()
        by_quantile[q] = row[0]["n_tokens"] if row else None
    return by_limit, by_quantile


def token_counts(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """length_report of whole texts: null and empty texts are lengths of 0, repeated rows count each, ids play no part and may be null, extra columns are ignored, an empty table gives no rows."""
    return length_report(length_histogram(docs, tokenizer, text_col))
