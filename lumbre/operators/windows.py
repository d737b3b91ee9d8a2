"""Window functions and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def ranked(df: DataFrame, keys: list[str], order: list[Column], kinds: list[str], tiles: int | None = None) -> DataFrame:
    """Rank columns named after their kinds; all share one sort."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({k: RANKS[k]().over(w) for k in kinds})
    return out.withColumn("ntile", F.ntile(tiles).over(w)) if tiles else out


def lagged(df: DataFrame, keys: list[str], order: list[Column], column: str, steps: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"lag": F.lag(column, steps).over(w), "lead": F.lead(column, steps).over(w)})


def cumulative(df: DataFrame, keys: list[str], order: list[Column], column: str, rows: int | None = None) -> DataFrame:
    """Sum and mean up to each row, over all rows before it or the last `rows` of them, and the first and last value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, 0)
    return df.withColumns({"running_sum": F.sum(column).over(w), "running_avg": F.avg(column).over(w), "first_value": F.first(column).over(w), "last_value": F.last(column).over(w)})


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(time, size).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def sliding(df: DataFrame, time: str, size: str, step: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(time, size, step).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")
