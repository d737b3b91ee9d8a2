"""Sorting, limits and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.operators.project import col, require


def sort_keys(df: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """(column, descending): finite values, then NaN, then null, in either direction."""
    require(df, *(k for k, _ in keys))
    out = []
    for name, descending in keys:
        c = col(name)
        out.append(c.isNull().asc())
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            out.append(F.isnan(c).asc())
        out.append(c.desc() if descending else c.asc())
    return out


def sort(df: DataFrame, keys: list[tuple[str, bool]], row_id: str | None = None) -> DataFrame:
    """A total order by ranges of the keys; row_id breaks ties, which makes it stable."""
    return df.orderBy(*sort_keys(df, keys), *([col(row_id).asc()] if row_id else []))


def head(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(n) if offset else df.limit(n)


def top_k(df: DataFrame, keys: list[tuple[str, bool]], k: int, per: list[str] | None = None) -> DataFrame:
    """The first k rows of the order, or of each group's: each task keeps only its own k (a heap; a window-group limit)."""
    order = sort_keys(df, keys)
    if not per:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def merge_sorted(parts: list[DataFrame], column: str) -> DataFrame:
    """Several runs as one sorted run."""
    return reduce(DataFrame.unionByName, parts).orderBy(col(column))
