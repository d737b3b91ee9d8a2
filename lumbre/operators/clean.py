"""Nulls and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError
from lumbre.operators.project import col, require


def drop_nulls(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows without a null in the named (or all) columns. NaN is a value and stays."""
    names = df.columns if names is None else names
    require(df, *names)
    return df.filter(reduce(Column.__and__, (col(n).isNotNull() for n in names), F.lit(True)))


def _identity(df: DataFrame, name: str) -> Column:
    """A key under which floats are equal bit by bit but for NaN: -0.0 differs from 0.0."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.struct(c, c.cast("string").startswith("-"))
    return c


def drop_duplicates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One of each set of equal rows; null equals null. A map-side aggregate, so copies don't travel."""
    return df.dropDuplicates(names) if names else df.dropDuplicates()


def keep_first(df: DataFrame, row_id: str) -> DataFrame:
    """The first by row_id of each set of rows that are equal in all other columns, -0.0 and 0.0 apart."""
    names = [n for n in df.columns if n != row_id]
    keys = [_identity(df, n).alias(f"_k{i}") for i, n in enumerate(names)]
    first = df.groupBy(*keys).agg(F.min(col(row_id)).alias(row_id)).select(row_id)
    return df.join(first, row_id, "left_semi")


def fill_null(df: DataFrame, name: str, value) -> DataFrame:
    """Nulls become a value of the column's type; NaN stays."""
    require(df, name)
    kind = df.schema[name].dataType
    fits = {T.StringType: str, T.BooleanType: bool}.get(type(kind), (int, float))
    if not isinstance(value, fits) or isinstance(value, bool) and not isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType) and isinstance(value, float):
        raise EngineError("TYPE", f"{value!r} does not fit {kind.simpleString()}")
    if isinstance(kind, T.IntegralType) and not -(1 << (bits := {"tinyint": 7, "smallint": 15, "int": 31}.get(kind.simpleString(), 63))) <= value < 1 << bits:
        raise EngineError("OVERFLOW", f"{value} does not fit {kind.simpleString()}")
    return df.withColumn(name, F.coalesce(col(name), F.lit(value).cast(kind)))


def impute_mean(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls of numeric columns become the column's mean: one aggregate row, joined to all."""
    require(df, *names)
    means = df.agg(*(F.avg(col(n)).alias(f"_mean_{i}") for i, n in enumerate(names)))
    out = df.join(F.broadcast(means))  # a single row
    for i, n in enumerate(names):
        out = out.withColumn(n, F.coalesce(col(n).cast("double"), F.col(f"_mean_{i}")))
    return out.select(*df.columns)


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
