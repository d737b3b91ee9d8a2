"""Projections, filters and derived columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError
from lumbre.types import iso_date, safe_number

OPERATORS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise EngineError("DATA", f"column {n} does not exist")


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def select(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in the order asked for; 1 to 32 distinct names in scripts, any number here."""
    require(df, *names)
    if not names or len(set(names)) != len(names):
        raise EngineError("ARGUMENT", "distinct column names are needed")
    return df.select(*(col(n) for n in names))


def finite(value: Column, what: str) -> Column:
    """value; NaN or an infinity raises."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit(f"DATA: {what} is not finite"))).otherwise(value)


def filter_number(df: DataFrame, name: str, op: str, literal: float) -> DataFrame:
    """Rows whose value compares so with a literal. Nulls go, also for !=; a value that is not finite is an error."""
    require(df, name)
    if op not in OPERATORS:
        raise EngineError("ARGUMENT", f"unknown comparison {op}")
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        raise EngineError("TYPE", f"{name} is not numeric")
    value = col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # The plain comparison comes first, so that it reaches the scan; NaN sorts above all numbers and passes only > and !=.
        return df.filter(OPERATORS[op](value, F.lit(float(literal)))).filter(OPERATORS[op](finite(value, name), F.lit(float(literal)))) if op in (">", ">=", "!=") else df.filter(OPERATORS[op](value, F.lit(float(literal))))
    return df.filter(_exact_integer(value, op, literal))


def _exact_integer(value: Column, op: str, literal: float) -> Column:
    """An integer against a real literal without rounding the integer to a double."""
    low = int(literal // 1)
    whole = literal == low
    if not -(1 << 63) <= low < (1 << 63):
        above = literal > 0
        return value.isNotNull() & F.lit(op in (("<", "<=", "!=") if above else (">", ">=", "!=")))
    if op in ("==", "!="):
        return OPERATORS[op](value, F.lit(low)) if whole else value.isNotNull() & F.lit(op == "!=")
    if whole:
        return OPERATORS[op](value, F.lit(low))
    return value > F.lit(low) if op in (">", ">=") else value <= F.lit(low)


def filter_text(df: DataFrame, name: str, literal: str) -> DataFrame:
    require(df, name)
    return df.filter(col(name) == F.lit(literal))


def filter_mask(df: DataFrame, mask: DataFrame, row_id: str, flag: str) -> DataFrame:
    """Rows whose flag is true in mask (row_id, flag)."""
    return df.join(mask.filter(col(flag)).select(col(row_id)), row_id, "left_semi")


def parse_condition(text: str) -> tuple[str, str, float]:
    """`column op number`, blanks around the operator mandatory."""
    m = re.fullmatch(r"\s*(\S+)\s+(>=|<=|==|!=|>|<)\s+(\S+)\s*", text)
    if not m:
        raise EngineError("PARSE", f"condition {text!r}")
    try:
        value = float(m[3])
    except ValueError as e:
        raise EngineError("PARSE", f"number {m[3]!r}") from e
    if value != value or value in (float("inf"), float("-inf")):
        raise EngineError("PARSE", f"number {m[3]!r}")
    return m[1], m[2], value


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise EngineError("DATA", f"column {name} exists")
    return df.withColumn(name, value)


def add_categorical(df: DataFrame, name: str, codes: str, labels: list[str]) -> DataFrame:
    """Labels by their codes from 0; null codes stay null, a code without label raises."""
    require(df, codes)
    code = col(codes)
    known = F.element_at(F.array(*(F.lit(x) for x in labels)), F.greatest(F.least(code.cast("int"), F.lit(len(labels) - 1)), F.lit(0)) + 1)
    return add_column(df, name, F.when(code.isNull(), None).when((code >= 0) & (code < len(labels)), known).otherwise(F.raise_error(F.lit("DATA: code without label"))))


def add_product(df: DataFrame, left: str, right: str, out: str = "total") -> DataFrame:
    """left * right, null if either is; a product that is not finite raises OVERFLOW."""
    require(df, left, right)
    for n in (left, right):
        if not is_number(df, n):
            raise EngineError("TYPE", f"{n} is not numeric")
    product = col(left).cast("double") * col(right).cast("double")
    return add_column(df, out, F.when(F.isnan(product) | (F.abs(product) == float("inf")), F.raise_error(F.lit("OVERFLOW: product is not finite"))).otherwise(product))


def add_month(df: DataFrame, date: str = "fecha", out: str = "periodo") -> DataFrame:
    """YYYY-MM of an ISO date text or of a date; null stays null, another text raises."""
    require(df, date)
    if isinstance(df.schema[date].dataType, T.StringType):
        day = iso_date(col(date))
        day = F.when(col(date).isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("DATA: not a date: "), col(date)))).otherwise(day)
    else:
        day = col(date)
    return add_column(df, out, F.date_format(day, "yyyy-MM"))


def filter_positive_product(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of two text or number columns whose product is over zero."""
    number = lambda n: col(n) if is_number(df, n) else safe_number(col(n))
    require(df, left, right)
    return df.filter(number(left) * number(right) > 0)


def unpivot(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per row and value column; the value columns must share a type."""
    require(df, *ids, *values)
    if len({df.schema[v].dataType for v in values}) != 1:
        raise EngineError("TYPE", "value columns differ in type")
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], variable, value)


def set_metadata(df: DataFrame, name: str, metadata: dict) -> DataFrame:
    require(df, name)
    return df.withMetadata(name, {**df.schema[name].metadata, **metadata})


def column_metadata(df: DataFrame, name: str) -> dict:
    require(df, name)
    return dict(df.schema[name].metadata)


def validate(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df if it has exactly these columns, in this order and of these types."""
    got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in expected]
    if got != want:
        raise EngineError("TYPE", f"columns {got} where {want} are declared")
    return df
