"""JSON documents: small results of a query, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.errors import EngineError
from lumbre.operators.project import col
from lumbre.types import Schema, binary, safe_number

#: Rows that a single document may hold; more go to `write_rows`, a folder written by all tasks.
DOCUMENT_ROWS = 100_000


def _plain(value):
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def publish(document: dict, path: str) -> None:
    """Written aside, then renamed."""
    path = path.removeprefix("file://")
    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise EngineError("IO", f"{folder} does not exist")
    fd, staged = tempfile.mkstemp(dir=folder, suffix=".staged")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(document, f, ensure_ascii=False, indent=2, default=_plain)
            f.write("\n")
        os.replace(staged, path)
    except BaseException:
        if os.path.exists(staged):
            os.remove(staged)
        raise


def write_rows(df: DataFrame, path: str) -> None:
    """Any number of rows, as JSON lines in a folder."""
    df.write.mode("overwrite").json(path)


def rows_of(df: DataFrame, limit: int = DOCUMENT_ROWS) -> list[dict]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise EngineError("LIMIT", f"more than {limit} rows for one document; write_rows has no such limit")
    return [{k: _plain(v) for k, v in r.asDict().items()} for r in rows]


def table_report(df: DataFrame, name: str, schema: Schema | None = None) -> dict:
    """The document of a table: its columns, roles and rows."""
    rows = rows_of(df)
    meta = {f.name: f.metadata for f in df.schema}
    kinds = {"double": "numerica", "bigint": "numerica", "int": "numerica", "string": "texto"}
    kind = lambda c: meta[c].get("tipo") or (schema.types.get(c) if schema else None) or kinds.get(dict(df.dtypes)[c], "texto")
    role = lambda c: meta[c].get("rol") or (schema.roles.get(c) if schema else None) or "variable"
    return {
        "analisis": name,
        "filas": len(rows),
        "columnas": len(df.columns),
        "variables": [{"nombre": c, "tipo": kind(c), "rol": role(c), "estado": "activa"} for c in df.columns],
        "entradas_categoricas": [{"variable": c} for c in df.columns if role(c) == "entrada_categorica"],
        "salidas_binarias": [{"variable": c} for c in df.columns if role(c) == "salida_binaria"],
        "datos": rows,
    }


def numeric_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per text column read as numbers: valid, invalid, mean, least, greatest; one pass for all."""
    packed = df.agg(
        *(
            F.struct(F.lit(n).alias("columna"), F.count(v).alias("validos"), F.count_if(v.isNull()).alias("invalidos"), F.avg(v).alias("promedio"), F.min(v).alias("minimo"), F.max(v).alias("maximo")).alias(f"c{i}")
            for i, n in enumerate(names)
            for v in [safe_number(col(n))]
        )
    )
    return packed.select(F.explode(F.array(*(f"c{i}" for i in range(len(names))))).alias("x")).select("x.*")


def category_counts(df: DataFrame, name: str, row_id: str | None = None) -> DataFrame:
    """valor, cantidad of a column's non-empty values; in the order of their first row if row_id is given."""
    g = df.filter(col(name).isNotNull() & (col(name) != "")).groupBy(col(name).alias("valor"))
    if row_id:
        return g.agg(F.count(F.lit(1)).alias("cantidad"), F.min(row_id).alias("_first")).orderBy("_first").drop("_first")
    return g.agg(F.count(F.lit(1)).alias("cantidad"))


def binary_profile(df: DataFrame, name: str) -> DataFrame:
    b = binary(col(name))
    ones, zeros = F.count_if(b), F.count_if(~b)
    return df.agg(zeros.alias("ceros"), ones.alias("unos"), F.count_if(b.isNull()).alias("invalidos"), (ones / F.nullif(ones + zeros, F.lit(0))).alias("tasa_unos"))


def dataset_profile(df: DataFrame, name: str, schema: Schema, invalid_rows: int = 0, max_categories: int = 10_000) -> dict:
    numeric = [c for c in df.columns if schema.types.get(c) == "numerica"]
    entries = [c for c in df.columns if schema.roles.get(c) == "entrada_categorica"]
    outputs = [c for c in df.columns if schema.roles.get(c) == "salida_binaria"]
    stats = {r["columna"]: r for r in rows_of(numeric_profile(df, numeric))} if numeric else {}
    out = {"analisis": name, "filas": df.count(), "columnas": len(df.columns), "filas_invalidas": invalid_rows, "variables": [], "entradas_categoricas": [], "salidas_binarias": []}
    for c in df.columns:
        out["variables"].append({"nombre": c, "tipo": schema.types.get(c, "texto"), **stats.get(c, {})})
    for c in entries:
        nulls = df.filter(col(c).isNull() | (col(c) == "")).count()
        counts = rows_of(category_counts(df, c).orderBy(F.col("cantidad").desc(), "valor"), max_categories)
        out["entradas_categoricas"].append({"variable": c, "nulos": nulls, "categorias": counts})
    for c in outputs:
        out["salidas_binarias"].append({"variable": c, **rows_of(binary_profile(df, c))[0]})
    return out


def sales_summary(df: DataFrame, price: str, quantity: str) -> DataFrame:
    """Totals of price * quantity over rows where it is a number above zero; the others are counted as rejected."""
    number = lambda n: safe_number(col(n)) if dict(df.dtypes)[n] == "string" else col(n).cast("double")
    total = number(price) * number(quantity)
    good = total > 0
    return df.select(F.when(good, total).alias("t")).agg(
        F.count(F.lit(1)).alias("filas_vistas"), F.count("t").alias("filas_usadas"), (F.count(F.lit(1)) - F.count("t")).alias("filas_rechazadas"),
        F.sum("t").alias("total"), F.avg("t").alias("promedio"), F.max("t").alias("maxima"), F.min("t").alias("minima"),
    )


def show(df: DataFrame, n: int = 10) -> str:
    """The first n rows, tab-separated, null as `nulo`."""
    lines = ["\t".join(df.columns)]
    lines += ["\t".join("nulo" if v is None else str(v) for v in r) for r in df.limit(n).collect()]
    return "\n".join(lines)
