"""Summaries of a CSV in one pass, with the row accounting of each kind.

Global: a record with another number of fields is malformed and skipped; a row is valid if all metrics parse; counting
needs a number too. Grouped: a malformed record is an error; a row is valid if at least one metric is usable; counting
needs text that is not blank. Variance is that of a sample, 0 for one value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from threading import Timer
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.errors import EngineError
from lumbre.operators.project import col, require
from lumbre.sources import csv
from lumbre.types import safe_number

#: Most groups a summary may have unless asked otherwise, and in any case.
GROUPS, MOST_GROUPS = 1000, 100_000
SPILL_METRICS = ("suma", "media", "minimo", "maximo", "conteo")


@dataclass(frozen=True)
class Limits:
    rows: int | None = None
    groups: int = GROUPS
    columns: int = 4096
    milliseconds: int | None = None


def filtered(df: DataFrame, where: tuple[str, str, object] | None) -> DataFrame:
    """Text is compared by ==, numbers by >; text that is no number is not over anything."""
    if where is None:
        return df
    name, op, literal = where
    require(df, name)
    if op == "==":
        return df.filter(F.coalesce(col(name), F.lit("")) == F.lit(literal))
    return df.filter(safe_number(col(name)) > F.lit(float(literal)))


def value_of(op: str, number: Column, counted: Column) -> Column:
    n = F.count(number)
    sample = F.when(n == 1, F.lit(0.0)).when(n > 1, F.var_samp(number))
    return {
        "suma": lambda: F.sum(number),
        "media": lambda: F.avg(number),
        "minimo": lambda: F.min(number),
        "maximo": lambda: F.max(number),
        "conteo": lambda: F.count_if(counted).cast("double"),
        "varianza": lambda: sample,
        "desviacion_estandar": lambda: F.sqrt(sample),
    }[op]()


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(col(name), F.lit(""))) == ""


def summary(df: DataFrame, metrics: list[tuple[str, str]]) -> DataFrame:
    """One row: filas, filas_validas, and v0, n0, i0, v1, ... the value and valid and invalid counts of each metric."""
    if not 1 <= len(metrics) <= 64:
        raise EngineError("LIMIT", "1 to 64 metrics")
    require(df, *(c for _, c in metrics))
    numbers = {c: safe_number(col(c)) for _, c in metrics}
    valid = reduce(Column.__and__, (n.isNotNull() for n in numbers.values()))
    out = [F.count(F.lit(1)).alias("filas"), F.count_if(valid).alias("filas_validas")]
    for i, (op, c) in enumerate(metrics):
        out += [value_of(op, numbers[c], numbers[c].isNotNull()).alias(f"v{i}"), F.count(numbers[c]).alias(f"n{i}"), F.count_if(numbers[c].isNull()).alias(f"i{i}")]
    return df.agg(*out)


def grouped(df: DataFrame, keys: list[str], metrics: list[tuple[str, str]]) -> DataFrame:
    """One row per key, in bytewise order (two keys: null first, then by length and bytes of each).

    v, n, u, i of each metric: value, and how many texts were valid, null (blank) and invalid. For one key the empty text
    is a key like any other.
    """
    if not 1 <= len(keys) <= 2:
        raise EngineError("ARGUMENT", "one or two keys")
    require(df, *keys, *(c for _, c in metrics))
    if len(keys) == 1:
        df = df.withColumn(keys[0], F.coalesce(col(keys[0]), F.lit("")))
    else:
        df = df.withColumns({k: F.nullif(col(k), F.lit("")) for k in keys})
    out = [F.count(F.lit(1)).alias("filas")]
    for i, (op, c) in enumerate(metrics):
        number, blank = safe_number(col(c)), _blank(c)
        usable = ~blank if op == "conteo" else number.isNotNull()
        out += [value_of(op, number, ~blank).alias(f"v{i}"), F.count_if(usable).alias(f"n{i}"), F.count_if(blank).alias(f"u{i}"), F.count_if(~blank & ~usable).alias(f"i{i}")]
    order = [o for k in keys for o in ([col(k).isNotNull(), F.octet_length(col(k))] if len(keys) == 2 else []) + [col(k).asc_nulls_first()]]
    return df.groupBy(*(col(k) for k in keys)).agg(*out).orderBy(*order)


class CsvStream:
    """A CSV file or folder, read once per summary; the counters come from the same pass (`observe`)."""

    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None):
        self.spark, self.path, self.limits = spark, path, limits or Limits()
        self.table = csv.load_csv(spark, path, max_rows=None)
        if len(self.table.rows.columns) > self.limits.columns:
            raise EngineError("LIMIT", f"more than {self.limits.columns} columns")

    def _collect(self, df: DataFrame) -> list:
        """The rows, within the time limit."""
        if self.limits.milliseconds is None:
            return df.collect()
        sc, group, late = self.spark.sparkContext, uuid4().hex, []
        sc.setJobGroup(group, "bounded summary", interruptOnCancel=True)
        timer = Timer(self.limits.milliseconds / 1000, lambda: (late.append(True), sc.cancelJobGroup(group)))
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if late:
                raise EngineError("LIMIT", f"more than {self.limits.milliseconds} ms") from e
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def _counted(self):
        from pyspark.sql import Observation

        seen = Observation()
        raw = self.table.raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(csv.BAD)).alias("bad"))
        return raw.filter(F.col(csv.BAD).isNull()).drop(csv.BAD), seen

    def _base(self, counts: dict) -> dict:
        if self.limits.rows is not None and counts["rows"] > self.limits.rows:
            raise EngineError("LIMIT", f"more than {self.limits.rows} rows")
        return {"filas": counts["rows"], "bytes_entrada": csv._bytes_of(self.spark, self.path)}

    def summary_document(self, metrics: list[tuple[str, str]], where: tuple[str, str, object] | None = None) -> dict:
        rows, seen = self._counted()
        r = self._collect(summary(filtered(rows, where), metrics))[0]
        counts = seen.get
        base = self._base(counts)
        results = [{"columna": c, "operacion": op, "nombre": f"{c}_{op}", "valores_validos": r[f"n{i}"], "valores_invalidos": r[f"i{i}"], "valor": r[f"v{i}"]} for i, (op, c) in enumerate(metrics)]
        return {"modo": "flujo", "filas": base["filas"], "filas_validas": r["filas_validas"], "filas_malformadas": counts["bad"] + r["filas"] - r["filas_validas"], "bytes_entrada": base["bytes_entrada"], "limite_columnas": self.limits.columns, "limite_filas": self.limits.rows, "presupuesto_tiempo_ms": self.limits.milliseconds, "resultados": results}

    def grouped_document(self, keys: list[str], metrics: list[tuple[str, str]], where: tuple[str, str, object] | None = None, spill: list | None = None) -> dict:
        if self.limits.groups > MOST_GROUPS:
            raise EngineError("LIMIT", f"more than {MOST_GROUPS} groups")
        if (spill or len(keys) == 2) and any(op not in SPILL_METRICS for op, _ in metrics):
            raise EngineError("UNSUPPORTED", "spilled groups have the five basic metrics")
        rows, seen = self._counted()
        got = self._collect(grouped(filtered(rows, where), keys, metrics).limit(self.limits.groups + 1))
        counts = seen.get
        if counts["bad"]:
            raise EngineError("DATA", f"{counts['bad']} records with another number of fields")
        if len(got) > self.limits.groups:
            raise EngineError("LIMIT", f"more than {self.limits.groups} groups")
        base = self._base(counts)
        results = []
        for r in got:
            m = [{"columna": c, "operacion": op, "nombre": f"{c}_{op}", "valores_validos": r[f"n{i}"], "valores_nulos": r[f"u{i}"], "valores_invalidos": r[f"i{i}"], "valor": r[f"v{i}"]} for i, (op, c) in enumerate(metrics)]
            if len(keys) == 1:
                results.append({"clave": r[keys[0]], "metricas": m})
            else:
                results.append({"claves": [{"valor": r[k], "valido": r[k] is not None} for k in keys], "metricas": m})
        out = {"modo": "flujo_agrupado_spill" if spill or len(keys) == 2 else "flujo_agrupado", "filas": base["filas"], "grupos": len(got), "limite_grupos": self.limits.groups, "bytes_entrada": base["bytes_entrada"], "resultados": results}
        return {**out, "grupo": keys[0]} if len(keys) == 1 else {**out, "columnas_grupo": [{"nombre": k, "tipo": "texto"} for k in keys]}


def single_sum_or_count(df: DataFrame, column: str, op: str) -> DataFrame:
    """SUM or COUNT of one numeric text column; a non-empty text that is no number raises."""
    if op not in ("suma", "conteo"):
        raise EngineError("UNSUPPORTED", op)
    require(df, column)
    number = safe_number(col(column))
    checked = F.when(~_blank(column) & number.isNull(), F.raise_error(F.concat(F.lit("DATA: not a number: "), col(column))).cast("double")).otherwise(number)
    return df.agg((F.sum(checked) if op == "suma" else F.count(checked)).alias("valor"))
