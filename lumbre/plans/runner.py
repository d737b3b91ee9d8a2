"""Runs scripts: each analysis becomes one lazy DataFrame, each command or export one action on it."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lumbre import operators as O
from lumbre.errors import EngineError, translated
from lumbre.functions import finance, statistics, tensors
from lumbre.functions.user import Program as Functions
from lumbre.operators.aggregate import Metric
from lumbre.plans import nodes as N
from lumbre.plans.parser import parse
from lumbre.plans.sql_block import run_sql
from lumbre.sources import arrow_stream, csv, reports
from lumbre.streaming import bounded
from lumbre.types import Schema

#: Suffix of the file that a command writes beside the export.
SUFFIX = {"perfil_avanzado": "sst", "histograma": "histograma", "normalidad": "normalidad", "tasa": "tasa", "poisson": "poisson", "correlacion": "correlacion", "wilcoxon": "wilcoxon", "chi_cuadrado": "chi_cuadrado", "riesgo": "riesgo", "modelo_sst": "modelo_sst", "interes_simple": "interes_simple"}


@dataclass
class Result:
    """What a script computed: tables and command results by name, array statistics in order, function values, SQL results."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    commands: list[tuple[str, DataFrame]] = field(default_factory=list)
    streams: list[dict] = field(default_factory=list)
    statistics: list[tuple[str, object]] = field(default_factory=list)
    values: dict[str, float] = field(default_factory=dict)
    sql: list[DataFrame] = field(default_factory=list)
    written: list[str] = field(default_factory=list)


def _parts(argument: str) -> list[str]:
    return [a.strip() for a in argument.split(",")]


def command(df: DataFrame, name: str, argument: str, source: str = "") -> DataFrame:
    """A # command on a table."""
    a = _parts(argument)
    if name in ("tasa", "poisson"):
        try:
            factor = float(a[2])
        except (IndexError, ValueError) as e:
            raise EngineError("ARGUMENT", f"#{name} needs a factor") from e
        return (statistics.rate if name == "tasa" else statistics.poisson)(df, a[0], a[1], factor)
    if name == "interes_simple":
        from pyspark.sql import functions as F

        out = finance.simple_interest_total(df, *a)
        return out.select(F.lit("interes_simple").alias("operacion"), "filas", "interes_total", F.lit(source).alias("fuente"))
    if name == "modelo_sst":
        return statistics.event_model(df, *a, source=source)
    kernels = {"perfil_avanzado": statistics.advanced_profile, "histograma": statistics.histogram, "normalidad": statistics.normality, "correlacion": statistics.correlation, "wilcoxon": statistics.wilcoxon, "chi_cuadrado": statistics.chi_square, "riesgo": statistics.risk}
    if name not in kernels:
        raise EngineError("UNSUPPORTED", f"#{name}")
    return kernels[name](df, *a)


def _metric(op: str, argument: str) -> Metric:
    a = _parts(argument)
    if op == "percentil":
        if len(a) != 2:
            raise EngineError("ARGUMENT", "percentil takes a column and a percentage")
        return Metric(op, a[0], float(a[1]))
    return Metric(op, argument.strip())


class Runner:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.result = spark, folder, Result()

    def path(self, path: str, output: bool = False) -> str:
        return csv.resolve(path, self.folder, output)

    def run(self, text: str) -> Result:
        program = parse(text)
        with translated():
            functions = Functions(program.functions)
            values: dict[str, float] = {}
            for v in program.variables:
                values[v.name] = self.result.values[v.name] = functions._value(v.value, values, 0)
            for c in program.calls:
                self.result.values[c.name] = functions._value(c, values, 0)
            arrays = {a.name: self.array(a) for a in program.arrays}
            for s in program.statistics:
                self.statistic(s, arrays)
            for a in program.analyses:
                self.analysis(a, functions)
            for s in program.sql:
                self.result.sql.extend(run_sql(self.spark, s, self.path(s.path)))
        return self.result

    @staticmethod
    def array(a: N.Array):
        return tensors.literal(a.values) if a.values is not None else tensors.zeros(*a.shape)

    def statistic(self, s, arrays: dict) -> None:
        """A statistic, a shape or an operation on arrays."""
        for name in [s.left, *([s.right] if isinstance(s.right, str) else [])] if isinstance(s, N.ArrayOperation) else [s.array]:
            if name not in arrays:
                raise EngineError("DATA", f"unknown array {name}")
        if isinstance(s, N.ArrayOperation):
            value = tensors.operate(arrays[s.left], s.op, arrays[s.right] if isinstance(s.right, str) else s.right)
            self.result.statistics.append((f"{s.left} {s.op} {s.right}", value.tolist()))
            return
        if isinstance(s, N.Shape):
            a = arrays[s.array]
            self.result.statistics.append((f"{s.what}({s.array})", {"forma": list(a.shape), "dimensiones": a.ndim, "tamano": a.size}[s.what]))
            return
        out = tensors.reduce(arrays[s.array], s.op, s.p, s.axis, s.keep)
        self.result.statistics.append((f"{s.op}({s.array})", out.tolist() if hasattr(out, "tolist") else float(out)))

    def analysis(self, a: N.Analysis, functions: Functions) -> None:
        load = next((i for i in a.items if isinstance(i, N.Load)), None)
        if load is not None and load.arrow:
            return self.arrow(a, load)
        if load is not None and (load.stream or any(isinstance(i, N.StreamSummary) for i in a.items)):
            return self.stream(a, load)
        arrays, values = {}, dict(self.result.values)
        schema = Schema()
        for i in a.items:
            if isinstance(i, N.Declare):
                kind = schema.types.get(i.name, i.kind) if i.role != "variable" and i.name in schema.types else i.kind
                schema.declare(i.name, kind, i.role)
        df = csv.load_typed(self.spark, self.path(load.path), schema) if load is not None else None
        exported: str | None = None
        for i in a.items:
            if isinstance(i, N.Array):
                arrays[i.name] = self.array(i)
            elif isinstance(i, (N.Statistic, N.Shape, N.ArrayOperation)):
                self.statistic(i, arrays)
            elif isinstance(i, N.Variable):
                values[i.name] = self.result.values[i.name] = functions._value(i.value, values, 0)
            elif isinstance(i, N.Block):
                if i.kind == "exportar":
                    exported = self.path(i.commands[0][1], output=True)
                else:
                    if df is None:
                        raise EngineError("DATA", f"{a.name} has no dataset")
                    df = self.block(df, i)
        if df is None:
            return None
        self.result.tables[a.name] = df
        if exported:
            reports.publish(reports.table_report(df, a.name, schema), exported)
            self.result.written.append(exported)
        for i in a.items:
            if isinstance(i, N.Command) and i.name != "seccion":
                out = command(df, i.name, i.argument, load.path)
                self.result.commands.append((i.name, out))
                if exported:
                    at = f"{exported}.{SUFFIX[i.name]}.json"
                    reports.publish(reports.rows_of(out)[0], at)
                    self.result.written.append(at)

    def block(self, df: DataFrame, b: N.Block) -> DataFrame:
        if b.kind == "limpiar":
            for c, argument in b.commands:
                if c == "nulos" and argument == "eliminar":
                    df = O.drop_nulls(df)
                elif c == "nulos" and argument == "imputar_media":
                    df = O.impute_mean(df, [n for n, k in df.dtypes if k == "double"])
                elif c == "duplicados" and argument == "eliminar":
                    df = O.drop_duplicates(df)
                else:
                    raise EngineError("UNSUPPORTED", f"#{c}({argument!r})")
            return df
        if b.kind == "transformar":
            for c, argument in b.commands:
                if c == "total":
                    m = re.fullmatch(r"\s*(\S+)\s*\*\s*(\S+)\s*", argument)
                    if not m:
                        raise EngineError("PARSE", f"#total({argument!r})")
                    df = O.add_product(df, m[1], m[2])
                elif argument.split() == ["mes", "de", "fecha"]:
                    df = O.add_month(df)
                else:
                    raise EngineError("UNSUPPORTED", f"#{c}({argument!r})")
            return df
        if b.kind == "filtrar":
            return O.filter_number(df, *O.parse_condition(b.commands[0][1]))
        if b.kind == "seleccionar":
            names = [n for _, argument in b.commands for n in _parts(argument)]
            if not 1 <= len(names) <= 32:
                raise EngineError("LIMIT", "1 to 32 columns")
            return O.select(df, names)
        if b.kind == "unir":
            given = dict(b.commands)
            right = csv.load_typed(self.spark, self.path(given["derecha"]), Schema({given["clave"]: "numerica"} if dict(df.dtypes).get(given["clave"]) == "double" else {}))
            return O.join(df, right, [given["clave"]], max_bytes=int(b.limits[0]) if b.limits else None, max_rows=int(b.limits[1]) if b.limits else None)
        metrics = [_metric(c, x) for c, x in b.commands if c not in ("por", "spill")]
        if len(metrics) > 16:
            raise EngineError("LIMIT", "at most 16 metrics")
        if b.kind == "resumir":
            return O.summary(df, metrics)
        key = next(x for c, x in b.commands if c == "por")
        if any(c == "spill" for c, _ in b.commands):
            if len(metrics) != 1:
                raise EngineError("ARGUMENT", "#spill goes with exactly one metric")
            return O.grouped_spill(df, key, metrics[0])
        return O.grouped(df, [key], metrics)

    def stream(self, a: N.Analysis, load: N.Load) -> None:
        path = self.path(load.path)
        started = time.monotonic()
        limits = bounded.Limits(rows=int(load.limits["filas"]) if "filas" in load.limits else None, groups=int(load.limits.get("grupos", 1000)), columns=int(load.limits.get("columnas", 4096)), milliseconds=int(load.limits["tiempo_ms"]) if "tiempo_ms" in load.limits else None)
        where = next(((i.column, i.op, i.literal) for i in a.items if isinstance(i, N.StreamFilter)), None)
        save = next((self.path(i.path, output=True) for i in a.items if isinstance(i, N.Save)), None) or next((self.path(i.commands[0][1], output=True) for i in a.items if isinstance(i, N.Block) and i.kind == "exportar"), None)
        source = bounded.CsvStream(self.spark, path, limits)
        for i in a.items:
            if isinstance(i, N.StreamSummary):
                summary = i
            elif isinstance(i, N.Block) and i.kind == "resumir":
                summary = N.StreamSummary([(c, x) for c, x in i.commands])
            elif isinstance(i, N.Block) and i.kind == "agrupar":
                summary = N.StreamSummary([(c, x) for c, x in i.commands if c not in ("por", "spill")], _parts(next(x for c, x in i.commands if c == "por")), [x for c, x in i.commands if c == "spill"] or None)
            else:
                continue
            if summary.keys:
                document = source.grouped_document(summary.keys, summary.metrics, where, spill=summary.spill)
            else:
                document = source.summary_document(summary.metrics, where)
            document["tiempo_ms"] = int(1000 * (time.monotonic() - started))
            self.result.streams.append(document)
            if save:
                reports.publish(document, save)
                self.result.written.append(save)

    def arrow(self, a: N.Analysis, load: N.Load) -> None:
        where = next(((i.column, i.op, i.literal) for i in a.items if isinstance(i, N.StreamFilter)), None)
        columns = next((i.columns for i in a.items if isinstance(i, N.Project)), None)
        save = next((i.path for i in a.items if isinstance(i, N.Save)), None)
        if columns is None or save is None:
            raise EngineError("PARSE", "an Arrow stream needs proyectar and guardar")
        at = self.path(save, output=True)
        self.result.tables[a.name] = arrow_stream.transform(self.spark, self.path(load.path), at, where, columns)
        self.result.written.append(at)


def run_script(spark: SparkSession, text: str, folder: str | None = None) -> Result:
    return Runner(spark, folder).run(text)


def run_file(spark: SparkSession, path: str) -> Result:
    with open(path, encoding="utf-8") as f:
        return run_script(spark, f.read(), os.path.dirname(os.path.abspath(path)))
