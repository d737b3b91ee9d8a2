"""SQL over a folder of Parquet tables (or a SQLite file), with typed statements and transactions by staging.

Changes are new DataFrames kept in the session; commit writes them to versions of their own and then moves the
pointer file, so readers see all of a transaction or nothing. Raw text is Spark's SQL.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from threading import Timer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError, translated
from lumbre.operators.project import OPERATORS, col, require
from lumbre.plans import nodes as N
from lumbre.types import SQL_TYPES

# Default and greatest limits of a query.
DEFAULTS = {"filas": 10_000, "bytes": 8 << 20, "tiempo": 2000}
MAX_PARAMETERS = 999
_FORBIDDEN = re.compile(r"^\s*(attach|detach|pragma|begin|commit|rollback|savepoint|release)\b", re.IGNORECASE)
_READS = re.compile(r"^\s*(select|with|values|from|table|show|describe|explain)\b", re.IGNORECASE)


class Database:
    """Tables of a folder: each a Parquet folder named in catalog.json. SQLite files open read-only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/").removeprefix("file://")
        self.pending: dict[str, DataFrame] | None = None
        self.declared: dict[str, T.StructType] = {}
        self.group: str | None = None
        self.is_file = os.path.isfile(self.path)
        if self.is_file:
            from lumbre.sources import sqlite

            self.names = {t: t for t in sqlite.tables(self.path)}
        else:
            os.makedirs(self.path, exist_ok=True)
            self.names = self._catalog()

    def _catalog(self) -> dict[str, str]:
        at = os.path.join(self.path, "catalog.json")
        if os.path.exists(at):
            with open(at, encoding="utf-8") as f:
                return json.load(f)
        return {e.removesuffix(".parquet"): e for e in sorted(os.listdir(self.path)) if e.endswith(".parquet")}

    def tables(self) -> list[str]:
        return sorted({*self.names, *(self.pending or {})})

    def table(self, name: str) -> DataFrame:
        if self.pending and name in self.pending:
            return self.pending[name]
        if name not in self.names:
            raise EngineError("DATA", f"table {name} does not exist")
        if self.is_file:
            from lumbre.sources import sqlite

            return sqlite.read(self.spark, self.path, name)
        return self.spark.read.parquet(os.path.join(self.path, self.names[name]))

    # Transactions.
    def begin(self) -> None:
        if self.pending is not None:
            raise EngineError("ARGUMENT", "a transaction is open")
        self.pending = {}

    def rollback(self) -> None:
        if self.pending is None:
            raise EngineError("ARGUMENT", "no transaction is open")
        self.pending = None

    def commit(self) -> None:
        if self.pending is None:
            raise EngineError("ARGUMENT", "no transaction is open")
        new = dict(self.names)
        with translated():
            for name, df in self.pending.items():
                version = f"{name}-{uuid.uuid4().hex}.parquet"
                df.write.parquet(os.path.join(self.path, version))
                new[name] = version
        staged = os.path.join(self.path, f"catalog.{uuid.uuid4().hex}")
        with open(staged, "w", encoding="utf-8") as f:
            json.dump(new, f)
        os.replace(staged, os.path.join(self.path, "catalog.json"))
        self.names, self.pending = new, None

    def _change(self, name: str, df: DataFrame) -> None:
        if self.is_file:
            raise EngineError("UNSUPPORTED", "SQLite files are read-only here; sources.sqlite.store writes one")
        single = self.pending is None
        if single:
            self.begin()
        self.pending[name] = df
        if single:
            try:
                self.commit()
            except EngineError:
                self.pending = None
                raise

    # Typed statements.
    def declare(self, t: N.SqlTable) -> None:
        if len({c for c, _ in t.columns}) != len(t.columns):
            raise EngineError("DATA", f"table {t.name}: columns repeat")
        self.declared[t.name] = T.StructType([T.StructField(c, SQL_TYPES[k]) for c, k in t.columns])
        if t.name in self.names:
            self._check(t.name)

    def create(self, name: str, schema: T.StructType) -> None:
        self._change(name, self.spark.createDataFrame([], schema))

    def _check(self, name: str) -> DataFrame:
        df = self.table(name)
        want = self.declared.get(name)
        if want is None:
            raise EngineError("DATA", f"table {name} is not declared")
        if df.columns != want.names:
            raise EngineError("DATA", f"table {name} has columns {df.columns}, declared are {want.names}")
        for f in want:
            kind = df.schema[f.name].dataType
            whole = isinstance(kind, T.IntegralType)
            if isinstance(f.dataType, T.BooleanType) and whole:
                bad = df.filter(col(f.name).isNotNull() & ~col(f.name).isin(0, 1))
                if not bad.isEmpty():
                    raise EngineError("DATA", f"{name}.{f.name} holds values other than 0 and 1")
                df = df.withColumn(f.name, col(f.name).cast("boolean"))
            elif isinstance(f.dataType, T.LongType) and whole:
                df = df.withColumn(f.name, col(f.name).cast("long"))
            elif kind != f.dataType:
                raise EngineError("TYPE", f"{name}.{f.name} is {kind.simpleString()}, declared is {f.dataType.simpleString()}")
        return df

    def _literal(self, table: str, column: str, value) -> Column:
        fields = {f.name: f.dataType for f in self.declared[table]}
        if column not in fields:
            raise EngineError("DATA", f"{table} has no column {column}")
        kind = fields[column]
        if value is None:
            return F.lit(None).cast(kind)
        ok = {T.LongType: isinstance(value, int) and not isinstance(value, bool), T.DoubleType: isinstance(value, (int, float)) and not isinstance(value, bool), T.StringType: isinstance(value, str), T.BooleanType: isinstance(value, bool)}[type(kind)]
        if not ok:
            raise EngineError("TYPE", f"{value!r} does not fit {table}.{column}")
        return F.lit(value).cast(kind)

    def select(self, s: N.SqlSelect) -> DataFrame:
        df = self._check(s.table)
        require(df, *s.columns)
        if s.where:
            c, op, v = s.where
            if op != "==":
                raise EngineError("UNSUPPORTED", "a typed selection compares by ==")
            df = df.filter(col(c).isNull() if v is None else col(c) == self._literal(s.table, c, v))
        return df.select(*(col(c) for c in s.columns))

    def insert(self, s: N.SqlInsert) -> None:
        df = self._check(s.table)
        if len(s.columns) != len(s.values) or len(set(s.columns)) != len(s.columns):
            raise EngineError("DATA", "columns and values differ in number")
        given = dict(zip(s.columns, s.values))
        for c in given:
            require(df, c)
        row = self.spark.range(1).select(*(self._literal(s.table, c, given.get(c)).alias(c) for c in df.columns))
        self._change(s.table, df.unionByName(row))

    def update(self, s: N.SqlUpdate) -> None:
        df = self._check(s.table)
        c, op, v = s.where
        require(df, c, *(n for n, _ in s.changes))
        if not 1 <= len(s.changes) <= 128 or len({n for n, _ in s.changes}) != len(s.changes):
            raise EngineError("DATA", "1 to 128 columns can be set, each once")
        hit = F.lit(False) if v is None else F.coalesce(OPERATORS[op](col(c), self._literal(s.table, c, v)), F.lit(False))
        self._change(s.table, df.withColumns({n: F.when(hit, self._literal(s.table, n, x)).otherwise(col(n)) for n, x in s.changes}))

    # Raw text.
    def query(self, text: str, parameters: list | None = None, limits: dict[str, int] | None = None) -> DataFrame:
        """A single reading statement; more rows than the limit raise LIMIT, and so does more time."""
        limits = {**DEFAULTS, **(limits or {})}
        if _FORBIDDEN.search(text) or not _READS.search(text):
            raise EngineError("ARGUMENT", "a query must read")
        if len(parameters or []) > MAX_PARAMETERS:
            raise EngineError("LIMIT", "too many parameters")
        with translated():
            for t in self.tables():
                self.table(t).createOrReplaceTempView(t)
            df = self.spark.sql(text, args=list(parameters)) if parameters else self.spark.sql(text)
        return df

    def bounded(self, df: DataFrame, limits: dict[str, int] | None = None) -> list:
        """The rows, within the limits on rows, bytes and time."""
        limits = {**DEFAULTS, **(limits or {})}
        sc, group = self.spark.sparkContext, uuid.uuid4().hex
        self.group = group
        sc.setJobGroup(group, "bounded query", interruptOnCancel=True)
        late: list[bool] = []
        timer = Timer(limits["tiempo"] / 1000, lambda: (late.append(True), sc.cancelJobGroup(group)))
        timer.start()
        try:
            rows = df.limit(limits["filas"] + 1).collect()
        except Exception as e:
            if late:
                raise EngineError("LIMIT", f"more than {limits['tiempo']} ms") from e
            with translated():
                raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if len(rows) > limits["filas"]:
            raise EngineError("LIMIT", f"more than {limits['filas']} rows")
        if sum(len(str(v)) for r in rows for v in r) > limits["bytes"]:
            raise EngineError("LIMIT", f"more than {limits['bytes']} bytes")
        return rows

    def cancel(self) -> None:
        """Stops the bounded query under way; may be called from another thread."""
        if self.group:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def execute(self, text: str, parameters: list | None = None) -> None:
        """CREATE TABLE t (...), CREATE TABLE t AS, INSERT INTO t, UPDATE t SET, DELETE FROM t, DROP TABLE t."""
        if _FORBIDDEN.search(text):
            raise EngineError("ARGUMENT", "not allowed here")
        body = text.strip().rstrip(";")
        if m := re.fullmatch(r"create\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)\s+as\s+(.*)", body, re.I | re.S):
            return self._change(m[1], self.query(m[2], parameters))
        if m := re.fullmatch(r"create\s+table\s+(if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)", body, re.I | re.S):
            if m[2] in self.tables():
                if m[1]:
                    return None
                raise EngineError("DATA", f"table {m[2]} exists")
            fields = []
            for part in m[3].split(","):
                name, _, kind = part.strip().partition(" ")
                low = kind.lower()
                fields.append(T.StructField(name, T.LongType() if "int" in low else T.DoubleType() if "real" in low or "double" in low else T.BooleanType() if "bool" in low else T.StringType()))
            return self.create(m[2], T.StructType(fields))
        if m := re.fullmatch(r"drop\s+table\s+(\w+)", body, re.I):
            if m[1] not in self.names:
                raise EngineError("DATA", f"table {m[1]} does not exist")
            raise EngineError("UNSUPPORTED", "tables are dropped with the folder's catalog")
        if m := re.fullmatch(r"insert\s+into\s+(\w+)\s*(?:\(([\w\s,]+)\))?\s*(values\s*\(.*|select\s.*|with\s.*)", body, re.I | re.S):
            df = self.table(m[1])
            names = [c.strip() for c in m[2].split(",")] if m[2] else df.columns
            new = self.query(m[3], parameters).toDF(*names)
            row = new.select(*((col(c) if c in names else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns))
            return self._change(m[1], df.unionByName(row))
        if m := re.fullmatch(r"delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", body, re.I | re.S):
            return self._change(m[1], self.query(f"SELECT * FROM {m[1]} WHERE NOT coalesce({m[2] or 'true'}, false)", parameters))
        if m := re.fullmatch(r"update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?", body, re.I | re.S):
            df = self.table(m[1])
            changes = dict(re.split(r"\s*=\s*", c.strip(), maxsplit=1) for c in re.split(r",(?![^(]*\))", m[2]))
            require(df, *changes)
            out = ", ".join(f"CASE WHEN coalesce({m[3] or 'true'}, false) THEN CAST({changes[c]} AS {df.schema[c].dataType.simpleString()}) ELSE {c} END AS {c}" if c in changes else c for c in df.columns)
            return self._change(m[1], self.query(f"SELECT {out} FROM {m[1]}", parameters))
        raise EngineError("UNSUPPORTED", f"statement {body[:40]!r}")


def run_sql(spark: SparkSession, program: N.SqlProgram, path: str) -> list[DataFrame]:
    """Results of the queries, in order. An error undoes the open transaction; one left open is undone and reported."""
    db = Database(spark, path)
    out = []
    try:
        for s in program.statements:
            if isinstance(s, N.SqlTable):
                db.declare(s)
            elif isinstance(s, N.SqlSelect):
                out.append(db.select(s))
            elif isinstance(s, N.SqlInsert):
                db.insert(s)
            elif isinstance(s, N.SqlUpdate):
                db.update(s)
            elif isinstance(s, N.SqlRaw):
                out.append(db.query(s.text, s.parameters, program.limits)) if s.is_query else db.execute(s.text, s.parameters)
            else:
                {"iniciar": db.begin, "confirmar": db.commit, "revertir": db.rollback}[s.action]()
    except EngineError:
        db.pending = None
        raise
    if db.pending is not None:
        db.rollback()
        raise EngineError("ARGUMENT", "the transaction was not committed")
    return out
