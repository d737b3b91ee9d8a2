"""Tables of SQLite files: `spark.read.format("sqlite")`. Rows are read in ranges of the rowid, one task each."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from lumbre.errors import EngineError


def _open(path: str) -> sqlite3.Connection:
    path = path.removeprefix("file://")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str):
    """SQLite's affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return StringType()


#: Ranges that a table is cut into at most.
MOST_RANGES = 10_000


@dataclass
class _Range(InputPartition):
    """Rowids from low to high; None: all rows."""

    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, rows_per_task: int):
        self.path, self.table, self.schema, self.rows_per_task = path, table, schema, rows_per_task

    def partitions(self) -> list[_Range]:
        """Ranges of the rowid, at most MOST_RANGES however sparse it is; a view, or a table without rowid, is one task's work."""
        with _open(self.path) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
            if low is None:
                # A view answers null for its rows' ids.
                return [_Range(None, None)] if c.execute(f"SELECT 1 FROM {_quoted(self.table)} LIMIT 1").fetchone() else []
        step = max(self.rows_per_task, -(-(high - low + 1) // MOST_RANGES))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.schema)
        kinds = [f.dataType for f in self.schema]
        with _open(self.path) as c:
            where, bounds = ("", ()) if partition.low is None else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            for row in c.execute(f"SELECT {names} FROM {_quoted(self.table)}{where}", bounds):
                yield tuple(self._value(v, k) for v, k in zip(row, kinds))

    @staticmethod
    def _value(value, kind):
        if value is None:
            return None
        if isinstance(kind, DoubleType) and isinstance(value, (int, float)):
            return float(value)
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else str(value)
        if isinstance(kind, LongType) and isinstance(value, int) or isinstance(kind, BinaryType) and isinstance(value, bytes):
            return value
        raise EngineError("TYPE", f"value {value!r} in a column of {kind.simpleString()}")


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as c:
            info = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not info:
            raise EngineError("DATA", f"table {self.options['table']} does not exist")
        return StructType([StructField(name, _type(kind or "")) for _, name, kind, *_ in info])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows_per_task", "250000")))


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).load()


def tables(path: str) -> list[str]:
    with _open(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def store(df: DataFrame, path: str, table: str, max_rows: int = 1_000_000) -> None:
    """A table of a SQLite file from a DataFrame, in one transaction. One file has one writer, so the driver writes, and the rows are bounded."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise EngineError("LIMIT", f"more than {max_rows} rows for a single-writer file")
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    with sqlite3.connect(path.removeprefix("file://")) as c:
        c.execute(f"DROP TABLE IF EXISTS {_quoted(table)}")
        c.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(f'{_quoted(n)} {kinds.get(k, "TEXT")}' for n, k in df.dtypes)})")
        c.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' for _ in df.columns)})", (tuple(r) for r in df.toLocalIterator()))
