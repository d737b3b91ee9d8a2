"""CSV with declared columns and accounting of bad rows."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError
from lumbre.types import Schema

BAD = "_bad_record"


@dataclass
class CsvTable:
    """rows: the good records, all text. bad: records with another number of fields or a stray quote."""

    rows: DataFrame
    raw: DataFrame

    def _is_bad(self):
        return F.col(BAD).isNotNull() & _any_row(self.rows.columns)

    def bad(self) -> DataFrame:
        return self.raw.filter(self._is_bad()).select(BAD)

    def invalid_rows(self) -> int:
        return self.raw.agg(F.count_if(self._is_bad())).collect()[0][0]


def _any_row(names: list[str]):
    """True of every row. Spark refuses queries on the record column alone, so conditions on it mention the others."""
    return F.pmod(F.hash(*(F.col(f"`{c}`") for c in names)), F.lit(7)) >= 0


def resolve(path: str, script_dir: str | None = None, output: bool = False) -> str:
    """Paths with a scheme stay; others are sought in the working folder, then beside the script. Outputs go beside the script."""
    if "://" in path or os.path.isabs(path):
        return path
    if script_dir and (output or not os.path.exists(path)):
        return os.path.join(script_dir, path)
    return path


def _bytes_of(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise EngineError("IO", f"{path} does not exist")
    return fs.getContentSummary(p).getLength()


def header_of(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """Names in the first non-blank record; they must be distinct and not empty."""
    _bytes_of(spark, path)
    lines = [r.value for r in spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()]
    if not lines:
        raise EngineError("DATA", f"{path} has no header")
    import csv as reader

    names = next(reader.reader([lines[0].removeprefix("﻿")], delimiter=delimiter))
    if any(not n for n in names) or len(set(names)) != len(names):
        raise EngineError("DATA", "header names must be distinct and not empty")
    return names


def load_csv(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool | None = None, max_bytes: int | None = None, max_rows: int | None = None, names: list[str] | None = None) -> CsvTable:
    """Records with quotes and doubled quotes; blank records are skipped, bad ones counted and dropped.

    multiline (quoted line ends) keeps a file from being split among tasks; by default it is on only if some line of the
    file, wherever it stands, has an odd number of quotes. That costs one more scan, which ends at the first such line;
    say multiline=True or False to spare it. Without a cap unless one is given.
    """
    if max_bytes is not None and _bytes_of(spark, path) > max_bytes:
        raise EngineError("LIMIT", f"{path} has more than {max_bytes} bytes")
    names = names or header_of(spark, path, delimiter)
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    # A record is judged by all its fields, whichever are asked for: columns are not pruned before parsing.
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(BAD, T.StringType())])
    raw = spark.read.option("columnPruning", False).csv(
        path, schema=schema, header=True, sep=delimiter, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD,
        enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="\0", maxCharsPerColumn=-1,
    )
    if max_rows is not None and raw.limit(max_rows + 1).count() > max_rows:
        raise EngineError("LIMIT", f"more than {max_rows} rows")
    return CsvTable(raw.filter(F.col(BAD).isNull() & _any_row(names)).drop(BAD), raw)


def load_typed(spark: SparkSession, path: str, schema: Schema, **options) -> DataFrame:
    return schema.apply(load_csv(spark, path, **options).rows)


def stream_csv(spark: SparkSession, folder: str, names: list[str], delimiter: str = ",", max_files: int = 1) -> DataFrame:
    """The files of a folder as a stream, a number of them at a time."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.readStream.schema(schema).option("header", True).option("sep", delimiter).option("escape", '"').option("maxFilesPerTrigger", max_files).csv(folder)
