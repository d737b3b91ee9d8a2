"""Arrow IPC streams as a Spark data source: `spark.read.format("arrow_stream")`, `df.write.format("arrow_stream")`.

A stream has no index, so one file is one task; a folder of streams is read in parallel, a file per task. Record batches
pass to Spark as they are. A written table is a folder with one stream per task, committed as a whole. Paths with a scheme
(file, hdfs, s3, gs) are opened by Arrow's file systems, so executors and driver need share no disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from lumbre.errors import EngineError
from lumbre.operators import project


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _streams_in(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".arrows"))


def _files(path: str) -> list[str]:
    store, at = _located(path)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.NotFound:
        return []
    return _streams_in(store, at) if kind == fs.FileType.Directory else [at]


def _opened(path: str, file: str) -> pa.ipc.RecordBatchStreamReader:
    return pa.ipc.open_stream(_located(path)[0].open_input_stream(file))


def _flat(schema: pa.Schema, max_fields: int) -> pa.Schema:
    if len(schema) > max_fields:
        raise EngineError("LIMIT", f"more than {max_fields} fields")
    for f in schema:
        if pa.types.is_nested(f.type) or pa.types.is_dictionary(f.type):
            raise EngineError("UNSUPPORTED", f"field {f.name} is not a flat scalar")
    return schema


@dataclass
class _File(InputPartition):
    path: str


class ArrowStreamReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], schema: StructType, max_rows: int):
        self.path, self.names, self.schema, self.max_rows = path, names, schema, max_rows

    def partitions(self) -> list[_File]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        n = 0
        with _opened(self.path, partition.path) as stream:
            for batch in stream:
                n += batch.num_rows
                if n > self.max_rows:
                    raise EngineError("LIMIT", f"more than {self.max_rows} rows")
                yield pa.RecordBatch.from_arrays([batch.column(name).cast(target.field(name).type) for name in self.names], schema=target)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class ArrowStreamWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.arrow = to_arrow_schema(schema)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _located(self.path)
        store.create_dir(folder, recursive=True)
        staged, rows = f"{folder}/part-{uuid.uuid4().hex}.staged", 0
        with store.open_output_stream(staged) as f, pa.ipc.new_stream(f, self.arrow) as out:
            for batch in batches:
                out.write_batch(batch.cast(self.arrow) if batch.schema != self.arrow else batch)
                rows += batch.num_rows
        return _Written(staged, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _located(self.path)
        if self.overwrite:
            for old in _streams_in(store, folder):
                store.delete_file(old)
        for m in messages:
            if m is not None:
                store.move(m.path, m.path.removesuffix(".staged") + ".arrows")

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _located(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.path).type != fs.FileType.NotFound:
                store.delete_file(m.path)


class ArrowStreamSource(DataSource):
    """Options: path; columns (comma-separated projection); max_fields (128); max_rows per stream."""

    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def _path(self) -> str:
        if "path" not in self.options:
            raise EngineError("ARGUMENT", "a path is needed")
        return self.options["path"]

    def schema(self) -> StructType:
        files = _files(self._path())
        if not files:
            raise EngineError("IO", f"{self._path()} does not exist")
        with _opened(self._path(), files[0]) as stream:
            own = _flat(stream.schema, int(self.options.get("max_fields", "128")))
        names = [n for n in self.options.get("columns", "").split(",") if n] or own.names
        missing = [n for n in names if n not in own.names]
        if missing:
            raise EngineError("DATA", f"column {missing[0]} does not exist")
        return from_arrow_schema(pa.schema([_widened(own.field(n)) for n in names]))

    def reader(self, schema: StructType) -> ArrowStreamReader:
        return ArrowStreamReader(self._path(), schema.names, schema, int(self.options.get("max_rows", str(10**15))))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowStreamWriter:
        return ArrowStreamWriter(self._path(), schema, overwrite)


def _widened(field: pa.Field) -> pa.Field:
    """Unsigned integers have no Spark type; the next wider one holds them."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}
    kind = wider.get(field.type, field.type)
    if pa.types.is_fixed_size_binary(kind) or pa.types.is_large_binary(kind):
        kind = pa.binary()
    if pa.types.is_large_string(kind):
        kind = pa.string()
    return pa.field(field.name, kind, field.nullable, field.metadata)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    spark.dataSource.register(ArrowStreamSource)
    r = spark.read.format("arrow_stream").option("path", path)
    if columns:
        r = r.option("columns", ",".join(columns))
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


def write(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.sparkSession.dataSource.register(ArrowStreamSource)
    df.write.format("arrow_stream").mode("overwrite" if overwrite else "append").option("path", path).save()


def transform(spark: SparkSession, path: str, out: str, where: tuple[str, str, object] | None, columns: list[str]) -> DataFrame:
    """Filter and projection of a stream into another; null compares false, int64 compares exactly."""
    df = read(spark, path)
    if where:
        name, op, value = where
        df = project.filter_text(df, name, value) if isinstance(value, str) else project.filter_number(df, name, op, value)
    df = project.select(df, columns)
    write(df, out)
    return df
