"""Helpers that the operators of this package share: durable intermediate tables and skew-safe lookups."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java, Python and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of keys or of small rows is broadcast up to this many rows, after counting them.
MAX_BROADCAST_ROWS = 100_000


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share (`spark.checkpoint.dir`); a folder of our own only where it is unset."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        warnings.warn("spark.checkpoint.dir is unset: intermediate tables go to a folder of this machine, which executors elsewhere can't see", stacklevel=2)
        at = tempfile.mkdtemp(prefix="lumbre-")
        sc.setCheckpointDir(f"file://{at}")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/lumbre/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps start from files, so a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files under a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: its cleaner waits for the driver's collectors."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Returns a worker's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def forget() -> None:
    """A worker goes on with other operators' tasks: what those remember (`MEMORIES` of their modules) goes; it changes no result."""
    for name, module in list(sys.modules.items()):
        if name.startswith("lumbre.llm."):
            for memory in getattr(module, "MEMORIES", ()):
                memory.cache_clear()
    gc.collect()
    give_back()


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def lookup_skew_safe(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", hot_groups: int = 1000) -> DataFrame:
    """rows joined with groups (one row per key; `size` counts the key's rows) without gathering a hot key in one task.

    A key with at least total / hot_groups rows is hot. There are at most hot_groups such keys, which bounds the
    broadcast; every other key has few rows, so the shuffle join is even.
    """
    limit = max(1, total // hot_groups)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    keys = F.broadcast(hot.select(F.col(key).alias("_hot_key")))
    at_hot = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(keys, rows[key] == F.col("_hot_key"), "left_anti")
    return at_hot.unionByName(rest.join(cold, key, how), allowMissingColumns=True)


def within_bound(small: DataFrame) -> bool:
    """Whether a stored table may be broadcast."""
    return small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def few_or_merge(small: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is within the bound; else both sides are shuffled."""
    return F.broadcast(small) if within_bound(small) else small.hint("merge")


def lookup_small(rows: DataFrame, small: DataFrame, key: str, salt: str, parts: int = 64) -> DataFrame:
    """rows joined with the stored table small on `key`. Beyond the bound small is not broadcast but shuffled,
    each of its rows to `parts` places: rows of a hot key are dealt among them by the hash of column `salt`."""
    if within_bound(small):
        return rows.join(F.broadcast(small), key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(spread.hint("merge"), [key, "_salt"]).drop("_salt")


def text_hash(text):
    """With a row's id, this tells rows apart, also where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, less the rows named in the stored table dropped (doc_id, text_hash).

    A list within the bound is broadcast and texts stay where they are; with a longer one they are shuffled once and
    probe a hash table of their part of the list, so they are not sorted.
    """
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    gone = F.broadcast(gone) if within_bound(gone) else gone.hint("shuffle_hash")
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone_id")) & (text_hash(docs[text_col]) == F.col("_gone_hash")), "left_anti")


def strings(array: pa.Array | pa.ChunkedArray) -> list[str]:
    """The values as Python strings, several times faster than one scalar after the other."""
    return (array.to_numpy(zero_copy_only=False) if isinstance(array, pa.Array) else array.to_numpy()).tolist()


def batches_of(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that Python holds a bounded number of bytes at once; a single long row stays whole."""
    for batch in batches:
        n = batch.num_rows
        step = n if batch.nbytes <= max_bytes else max(1, n * max_bytes // max(1, batch.nbytes))
        for i in range(0, n, max(1, step)):
            yield batch.slice(i, step)
