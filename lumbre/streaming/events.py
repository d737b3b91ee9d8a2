"""Event time on Structured Streaming: windows, late data, deduplication, joins and sessions of state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def windowed(events: DataFrame, time: str, delay: str, size: str, step: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Tumbling (no step) or sliding windows; rows later than the delay are dropped from closed windows."""
    w = F.window(time, size, step) if step else F.window(time, size)
    out = events.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def session_windows(events: DataFrame, time: str, delay: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def deduplicated(events: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, delay: str, within: str) -> DataFrame:
    """Pairs of one key whose right row comes at most `within` after the left; watermarks bound the state."""
    a = left.withWatermark(left_time, delay).alias("l")
    b = right.withWatermark(right_time, delay).alias("r")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"r.{right_time}") >= F.col(f"l.{left_time}")) & (F.col(f"r.{right_time}") <= F.col(f"l.{left_time}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total so far, once per key and batch: a state of one row per key, kept in the state store."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Everything there is, then stop. The rows go to Parquet files under the folder `at`, by the executors, beside the query's checkpoint.

    In append mode by the file sink, once each. Complete mode keeps the last batch alone; update mode keeps every batch,
    numbered `_batch`.
    """
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{at}/rows")
    else:
        part = (lambda k: f"{at}/rows") if mode == "complete" else (lambda k: f"{at}/rows/_batch={k}")
        q = w.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(part(k))).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A sink that sees each batch with its number; with a number-keyed write, repeated batches change nothing."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
