"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.ansi.enabled": "true",  # overflow and division by zero raise
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lumbre", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**SETTINGS, **settings}).getOrCreate()


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Numbers rows in the order of the scan; call it before anything shuffles."""
    return df.withColumn(name, F.monotonically_increasing_id())


def scan_partitions(total_bytes: int, target_bytes: int, most: int = 4096) -> list[tuple[int, int]]:
    """Contiguous (offset, length) ranges that cover total_bytes: of target_bytes each, larger if more than `most` would be needed."""
    if total_bytes < 0 or target_bytes <= 0 or most <= 0:
        raise ValueError("sizes must be positive")
    size = max(target_bytes, -(-total_bytes // most))
    return [(at, min(size, total_bytes - at)) for at in range(0, total_bytes, size)]


def scan_settings(total_bytes: int, target_bytes: int, most: int = 4096) -> dict[str, str]:
    """The same plan as settings of Spark's readers, which cut files themselves."""
    size = max((n for _, n in scan_partitions(total_bytes, target_bytes, most)), default=target_bytes)
    return {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.shuffle.partitions": str(max(1, -(-total_bytes // size)))}
