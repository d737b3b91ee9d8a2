"""Folders that the driver and all executors share, for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; one of our own on this machine only where that is unset, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='lumbre-')}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path that nothing has used."""
    return f"{shared_folder(spark)}/lumbre/{label}-{uuid.uuid4().hex}"
