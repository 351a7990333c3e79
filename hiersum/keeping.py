"""Tables that are computed once and kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table: where the session's checkpoints are, which all executors share; for a local session without them, a temporary one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """Computed now and read from then on: a checkpoint where the session names a folder, else the cache.

    For tables of cells, which several steps of a plan read.
    """
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    kept = df.persist()
    kept.count()
    return kept
