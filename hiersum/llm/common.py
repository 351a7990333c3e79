"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.  A folder of its own is made only for a local session (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "hiersum-checkpoints"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, outer: int = 0) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so a lost executor costs only a read.

    A table is smaller than a checkpoint of rows, and Spark knows its size.
    Inside ``scratch`` it lives as long as that, or as the one ``outer`` levels around it; without any it stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    scopes = getattr(_open, "scopes", [])
    if len(scopes) > outer:
        scopes[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end.  Nothing lazy that reads them may leave."""
    scopes = _open.scopes = getattr(_open, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in scopes.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` computed once, and broadcast if they are at most ``most``; beyond that joins shuffle."""
    rows = checkpoint(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII rows take the fast built-in, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a let-binding for column expressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Arrow batches in, Arrow batches out."""
    return df.mapInArrow(fn, schema)
