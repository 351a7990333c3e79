"""Query op8: the secret scan over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import secrets
from .common import table


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES: dict[str, str] = {}
