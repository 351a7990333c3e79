"""Query op9: the 10 nearest of every hundredth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import neighbours
from .common import table


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {"op9_nearest": op9_nearest}
ORACLES: dict[str, str] = {}
