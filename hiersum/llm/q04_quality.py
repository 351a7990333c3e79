"""Query op4: the quality score of every document, learnt from two thirds of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import quality
from .common import table


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> quality.Model:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out()))


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality_score": op4_quality_score}
ORACLES: dict[str, str] = {}
