"""Query op7: the language of every document, learnt from three quarters of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import language
from .common import table


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return language.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
