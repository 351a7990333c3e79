"""Query op5: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import pii
from .common import table


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(pii.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.joined_spans(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_term"),
    )


QUERIES = {"op5_pii_spans": op5_pii_spans}
ORACLES: dict[str, str] = {}
