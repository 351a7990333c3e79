"""Query op11: fingerprints of all documents, and of what edits make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fingerprints
from .common import table


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.encoded(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.encoded(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op11_fingerprints": op11_fingerprints}
ORACLES: dict[str, str] = {}
