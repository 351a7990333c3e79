"""Query op3: all documents, mixed to the sources' target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import mixing
from .common import table

#: A source's words end within this share of its target, where any choice of copies does.
WITHIN = 0.01


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), within=WITHIN).select("doc_id", "size", "source_size", "target", "taken")


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix is not random: sizes, and targets in hundredths of a word."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round(F.col("target") * 100).cast("bigint").alias("target_cents"), (F.col("taken") <= 3 * F.col("size")).alias("within_cap"))


#: The level at which sources are cut solves sum(least(cap, level * weight)) = total; it lies behind the last cap that all sources can reach.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), f AS (
  SELECT a.cap / a.w AS edge, sum(least(b.cap, a.cap / a.w * b.w)) AS reached FROM s a, s b GROUP BY a.source, a.cap, a.w
), e AS (SELECT coalesce(max(edge) FILTER (WHERE reached <= (SELECT sum(source_size) FROM s)), -1) AS edge FROM f), l AS (
  SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) FILTER (WHERE cap / w <= e.edge), 0)) / sum(w) FILTER (WHERE cap / w > e.edge) AS level FROM s, e
)
SELECT d.doc_id, d.size, s.source_size, round(least(s.cap, coalesce(l.level, 0) * s.w) * 100)::BIGINT AS target_cents, true AS within_cap
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
"""

QUERIES = {"op3_source_mix": op3_source_mix, "source_targets": source_targets}
ORACLES = {"source_targets": SQL}
