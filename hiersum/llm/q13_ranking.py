"""Query op13: the documents that match each benchmark item best."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ranking
from .common import table


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms(table_: str, key: str) -> str:
    return (
        f"SELECT row_number() OVER () AS row, {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        rf"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {table_}"
    )


SQL = f"""
WITH d AS ({_terms("documents", "doc_id")}), i AS ({_terms("benchmark", "item_id")}),
total AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT row, item_id, unnest(w) AS term FROM i),
tf AS (SELECT row, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term, docs),
s AS (
  SELECT q.row, q.item_id, tf.row AS of, tf.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": SQL}
