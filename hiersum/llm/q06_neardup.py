"""Query op6: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import neardup
from .common import table


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"), words=2, percent=80)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 2], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 1, 1))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), r AS (
  SELECT s.doc_id, s.g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.g) AS k
  FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g) JOIN n ON n.doc_id = s.doc_id
), p AS (
  -- of two linked sets, the rarest tokens of one beyond a fifth of it must meet such of the other
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT * FROM r WHERE k <= n - (80 * n + 99) // 100 + 1) a JOIN (SELECT * FROM r WHERE k <= n - (80 * n + 99) // 100 + 1) b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), c AS (SELECT p.a, p.b, count(*) AS common FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.g = x.g GROUP BY 1, 2), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, q.component_id, d.doc_id = q.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) q USING (doc_id)
"""

QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLES = {"op6_near_duplicates": SQL}
