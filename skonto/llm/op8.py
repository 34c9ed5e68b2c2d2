"""Query op8: near-duplicate documents by the Jaccard similarity of word 5-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.common import table
from skonto.llm.jaccard_join import jaccard_join

NAME = "op8_ngram_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 9 * shared >= 4 * (p.n + q.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, CAST(class_id AS BIGINT) AS class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM d JOIN (SELECT x, min(y) AS class_id FROM reach GROUP BY x) r ON r.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS k FROM link GROUP BY x) l ON l.x = d.doc_id
"""
