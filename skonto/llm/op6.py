"""Query op6: the twenty nearest vectors of every twentieth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto.llm.additive_search import nearest
from skonto.llm.common import table

NAME = "op6_additive_quantisation"

QUERIES = "id % 20 = 0"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.expr(QUERIES))


#: The exact answer, and the operator's: codes rule out only what can't be one.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""
