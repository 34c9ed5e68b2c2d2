"""Query op13: exact duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.block_names import ROW, exact_groups
from skonto.llm.common import table

NAME = "op13_exact_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over all documents."""
    return exact_groups(table(spark, sf_dir, "documents")).drop(ROW)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, row_number() OVER () AS row,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
