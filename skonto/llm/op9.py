"""Query op9: all pages written as WARC bundles and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.common import table
from skonto.llm.warc import read_bundles, write_bundles

NAME = "op9_warc_bundles"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold."""
    folder, index = write_bundles(table(spark, sf_dir, "pages"))
    return read_bundles(spark, folder, index)


#: DuckDB's sha1 is hexadecimal: its 160 bits are read five at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY sha1(html)) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((CAST(instr('0123456789abcdef', substr(hex, 1 + (5 * k) // 4, 1)) - 1 AS BIGINT) * 16
      + CAST(instr('0123456789abcdef', substr(hex || '0', 2 + (5 * k) // 4, 1)) - 1 AS BIGINT)) >> (3 - (5 * k) % 4)) & 31 AS BIGINT), 1)
    FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
