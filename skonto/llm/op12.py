"""Query op12: a quarter of all documents, drawn by their likeness to the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.common import table
from skonto.llm.importance import resampled

NAME = "op12_importance_resampling"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all documents and all benchmark items."""
    drawn = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: SQL has no CRC-32, so each different feature's is folded byte by byte.
ORACLE = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT kind, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (
  SELECT kind, row, unnest(w) AS feature FROM w
  UNION ALL SELECT kind, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
coded AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(feature) + 1), lambda i:
      CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)), crc_table),
each AS MATERIALIZED (SELECT kind, row, bucket FROM f JOIN coded USING (feature)),
sums AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM each GROUP BY bucket),
total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM sums, total),
weights AS (
  SELECT row, count(*) AS n, CAST((sum(g) - ((sum(g) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS weight
  FROM each JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score,
    coalesce(weight, 0) AS weight
  FROM (SELECT * FROM w WHERE kind = 'd') LEFT JOIN weights USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scored WHERE words >= 20),
drawn AS (SELECT row, rank FROM ranked WHERE rank <= (SELECT 25 * count(*) // 100 FROM ranked))
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (row)
"""
