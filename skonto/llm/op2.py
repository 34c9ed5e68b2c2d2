"""Query op2: the licences that documents state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.common import table
from skonto.llm.licence_texts import TEMPLATES
from skonto.llm.licences import licence_scan

NAME = "op2_licence_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents and all templates."""
    return licence_scan(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH t AS (
  SELECT t, licence, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS wanted
  FROM (SELECT row_number() OVER () AS t, licence, {_WORDS.format(_LOWER.format("body"))} AS w
        FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}) v(licence, body))),
tb AS (SELECT t, licence, len(wanted) AS m, u.bigram, count(*) AS times FROM t, unnest(wanted) u(bigram) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT k, len(w) - 1 AS n, unnest(range(1, len(w))) AS i, w FROM d WHERE len(w) > 1),
hit AS (
  SELECT k, n, i - 1 AS pos, t, licence, m, times, bigram, least(m, n) AS l
  FROM (SELECT k, n, i, w[i] || ' ' || w[i + 1] AS bigram FROM b) JOIN tb USING (bigram)
  QUALIFY 3 * count(*) OVER (PARTITION BY k, t) >= 2 * m AND 3 * n >= 2 * m),
run AS (SELECT DISTINCT k, t, l, unnest(range(greatest(pos - l + 1, 0), least(pos, n - l) + 1)) AS s FROM hit),
had AS (
  SELECT k, t, s, bigram, licence, m, l, least(times, count(*)) AS shared
  FROM run JOIN hit USING (k, t, l) WHERE pos BETWEEN s AND s + l - 1 GROUP BY k, t, s, bigram, licence, m, l, times),
found AS (SELECT k, licence, m, 2 * sum(shared) / (m + l) AS dice, sum(shared) AS shared, l FROM had GROUP BY k, t, s, licence, m, l),
hits AS (SELECT k, licence, m, dice FROM found WHERE 10 * shared >= 4 * (m + l)),
best AS (SELECT k, licence, dice FROM hits QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, m DESC, licence) = 1),
every AS (SELECT k, string_agg(licence, ',' ORDER BY licence) AS licences, count(*) AS n FROM (SELECT DISTINCT k, licence FROM hits) GROUP BY k)
SELECT doc_id, best.licence, best.dice, coalesce(licences, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_licences
FROM d LEFT JOIN best USING (k) LEFT JOIN every USING (k)
"""
