"""Query op3: a verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.common import table
from skonto.llm.url_rules import ALLOW, BLOCK, filtered

NAME = "op3_url_filter"

#: (verdict, host, path)
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all pages."""
    return filtered(table(spark, sf_dir, "pages"), RULES)
