"""Query op10: all documents packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skonto.llm.common import table
from skonto.llm.packing import pack

NAME = "op10_best_fit_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return pack(table(spark, sf_dir, "documents"))
