"""Query op5: all documents in eight shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto.llm.common import table
from skonto.llm.sharding import shard

NAME = "op5_sharding"


def placed(documents: DataFrame) -> DataFrame:
    """The contract's columns, under the law of equal bytes."""
    return shard(documents).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents."""
    return placed(table(spark, sf_dir, "documents"))
