"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: A table of more rows is never sent whole to the driver and every executor: files are much smaller than their rows in memory, so a join would take it for small.
MOST_SENT = 50_000


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the folder of ``spark.checkpoint.dir`` that nothing else uses; only a local session without the setting gets a folder of its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or getattr(spark, "_skonto_written", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        folder = spark._skonto_written = f"file://{tempfile.mkdtemp(prefix='skonto-')}"
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and read again: what several joins need is made once, and lost executors cost nothing.

    Joins of more than ``MOST_SENT`` rows meet by shuffles.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows.hint("merge") if rows.count() > MOST_SENT else rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over as many tasks as shuffles have, or twice the cores: few files or row groups may hold many rows that cost much each."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)
