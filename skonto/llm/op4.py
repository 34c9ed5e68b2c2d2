"""Query op4: a toxicity score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto.llm.common import table
from skonto.llm.toxicity import THRESHOLD, scored, train

NAME = "op4_toxicity"

HELD_OUT = "coalesce(crc32(cast(id as string)) % 3 = 1, false)"


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; the model learns from labelled rows that are not held out."""
    model = train(documents, labels, ~F.expr(HELD_OUT))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # the text stays behind in the task: only id and score leave it
    return scored(rows, model).select(
        F.col("id").alias("doc_id"), F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all documents."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
