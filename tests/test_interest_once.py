"""Claims are made once for all points of their segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from skonto.operators import interest


def test_claims_are_made_once(spark):
    """no stage makes the claims again for payments and for changes of the rate."""
    claims = spark.range(3).select(F.col("id").alias("claim_id"), F.lit(1000).cast("bigint").alias("principal_cents"), F.lit("2024-01-01").cast("date").alias("due_date"), F.lit("2024-01-31").cast("date").alias("until"))
    payments = spark.createDataFrame([(1, "2024-01-11", 400)], "claim_id long, payment_date string, paid_cents long").withColumn("payment_date", F.col("payment_date").cast("date"))
    rates = spark.createDataFrame([("2023-01-01", 300)], "valid_from string, rate_bp int").withColumn("valid_from", F.col("valid_from").cast("date"))
    cut = interest.interest_segments(claims, payments, rates, 900)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 0
    assert sorted((r.claim_id, r.days, r.principal_cents) for r in cut.collect()) == [(0, 30, 1000), (1, 10, 1000), (1, 20, 600), (2, 30, 1000)]
