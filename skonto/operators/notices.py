"""Dunning notices: what they add to the ledger, and whether what they claim agrees with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto import domain as D

#: Claimed parts and the entry type that each becomes.
PARTS = (("fees_cents", D.DUNNING_FEE), ("interest_cents", D.LATE_INTEREST), ("flat_fee_cents", D.FLAT_FEE), ("other_costs_cents", D.COLLECTION_COST))


def _parts(claims: DataFrame) -> Column:
    have = [(c, t) for c, t in PARTS if c in claims.columns]
    return F.inline(F.array(*[F.struct(F.lit(t).alias("category"), F.col(c).alias("claimed_cents")) for c, t in have]))


def plan_postings(claims: DataFrame) -> DataFrame:
    """(notice_id, invoice_id, category, posted_cents, lower_cents) in the order in which notices are booked, that of their ids.

    A claim is cumulative: only what goes beyond the largest earlier claim is posted; a lower claim posts nothing and is told.
    """
    rows = claims.select("notice_id", "invoice_id", _parts(claims))
    before = Window.partitionBy("invoice_id", "category").orderBy("notice_id").rowsBetween(Window.unboundedPreceding, -1)
    booked = F.coalesce(F.max("claimed_cents").over(before), F.lit(0))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "notice_id", "invoice_id", "category",
        F.greatest(zero, F.col("claimed_cents") - booked).alias("posted_cents"),
        F.when((F.col("claimed_cents") > 0) & (F.col("claimed_cents") < booked), booked - F.col("claimed_cents")).otherwise(zero).alias("lower_cents"),
    ).where("posted_cents > 0 or lower_cents > 0")


def plan_against(claims: DataFrame, booked: DataFrame) -> DataFrame:
    """Postings of single notices against what is booked: ``booked`` has invoice_id, category, booked_cents."""
    rows = claims.select("notice_id", "invoice_id", _parts(claims)).join(booked, ["invoice_id", "category"], "left")
    have = F.coalesce("booked_cents", F.lit(0))
    return rows.where(F.col("claimed_cents") > have).select("notice_id", "invoice_id", "category", (F.col("claimed_cents") - have).alias("posted_cents"))


def reconcile(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """Each claim with expected_cents at its date, difference_cents and ``issues``.

    ``claims``: notice_id, invoice_id, notice_date, computed_cents (sum of the parts), total_cents (as stated, or 0),
    credited_cents. ``entries``: entry_id, invoice_id, entry_date, entry_type, category, amount_cents, reverses_entry_id.
    """
    claimed = F.when(F.col("total_cents") > 0, F.col("total_cents")).otherwise(F.col("computed_cents"))
    e = entries.where("invoice_id is not null").select("invoice_id", "entry_id", "entry_date", "entry_type", "category", "amount_cents", "reverses_entry_id")
    undone = e.where("reverses_entry_id is not null").groupBy(F.col("reverses_entry_id").alias("entry_id")).agg(F.min("entry_date").alias("undone_on"))
    lines = e.join(undone, "entry_id", "left").select("invoice_id", "entry_date", "entry_type", "category", "amount_cents", "undone_on")
    joined = claims.join(lines, "invoice_id", "left")
    known = F.col("entry_date") <= F.col("notice_date")
    earlier = (F.col("entry_type") == D.PAYMENT) & (F.col("category") == D.PAYMENT) & (F.col("entry_date") < F.col("notice_date"))
    standing = F.col("undone_on").isNull() | (F.col("undone_on") > F.col("notice_date"))
    keys = ["notice_id", "invoice_id", "notice_date", "computed_cents", "total_cents", "credited_cents"]
    sums = joined.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, F.col("amount_cents"))), F.lit(0)).alias("expected_cents"),
        F.coalesce(-F.sum(F.when(earlier & standing, F.col("amount_cents"))), F.lit(0)).alias("paid_before_cents"),
    )
    out = sums.withColumn("claimed_cents", claimed).withColumn("difference_cents", F.col("claimed_cents") - F.col("expected_cents"))
    issues = F.array_compact(
        F.array(
            F.when((F.col("total_cents") > 0) & (F.col("total_cents") != F.col("computed_cents")), "SUM_MISMATCH"),
            F.when(F.col("difference_cents") != 0, "DIFF"),
            F.when((F.col("difference_cents") > 0) & (F.col("paid_before_cents") > 0) & (F.col("credited_cents") < F.col("paid_before_cents")), "PAYMENT_IGNORED"),
        )
    )
    return out.withColumn("issues", F.array_join(issues, ","))


def levels(notices: DataFrame) -> DataFrame:
    """Of each invoice: highest level, latest notice's deadline, largest deadline, number of notices."""
    return notices.groupBy("invoice_id").agg(
        F.max("level").alias("max_level"),
        F.max_by("new_deadline", F.struct("notice_date", "notice_id")).alias("next_deadline"),
        F.max("new_deadline").alias("last_deadline"),
        F.count("*").alias("n_notices"),
    )


def level_histogram(items: DataFrame, notices: DataFrame) -> DataFrame:
    """(level, n_items, open_cents) of open invoices by their highest level, every level."""
    spark = items.sparkSession
    every = spark.range(1, 7).select(F.col("id").cast("int").alias("level"))
    best = notices.groupBy("invoice_id").agg(F.max("level").alias("level"))
    sums = items.join(best, "invoice_id").groupBy("level").agg(F.count("*").alias("n"), F.sum("balance_cents").alias("s"))
    return every.join(sums, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("s", F.lit(0)).alias("open_cents"))


def escalated(notices: DataFrame, least: int = 5) -> DataFrame:
    """(invoice_id) of invoices that reached a level."""
    return notices.where(F.col("level") >= least).select("invoice_id").distinct()
