"""The dashboard: all key figures from one pass over open items and one over entries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.operators.ledger import as_of


def key_figures(invoices: DataFrame, entries: DataFrame, unassigned: DataFrame, notices: DataFrame, day: date, start: date) -> DataFrame:
    """One row: open, overdue, due in 7, 14 and 30 days, credits, paid and charged since ``start``, escalated invoices.

    ``entries`` belong to invoices and are aggregated once by invoice, balances and figures of the period together;
    ``unassigned`` have none and are aggregated by supplier: only suppliers whose unassigned entries are a credit
    count, so one supplier's debit hides no other's credit.
    """
    inside = F.col("entry_date") >= F.lit(start)
    amount = F.col("amount_cents")
    part = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0))
    measures = (
        F.sum(amount).alias("balance_cents"),
        (-part(inside & (F.col("category") == D.PAYMENT))).alias("paid_period_cents"),
        part(inside & F.col("category").isin(*D.CHARGES)).alias("charges_period_cents"),
    )
    loose = as_of(unassigned, day).groupBy("supplier_id").agg(*measures).select(F.lit(None).cast("bigint").alias("invoice_id"), "balance_cents", "paid_period_cents", "charges_period_cents")
    sums = as_of(entries, day).groupBy("invoice_id").agg(*measures).unionByName(loose)
    worst = notices.groupBy("invoice_id").agg(F.max("level").alias("max_level"))
    rows = sums.join(invoices.select("invoice_id", "due_date", "manual_status"), "invoice_id", "left").join(worst, "invoice_id", "left")
    balance, due = F.col("balance_cents"), F.col("due_date")
    live = F.col("manual_status") != D.CANCELLED
    owed = live & (balance > 0)
    total = lambda c: F.coalesce(F.sum(F.when(c, balance)), F.lit(0))
    soon = lambda n: owed & due.between(F.lit(day), F.date_add(F.lit(day), n))
    return rows.agg(
        total(owed).alias("total_open"),
        total(owed & (due < F.lit(day))).alias("overdue"),
        total(soon(7)).alias("due_7"),
        total(soon(14)).alias("due_14"),
        total(soon(30)).alias("due_30"),
        F.coalesce(F.sum("paid_period_cents"), F.lit(0)).alias("paid_period"),
        F.coalesce(F.sum("charges_period_cents"), F.lit(0)).alias("charges"),
        (-total(live & (balance < 0))).alias("overpaid"),
        (-total(F.col("invoice_id").isNull() & (balance < 0))).alias("unassigned"),
        (-total((F.col("invoice_id").isNull() | live) & (balance < 0))).alias("credits"),
        F.count(F.when(owed & (F.col("max_level") >= 5), 1)).alias("escalated"),
        F.count(F.when(owed, 1)).alias("n_open"),
    )


def with_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """(figure, value, previous, direction): each figure of two one-row frames, and whether it rose, fell or stayed."""
    long = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("bigint").alias(name)) for c in df.columns])))
    return long(now, "value").join(long(before, "previous"), "figure").withColumn("direction", F.signum(F.col("value") - F.col("previous")).cast("int"))
