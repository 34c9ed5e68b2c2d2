"""Reports: account statement, open items, dunning overview, payments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.functions.dates import overdue_days
from skonto.functions.text import lower_ascii
from skonto.operators.notices import reconcile


def open_items_report(items: DataFrame, parties: DataFrame, day: date) -> DataFrame:
    """Open items with the supplier's name and the days overdue; names are looked up, unknown ones are ``?``."""
    names = parties.select(F.col("party_id").alias("supplier_id"), "name")
    return items.join(names, "supplier_id", "left").select(
        F.coalesce("name", F.lit("?")).alias("supplier"), "invoice_number", "invoice_date", "due_date", "balance_cents", overdue_days(F.col("due_date"), F.lit(day)).alias("overdue_days"), "bucket"
    )


def with_totals(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Sums by keys and, with null keys, the total of all."""
    return df.groupingSets([keys, []], *keys).agg(F.sum(measure).alias(measure), F.count("*").alias("n_items"), (F.grouping_id() > 0).alias("is_total"))


def payments_report(payments: DataFrame, allocations: DataFrame, invoices: DataFrame, active: DataFrame) -> DataFrame:
    """Payments with the invoices that they pay, in order, and whether they are booked, a credit or cancelled."""
    numbers = (
        allocations.join(invoices.select("invoice_id", "invoice_number"), "invoice_id").groupBy("payment_id")
        .agg(F.array_join(F.array_sort(F.collect_set("invoice_number")), ", ").alias("invoice_numbers"), F.sum("allocated_cents").alias("allocated_cents"))
    )
    alive = active.select("payment_id", F.lit(True).alias("alive")).distinct()
    used = F.coalesce("allocated_cents", F.lit(0))
    state = F.when(F.col("alive").isNull(), "cancelled").when(used < F.col("payment_cents"), "credit").otherwise("booked")
    return payments.join(numbers, "payment_id", "left").join(alive, "payment_id", "left").select(
        "payment_id", "supplier_id", "payment_date", "payment_cents", F.coalesce("invoice_numbers", F.lit("")).alias("invoice_numbers"), used.alias("allocated_cents"), state.alias("status")
    )


def dunning_overview(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """Notices with what they claim and what the ledger shows, over all their invoices."""
    return reconcile(claims, entries).groupBy("notice_id", "notice_date").agg(
        F.sum("claimed_cents").alias("claimed_cents"), F.sum("expected_cents").alias("expected_cents"), F.sum("difference_cents").alias("difference_cents"),
        F.count(F.when(F.col("issues") != "", 1)).alias("n_issues"),
    )




def by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    """A list by name, small and capital letters of ASCII alike, equal names by key."""
    return df.orderBy(lower_ascii(F.col(name)), key)


def open_items_in_order(items: DataFrame, parties: DataFrame) -> DataFrame:
    """Open items by supplier name, then by due day, those without one last, then by id; ``place`` counts within a name.

    An unknown supplier is ``?``. Names that differ in small and capital letters only are one group, as the order has them.
    """
    names = parties.select(F.col("party_id").alias("supplier_id"), "name")
    named = items.join(names, "supplier_id", "left").withColumn("supplier", F.coalesce("name", F.lit("?"))).drop("name").withColumn("_key", lower_ascii(F.col("supplier")))
    order = (F.col("due_date").asc_nulls_last(), F.col("invoice_id"))
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return placed.orderBy("_key", "place").drop("_key")


def drilled(items: DataFrame, most: int | None = None) -> DataFrame:
    """Items behind a figure by due day, those without one last, then by id; the first ``most`` or all."""
    rows = items.orderBy(F.col("due_date").asc_nulls_last(), "invoice_id")
    return rows if most is None else rows.limit(most)


def sorted_by(df: DataFrame, column: str, key: str, descending: bool = False) -> DataFrame:
    """A table as a user sorts it by any column: numbers and days by value, texts without regard to capitals, empty values first, ties by key."""
    kind = df.schema[column].dataType.typeName()
    value: Column = F.lower(F.coalesce(column, F.lit(""))) if kind == "string" else F.col(column)
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_first(), key)
