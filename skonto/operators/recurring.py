"""Recurring invoices: when they fall due, over which amount, under which number."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.functions.dates import add_months

MOST = 1200


def months_of(period: Column) -> Column:
    """Months between occurrences."""
    return F.create_map(*[F.lit(x) for pair in D.MONTHS_OF_PERIOD.items() for x in pair])[period]


def occurrences(templates: DataFrame, until: date) -> DataFrame:
    """Each template with its due dates (``occurrence``) from start_date to ``until`` or end_date.

    ``templates``: recurring_id, period, day_of_month, start_date, end_date and more.
    """
    last = F.least(F.lit(until), F.coalesce("end_date", F.lit(until)))
    step = months_of(F.col("period"))
    n = F.greatest(F.lit(0), F.least(F.lit(MOST), F.floor(F.months_between(F.last_day(last), F.trunc("start_date", "MM")) / step).cast("int")))
    days = F.transform(F.sequence(F.lit(0), n), lambda k: add_months(F.col("start_date"), k * step, F.col("day_of_month")))
    return templates.withColumn("occurrence", F.explode(days)).where((F.col("occurrence") >= F.col("start_date")) & (F.col("occurrence") <= last))


def with_amount(rows: DataFrame, amounts: DataFrame) -> DataFrame:
    """Occurrences with the amount that is valid on their day, the latest; null before the first.

    ``amounts``: recurring_id, valid_from, gross_cents.
    """
    valid = rows.select("recurring_id", "occurrence").join(amounts, "recurring_id").where(F.col("valid_from") <= F.col("occurrence"))
    best = valid.groupBy("recurring_id", "occurrence").agg(F.max_by("gross_cents", "valid_from").alias("gross_cents"))
    return rows.join(best, ["recurring_id", "occurrence"], "left")


def number_for(title: Column, period: Column, day: Column) -> Column:
    """The invoice number by the usual pattern of the period."""
    word = F.regexp_replace(F.element_at(F.split(F.trim(title), r"\s+"), 1), "[^A-Za-z0-9ÄÖÜäöüß]", "")
    prefix = F.upper(F.substring(F.when(word == "", "R").otherwise(word), 1, 12))
    tail = (
        F.when(period == "monthly", F.date_format(day, "yyyy-MM"))
        .when(period == "quarterly", F.concat(F.year(day), F.lit("-Q"), F.quarter(day)))
        .when(period == "half_yearly", F.concat(F.year(day), F.lit("-H"), F.when(F.month(day) <= 6, 1).otherwise(2)))
        .otherwise(F.year(day).cast("string"))
    )
    return F.concat(prefix, F.lit("-"), tail)


def due_invoices(templates: DataFrame, amounts: DataFrame, runs: DataFrame, invoices: DataFrame, until: date) -> DataFrame:
    """Invoices that are due and were not generated: occurrences without a run, ``adopted`` if the number exists already."""
    rows = with_amount(occurrences(templates.where("active"), until), amounts).join(runs.select("recurring_id", "occurrence"), ["recurring_id", "occurrence"], "left_anti")
    numbered = rows.withColumn("invoice_number", number_for(F.col("title"), F.col("period"), F.col("occurrence")))
    there = invoices.select("supplier_id", "invoice_number", F.col("invoice_id").alias("adopted"))
    return numbered.join(there, ["supplier_id", "invoice_number"], "left").select(
        "recurring_id", "supplier_id", "invoice_number", "occurrence", F.date_add("occurrence", F.col("due_days")).alias("due_date"), "gross_cents", "adopted",
        F.when(F.col("gross_cents").isNull(), "NO_AMOUNT").when(F.col("adopted").isNotNull(), "ADOPTED").otherwise("CREATE").alias("action"),
    )


