"""Balances, states, statements and trends, all derived from ledger entries as of a date.

Entries have entry_date, supplier_id, invoice_id (null: not assigned to an invoice), category and amount_cents (debts
positive). A reversal carries the category of what it reverses, so plain sums by category are right.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto import domain as D
from skonto.functions.dates import aging_bucket


def as_of(entries: DataFrame, day: date | None) -> DataFrame:
    """Entries up to a day; the filter reaches the scan."""
    return entries if day is None else entries.where(F.col("entry_date") <= F.lit(day))


def scoped(df: DataFrame, company_id: int | None = None, hotel_id: int | None = None) -> DataFrame:
    """Rows of a hotel, or of a company with all its hotels, or all."""
    if hotel_id is not None:
        return df.where(F.col("hotel_id") == hotel_id)
    return df if company_id is None else df.where(F.col("company_id") == company_id)


def scoped_entries(entries: DataFrame, invoices: DataFrame, payments: DataFrame, company_id: int | None = None, hotel_id: int | None = None) -> DataFrame:
    """Entries whose invoice is in the scope, or that have no invoice and whose payment is."""
    if company_id is None and hotel_id is None:
        return entries
    of_invoice = entries.join(scoped(invoices, company_id, hotel_id).select("invoice_id"), "invoice_id", "left_semi")
    unassigned = entries.where("invoice_id is null").join(scoped(payments, company_id, hotel_id).select("payment_id"), "payment_id", "left_semi")
    return of_invoice.unionByName(unassigned, allowMissingColumns=True)


def balances_by_invoice(entries: DataFrame, day: date | None = None) -> DataFrame:
    """(invoice_id, balance_cents)."""
    return as_of(entries, day).where("invoice_id is not null").groupBy("invoice_id").agg(F.sum("amount_cents").alias("balance_cents"))


def sums_by_category(entries: DataFrame, day: date | None = None, by_month: bool = False) -> DataFrame:
    """(category, amount_cents), also by month ``yyyy-MM``."""
    keys = ([F.date_format("entry_date", "yyyy-MM").alias("month")] if by_month else []) + [F.col("category")]
    return as_of(entries, day).groupBy(*keys).agg(F.sum("amount_cents").alias("amount_cents"), F.count("*").alias("n_entries"))


def unapplied_by_supplier(entries: DataFrame, day: date | None = None) -> DataFrame:
    """(supplier_id, unapplied_cents): credits that no invoice has."""
    return as_of(entries, day).where("invoice_id is null").groupBy("supplier_id").agg(F.sum("amount_cents").alias("unapplied_cents"))


def _of(*categories: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("category").isin(*categories), F.col("amount_cents"))), F.lit(0))


def invoice_states(invoices: DataFrame, entries: DataFrame, allocations: DataFrame | None = None, day: date | None = None) -> DataFrame:
    """Each invoice with entries: its thirteen measures and its status.

    One aggregation by invoice pivots the categories. ``allocations`` (invoice_id, component, amount_cents, payment_date)
    say what payments were used for.
    """
    sums = as_of(entries, day).where("invoice_id is not null").groupBy("invoice_id").agg(
        _of(D.INVOICE).alias("invoiced_cents"),
        (-_of(D.CREDIT_NOTE)).alias("credits_cents"),
        _of(D.DUNNING_FEE).alias("fees_cents"),
        _of(D.LATE_INTEREST).alias("interest_cents"),
        _of(D.FLAT_FEE).alias("flat_fee_cents"),
        _of(D.COLLECTION_COST).alias("collection_cents"),
        _of(D.ADJUSTMENT).alias("adjustments_cents"),
        (-_of(D.WRITE_OFF)).alias("write_offs_cents"),
        (-_of(D.PAYMENT)).alias("paid_cents"),
        F.sum("amount_cents").alias("balance_cents"),
    )
    states = invoices.join(sums, "invoice_id")
    if allocations is None:
        used = {c: F.lit(0) for c in (D.COSTS, D.INTEREST, D.PRINCIPAL)}
    else:
        rows = allocations if day is None else allocations.where(F.col("payment_date") <= F.lit(day))
        part = lambda c: F.coalesce(F.sum(F.when(F.col("component") == c, F.col("amount_cents"))), F.lit(0)).alias(f"used_{c}")
        states = states.join(rows.groupBy("invoice_id").agg(*map(part, (D.COSTS, D.INTEREST, D.PRINCIPAL))), "invoice_id", "left")
        used = {c: F.coalesce(f"used_{c}", F.lit(0)) for c in (D.COSTS, D.INTEREST, D.PRINCIPAL)}
    measures = ("invoiced", "credits", "fees", "interest", "flat_fee", "collection", "adjustments", "write_offs", "paid")
    nothing = F.lit(True)
    for m in measures:
        nothing = nothing & (F.col(f"{m}_cents") == 0)
    return (
        states.withColumn("open_costs_cents", F.col("fees_cents") + F.col("flat_fee_cents") + F.col("collection_cents") - used[D.COSTS])
        .withColumn("open_interest_cents", F.col("interest_cents") - used[D.INTEREST])
        .withColumn("open_principal_cents", F.expr("invoiced_cents - credits_cents + adjustments_cents - write_offs_cents") - used[D.PRINCIPAL])
        .withColumn("status", status(F.col("balance_cents"), F.col("paid_cents"), F.col("manual_status"), nothing))
        .withColumn("open_cents", F.greatest(F.lit(0).cast("bigint"), F.col("balance_cents")))
        .withColumn("credit_cents", F.greatest(F.lit(0).cast("bigint"), -F.col("balance_cents")))
        .drop("used_costs", "used_interest", "used_principal")
    )


def status(balance: Column, paid: Column, manual: Column, nothing: Column) -> Column:
    """A manual dispute or cancellation wins; an invoice with nothing booked is open, else the balance decides."""
    return (
        F.when(manual.isin(D.DISPUTED, D.CANCELLED), manual).when(nothing, D.OPEN).when(balance <= 0, D.PAID).when(paid > 0, D.PARTIALLY_PAID).otherwise(D.OPEN)
    )


def open_items(invoices: DataFrame, entries: DataFrame, day: date) -> DataFrame:
    """Invoices with a positive balance that are not cancelled, with their bucket."""
    live = invoices.where(F.col("manual_status") != D.CANCELLED)
    balances = balances_by_invoice(entries, day).where("balance_cents > 0")
    return live.join(balances, "invoice_id").withColumn("bucket", aging_bucket(F.col("due_date"), F.lit(day)))


def aging_totals(items: DataFrame) -> DataFrame:
    """(bucket, open_cents, n_items) with every bucket, also empty ones."""
    spark = items.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, D.BUCKETS))).alias("bucket"))
    sums = items.groupBy("bucket").agg(F.sum("balance_cents").alias("s"), F.count("*").alias("n"))
    return every.join(sums, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("open_cents"), F.coalesce("n", F.lit(0)).alias("n_items"))


def supplier_balances(entries: DataFrame, day: date | None = None) -> DataFrame:
    """(supplier_id, invoices_cents, unapplied_cents, balance_cents): invoices and unassigned credits in one aggregation."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_cents"))), F.lit(0))
    return as_of(entries, day).groupBy("supplier_id").agg(
        part(F.col("invoice_id").isNotNull()).alias("invoices_cents"),
        part(F.col("invoice_id").isNull()).alias("unapplied_cents"),
        F.sum("amount_cents").alias("balance_cents"),
    )


def supplier_overview(items: DataFrame, day: date) -> DataFrame:
    """(supplier_id, open_cents, overdue_cents, n_open, n_overdue)."""
    late = F.col("due_date") < F.lit(day)
    return items.groupBy("supplier_id").agg(
        F.sum("balance_cents").alias("open_cents"),
        F.coalesce(F.sum(F.when(late, F.col("balance_cents"))), F.lit(0)).alias("overdue_cents"),
        F.count("*").alias("n_open"),
        F.count(F.when(late, 1)).alias("n_overdue"),
    )


def running_balance(entries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Entries with ``running_cents``, the balance of their account after them."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("running_cents", F.sum("amount_cents").over(window))


def statement(entries: DataFrame, start: date, end: date, order: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """The accounts of suppliers in a period: balances run over everything before, only entries of the period are shown.

    What lies before the period is one sum a supplier, so only the period is sorted; within it balances run month by
    month, each from what the months before leave, so a large account is as many groups as there are months.
    ``only`` (invoice_id) restricts what is shown, after the balance was run.
    """
    known = as_of(entries, end)
    inside = F.col("entry_date") >= F.lit(start)
    month = F.when(inside, F.trunc("entry_date", "MM"))
    by_month = known.groupBy("supplier_id", month.alias("month")).agg(F.sum("amount_cents").alias("cents"))
    earlier = Window.partitionBy("supplier_id").orderBy(F.asc_nulls_first("month")).rowsBetween(Window.unboundedPreceding, -1)
    opening = by_month.withColumn("opening", F.coalesce(F.sum("cents").over(earlier), F.lit(0))).where("month is not null").drop("cents")
    ran = running_balance(known.where(inside).withColumn("month", month), ["supplier_id", "month"], order)
    rows = ran.join(opening, ["supplier_id", "month"]).withColumn("running_cents", F.col("running_cents") + F.col("opening")).drop("opening", "month")
    return rows if only is None else rows.join(only.select("invoice_id"), "invoice_id", "left_semi")


def statement_totals(entries: DataFrame, start: date, end: date) -> DataFrame:
    """(supplier_id, opening_cents, debit_cents, credit_cents, closing_cents) of a period."""
    inside = F.col("entry_date") >= F.lit(start)
    amount = F.col("amount_cents")
    zero = F.lit(0).cast("bigint")
    return as_of(entries, end).groupBy("supplier_id").agg(
        F.coalesce(F.sum(F.when(~inside, amount)), zero).alias("opening_cents"),
        F.coalesce(F.sum(F.when(inside, F.greatest(amount, zero))), zero).alias("debit_cents"),
        F.coalesce(F.sum(F.when(inside, F.greatest(-amount, zero))), zero).alias("credit_cents"),
        F.sum(amount).alias("closing_cents"),
    )


def monthly_trend(entries: DataFrame, day: date, months: int = 12) -> DataFrame:
    """The last months up to a day: (month, invoiced_cents, paid_cents, balance_cents at its end), none missing.

    Entries are summed by month before anything else, so the running sum goes over as many rows as there are months.
    """
    spark = entries.sparkSession
    month = F.trunc("entry_date", "MM")
    cats = {"invoiced_cents": (F.col("category") == D.INVOICE, 1), "paid_cents": (F.col("category") == D.PAYMENT, -1)}
    first = F.add_months(F.trunc(F.lit(day), "MM"), 1 - months)
    sums = (
        as_of(entries, day)
        .groupBy(F.greatest(month, F.add_months(first, -1)).alias("month"))
        .agg(*[(F.coalesce(F.sum(F.when(c, F.col("amount_cents"))), F.lit(0)) * k).alias(n) for n, (c, k) in cats.items()], F.sum("amount_cents").alias("s"))
    )
    spine = spark.range(1).select(F.explode(F.expr(f"sequence(add_months(trunc(date'{day}', 'MM'), {-months}), trunc(date'{day}', 'MM'), interval 1 month)")).alias("month"))
    run = Window.partitionBy(F.lit(1)).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = spine.join(sums, "month", "left").withColumn("balance_cents", F.sum(F.coalesce("s", F.lit(0))).over(run))
    return filled.where(F.col("month") >= first).select(
        F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("invoiced_cents", F.lit(0)).alias("invoiced_cents"), F.coalesce("paid_cents", F.lit(0)).alias("paid_cents"), "balance_cents"
    )


def duplicate_invoices(invoices: DataFrame, days: int = 14) -> DataFrame:
    """Invoices of one supplier over the same amount, not more than ``days`` after the one before."""
    before = Window.partitionBy("supplier_id", "gross_cents").orderBy("invoice_date", "invoice_id")
    return (
        invoices.where(F.col("manual_status") != D.CANCELLED)
        .withColumn("previous_id", F.lag("invoice_id").over(before))
        .withColumn("days_between", F.datediff("invoice_date", F.lag("invoice_date").over(before)))
        .where(F.col("days_between") <= days)
    )


def active_entries(entries: DataFrame) -> DataFrame:
    """Entries that are no reversals and that none reverses."""
    reversed_ids = entries.where("reverses_entry_id is not null").select(F.col("reverses_entry_id").alias("entry_id")).distinct()
    return entries.where(F.col("entry_type") != D.REVERSAL).join(reversed_ids, "entry_id", "left_anti")


def unapplied_payments(entries: DataFrame) -> DataFrame:
    """Active payments that no invoice has."""
    return active_entries(entries).where((F.col("entry_type") == D.PAYMENT) & F.col("invoice_id").isNull())


def forecast(items: DataFrame, day: date) -> DataFrame:
    """What falls due in 0-30, 31-60 and 61-90 days."""
    ahead = F.datediff("due_date", F.lit(day))
    window = F.when(ahead.between(0, 30), "0-30").when(ahead.between(31, 60), "31-60").when(ahead.between(61, 90), "61-90")
    return items.withColumn("window", window).where("window is not null").groupBy("window").agg(F.sum("balance_cents").alias("open_cents"), F.count("*").alias("n_items"))


def top_suppliers(items: DataFrame, k: int = 10) -> DataFrame:
    """The suppliers with the largest open amounts; ties go to the one whose first open invoice is older."""
    sums = items.groupBy("supplier_id").agg(F.sum("balance_cents").alias("open_cents"), F.count("*").alias("n_items"), F.min(F.struct("invoice_date", "invoice_id")).alias("seen"))
    return sums.orderBy(F.desc("open_cents"), "seen").limit(k).drop("seen")


def scope_rollup(items: DataFrame) -> DataFrame:
    """Open amounts of every hotel, every company and of all, in one aggregation."""
    return items.rollup("company_id", "hotel_id").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("balance_cents").alias("open_cents"), F.count("*").alias("n_items")
    )


def invoice_history(entries: DataFrame, notices: DataFrame, order: Sequence[str]) -> DataFrame:
    """Entries and notices of each invoice in one line: entries with the balance after them, notices with their level.

    ``rank`` puts, within a day, invoices first, then notices, other entries, credit notes and payments.
    """
    ran = running_balance(entries.where("invoice_id is not null"), ["invoice_id"], order)
    kind = F.col("category")
    rank = F.when(kind == D.INVOICE, 0).when(kind == D.CREDIT_NOTE, 3).when(kind == D.PAYMENT, 4).otherwise(2)
    lines = ran.select("invoice_id", F.col("entry_date").alias("day"), rank.alias("rank"), kind.alias("kind"), "amount_cents", "running_cents")
    letters = notices.select(
        "invoice_id", F.col("notice_date").alias("day"), F.lit(1).alias("rank"), F.concat(F.lit("NOTICE_"), F.col("level").cast("string")).alias("kind"),
        F.lit(None).cast("bigint").alias("amount_cents"), F.lit(None).cast("bigint").alias("running_cents"),
    )
    return lines.unionByName(letters)


def reconciliation_totals(entries: DataFrame) -> DataFrame:
    """One row that must agree: all entries = invoice balances + unapplied = supplier balances."""
    amount = F.col("amount_cents")
    return entries.agg(
        F.sum(amount).alias("all_cents"),
        F.sum(F.when(F.col("invoice_id").isNotNull(), amount).otherwise(0)).alias("invoices_cents"),
        F.sum(F.when(F.col("invoice_id").isNull(), amount).otherwise(0)).alias("unapplied_cents"),
    )
