"""Write operators as planners: requests and tables in, new rows and refusals out, all set-based.

Each planner returns rows for the ledger (or another table) with an ``error`` column: rows whose error is null are to be
appended, the others say why the request is refused.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.functions.text import normalize_reference, valid_iban, valid_vat_id
from skonto.operators.allocation import allocate, unallocated

ENTRY = ("entry_date", "supplier_id", "invoice_id", "entry_type", "category", "amount_cents", "payment_id", "reverses_entry_id")


def accepted(planned: DataFrame) -> DataFrame:
    """Rows to append."""
    return planned.where("error is null").drop("error")


def sign_violations(entries: DataFrame) -> DataFrame:
    """Entries that break the rules on signs and types."""
    kind, amount = F.col("entry_type"), F.col("amount_cents")
    return entries.where(
        (amount == 0) | ~kind.isin(*D.ENTRY_TYPES) | (kind.isin(*D.ALWAYS_NEGATIVE) & (amount > 0)) | (kind.isin(*D.ALWAYS_POSITIVE) & (amount < 0))
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def create_invoices(requests: DataFrame, parties: DataFrame, invoices: DataFrame) -> DataFrame:
    """Requests (supplier_id, invoice_number, invoice_date, due_date, gross_cents) with due date, normalised number and error."""
    roles = parties.select(F.col("party_id").alias("supplier_id"), "role")
    taken = invoices.select("supplier_id", "invoice_number", F.lit(True).alias("taken")).distinct()
    due = F.coalesce("due_date", F.date_add("invoice_date", D.PAYMENT_DAYS))
    error = (
        F.when(F.col("role").isNull(), "UNKNOWN_SUPPLIER")
        .when(F.col("role") == D.AGENCY, "AGENCY")
        .when(F.trim("invoice_number") == "", "NO_NUMBER")
        .when(F.col("taken"), "NUMBER_EXISTS")
        .when(F.col("gross_cents") <= 0, "AMOUNT")
        .when(due < F.col("invoice_date"), "DUE_BEFORE_DATE")
    )
    return (
        requests.join(roles, "supplier_id", "left")
        .join(taken, ["supplier_id", "invoice_number"], "left")
        .select("supplier_id", "invoice_number", normalize_reference(F.col("invoice_number")).alias("number_norm"), "invoice_date", due.alias("due_date"), "gross_cents", error.alias("error"))
    )


def corrections(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Credit notes, write-offs and adjustments (invoice_id, kind, amount_cents, entry_date, comment) as entries."""
    open_now = states.select("invoice_id", "supplier_id", "open_cents")
    kind, amount = F.col("kind"), F.col("amount_cents")
    error = (
        F.when(F.col("open_cents").isNull(), "UNKNOWN_INVOICE")
        .when((kind == D.ADJUSTMENT) & ((amount == 0) | (F.trim(F.coalesce("comment", F.lit(""))) == "")), "ADJUSTMENT")
        .when((kind != D.ADJUSTMENT) & (amount <= 0), "AMOUNT")
        .when((kind == D.WRITE_OFF) & (amount > F.col("open_cents")), "ABOVE_OPEN")
    )
    signed = F.when(kind == D.ADJUSTMENT, amount).otherwise(-amount)
    return requests.join(open_now, "invoice_id", "left").select(
        "entry_date", "supplier_id", "invoice_id", kind.alias("entry_type"), kind.alias("category"), signed.alias("amount_cents"),
        F.lit(None).cast("bigint").alias("payment_id"), F.lit(None).cast("bigint").alias("reverses_entry_id"), error.alias("error"),
    )


def reversals(requests: DataFrame, entries: DataFrame, through_payment: bool = False) -> DataFrame:
    """Entries that undo others; ``requests``: entry_id, reverse_on. They are never dated before what they undo."""
    done = entries.where("reverses_entry_id is not null").select(F.col("reverses_entry_id").alias("entry_id"), F.lit(True).alias("done")).distinct()
    error = (
        F.when(F.col("entry_type").isNull(), "UNKNOWN_ENTRY")
        .when(F.col("entry_type") == D.REVERSAL, "IS_REVERSAL")
        .when(F.col("done"), "REVERSED")
        .when(F.lit(not through_payment) & F.col("payment_id").isNotNull(), "THROUGH_PAYMENT")
    )
    return (
        requests.join(entries.drop("reverses_entry_id"), "entry_id", "left")
        .join(done, "entry_id", "left")
        .select(
            F.greatest("reverse_on", "entry_date").alias("entry_date"), "supplier_id", "invoice_id", F.lit(D.REVERSAL).alias("entry_type"), "category",
            (-F.col("amount_cents")).alias("amount_cents"), "payment_id", F.col("entry_id").alias("reverses_entry_id"), error.alias("error"),
        )
    )


def cancel_invoices(invoice_ids: DataFrame, entries: DataFrame, day: date) -> DataFrame:
    """Reversals of every active entry of invoices; refused as long as a payment is active."""
    undone = entries.where("reverses_entry_id is not null").select(F.col("reverses_entry_id").alias("entry_id"))
    active = entries.join(invoice_ids, "invoice_id", "left_semi").where(F.col("entry_type") != D.REVERSAL).join(undone, "entry_id", "left_anti")
    paid = active.where(F.col("entry_type") == D.PAYMENT).select("invoice_id", F.lit("HAS_PAYMENTS").alias("error")).distinct()
    return active.join(paid, "invoice_id", "left").select(
        F.greatest(F.lit(day), F.col("entry_date")).alias("entry_date"), "supplier_id", "invoice_id", F.lit(D.REVERSAL).alias("entry_type"), "category",
        (-F.col("amount_cents")).alias("amount_cents"), "payment_id", F.col("entry_id").alias("reverses_entry_id"), "error",
    )


def change_supplier(requests: DataFrame, entries: DataFrame, notices: DataFrame) -> DataFrame:
    """Move invoices (invoice_id, new_supplier_id) to another supplier: a reversal of the invoice's entry and the same entry anew."""
    e = entries.join(requests, "invoice_id")
    other = e.where(F.col("entry_type") != D.INVOICE).select("invoice_id", F.lit("HAS_ENTRIES").alias("why"))
    noticed = notices.join(requests, "invoice_id").select("invoice_id", F.lit("HAS_NOTICES").alias("why"))
    error = other.unionByName(noticed).groupBy("invoice_id").agg(F.min("why").alias("error"))
    first = e.where(F.col("entry_type") == D.INVOICE).join(error, "invoice_id", "left")
    none = F.lit(None).cast("bigint")
    back = first.select("entry_date", "supplier_id", "invoice_id", F.lit(D.REVERSAL).alias("entry_type"), "category", (-F.col("amount_cents")).alias("amount_cents"), none.alias("payment_id"), F.col("entry_id").alias("reverses_entry_id"), "error")
    anew = first.select("entry_date", F.col("new_supplier_id").alias("supplier_id"), "invoice_id", "entry_type", "category", "amount_cents", none.alias("payment_id"), none.alias("reverses_entry_id"), "error")
    return back.unionByName(anew)


def record_payments(payments: DataFrame, items: DataFrame, rule: str = D.STATUTORY) -> tuple[DataFrame, DataFrame]:
    """Allocations and entries of payments: one entry for each invoice, and one without an invoice for the rest."""
    allocated = allocate(payments, items, rule)
    dated = payments.select("payment_id", "supplier_id", "payment_date")
    used = allocated.groupBy("payment_id", "invoice_id").agg((-F.sum("allocated_cents")).alias("amount_cents"))
    rest = unallocated(payments, allocated).where("rest_cents > 0").select("payment_id", F.lit(None).cast("bigint").alias("invoice_id"), (-F.col("rest_cents")).alias("amount_cents"))
    entries = used.unionByName(rest).join(dated, "payment_id").select(
        F.col("payment_date").alias("entry_date"), "supplier_id", "invoice_id", F.lit(D.PAYMENT).alias("entry_type"), F.lit(D.PAYMENT).alias("category"), "amount_cents", "payment_id",
        F.lit(None).cast("bigint").alias("reverses_entry_id"),
    )
    return allocated, entries


def reverse_payments(payment_ids: DataFrame, entries: DataFrame, allocations: DataFrame, day: date) -> tuple[DataFrame, DataFrame]:
    """Negated net allocations and reversals of the active entries of payments."""
    undone = entries.where("reverses_entry_id is not null").select(F.col("reverses_entry_id").alias("entry_id"))
    active = entries.join(payment_ids, "payment_id", "left_semi").where(F.col("entry_type") != D.REVERSAL).join(undone, "entry_id", "left_anti")
    back = reversals(active.select("entry_id", F.lit(day).alias("reverse_on")), entries, through_payment=True)
    net = allocations.join(payment_ids, "payment_id", "left_semi").groupBy("payment_id", "invoice_id", "component").agg((-F.sum("amount_cents")).alias("amount_cents")).where("amount_cents <> 0")
    return net, back


def apply_credits(credits: DataFrame, items: DataFrame, day: date, rule: str = D.STATUTORY) -> tuple[DataFrame, DataFrame]:
    """Use unassigned payments (entry_id, payment_id, supplier_id, amount_cents < 0): reverse each and allocate it anew."""
    back = credits.select(
        F.lit(day).alias("entry_date"), "supplier_id", F.lit(None).cast("bigint").alias("invoice_id"), F.lit(D.REVERSAL).alias("entry_type"), F.lit(D.PAYMENT).alias("category"),
        (-F.col("amount_cents")).alias("amount_cents"), "payment_id", F.col("entry_id").alias("reverses_entry_id"),
    )
    again = credits.select("payment_id", "supplier_id", (-F.col("amount_cents")).alias("payment_cents"), F.lit(day).alias("payment_date"))
    allocated, entries = record_payments(again, items, rule)
    return allocated, back.unionByName(entries)


def payment_preview(payments: DataFrame, items: DataFrame, states: DataFrame, rule: str = D.STATUTORY) -> DataFrame:
    """What a payment would do: invoice_id, before_cents, applied_cents, after_cents, status_after."""
    applied = allocate(payments, items, rule).groupBy("payment_id", "invoice_id").agg(F.sum("allocated_cents").alias("applied_cents"))
    after = F.col("before_cents") - F.col("applied_cents")
    known = states.select("invoice_id", F.col("balance_cents").alias("before_cents"), "manual_status")
    state = F.when(F.col("manual_status").isin(D.DISPUTED, D.CANCELLED), F.col("manual_status")).when(after <= 0, D.PAID).otherwise(D.PARTIALLY_PAID)
    return applied.join(known, "invoice_id").select("payment_id", "invoice_id", "before_cents", "applied_cents", after.alias("after_cents"), state.alias("status_after"))


def party_errors(parties: DataFrame) -> DataFrame:
    """Parties that break a rule: IBAN checksum, VAT number format, only agencies represent others."""
    error = (
        F.when(F.trim("name") == "", "NO_NAME")
        .when(F.exists("ibans", lambda x: ~valid_iban(x)), "IBAN")
        .when((F.col("vat_id") != "") & ~valid_vat_id(F.col("vat_id")), "VAT_ID")
        .when((F.col("role") != D.AGENCY) & F.col("represents_id").isNotNull(), "REPRESENTS")
    )
    return parties.withColumn("error", error).where("error is not null")


def case_status(invoice_status: Column, case: Column) -> Column:
    """A case follows its invoice: settled or cancelled ends an active one as paid, a dispute is carried over, a new debt opens it again."""
    return (
        F.when(invoice_status.isin(D.PAID, D.CANCELLED), F.when(case.isin(*D.ACTIVE_CASES), D.CASE_PAID).otherwise(case))
        .when(invoice_status == D.DISPUTED, D.CASE_IN_DISPUTE)
        .when(case.isin(D.CASE_PAID, D.CASE_IN_DISPUTE), D.CASE_OPEN)
        .otherwise(case)
    )


def upsert(current: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``current`` with rows replaced or added by key."""
    return current.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def insert_missing(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, each key once."""
    return new.join(current.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
