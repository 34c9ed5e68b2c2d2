"""What needs attention: deadlines, differences, credits; the rows behind every key figure; cases; what a scope holds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto import domain as D
from skonto.functions.dates import aging_bucket
from skonto.operators.ledger import as_of, balances_by_invoice
from skonto.operators.notices import levels

ESCALATED_LEVEL = 5


def deadlines(items: DataFrame, notices: DataFrame, day: date, most: int | None = 8, days: int = 7) -> DataFrame:
    """(invoice_id, supplier_id, deadline, days_left, severity, balance_cents) of open items due within some days.

    The largest deadline of an invoice's notices replaces its due date. Up to two days left are critical, up to five a
    warning. The ``most`` nearest, older invoices first among equals.
    """
    latest = notices.groupBy("invoice_id").agg(F.max("new_deadline").alias("latest"))
    rows = items.join(latest, "invoice_id", "left").withColumn("deadline", F.coalesce("latest", "due_date")).withColumn("days_left", F.datediff("deadline", F.lit(day)))
    severity = F.when(F.col("days_left") <= 2, "critical").when(F.col("days_left") <= 5, "warn").otherwise("info")
    near = rows.where(F.col("days_left").between(0, days)).withColumn("severity", severity)
    shown = near if most is None else near.orderBy("days_left", "invoice_date", "invoice_id").limit(most)
    return shown.select("invoice_id", "supplier_id", "deadline", "days_left", "severity", "balance_cents")


def claim_differences(reconciled: DataFrame) -> DataFrame:
    """(notice_id, difference_cents) of notices whose claims differ from the ledger, summed over their invoices."""
    return reconciled.groupBy("notice_id").agg(F.sum("difference_cents").alias("difference_cents")).where("difference_cents <> 0")


def credits(invoices: DataFrame, entries: DataFrame, unassigned: DataFrame, day: date) -> DataFrame:
    """(kind, supplier_id, invoice_id, credit_cents): suppliers' unassigned credits, then overpaid invoices that are not cancelled."""
    loose = as_of(unassigned, day).groupBy("supplier_id").agg(F.sum("amount_cents").alias("s")).where("s < 0")
    over = invoices.where(F.col("manual_status") != D.CANCELLED).join(balances_by_invoice(entries, day).where("balance_cents < 0"), "invoice_id")
    return loose.select(F.lit("unassigned").alias("kind"), "supplier_id", F.lit(None).cast("bigint").alias("invoice_id"), (-F.col("s")).alias("credit_cents")).unionByName(
        over.select(F.lit("overpaid").alias("kind"), "supplier_id", "invoice_id", (-F.col("balance_cents")).alias("credit_cents"))
    )


def _targets(day: date) -> dict[str, Column]:
    """Of every key figure over open items, which it counts."""
    due, today = F.col("due_date"), F.lit(day)
    ahead = F.datediff(due, today)
    return {
        "open": F.lit(True),
        "overdue": due < today,
        **{f"due_{n}": ahead.between(0, n) for n in (7, 14, 30)},
        **{f"aging_{b}": aging_bucket(due, today) == b for b in D.BUCKETS},
        **{f"forecast_{a}-{b}": ahead.between(a, b) for a, b in ((0, 30), (31, 60), (61, 90))},
        **{f"level_{n}": F.col("max_level") == n for n in D.DUNNING_LEVELS},
    }


def drill_down(items: DataFrame, notices: DataFrame, day: date, targets: list[str] | None = None) -> DataFrame:
    """(target, invoice_id, supplier_id, due_date, balance_cents): the open items behind every key figure or segment.

    All of them, or those of some ``targets``, from one pass: the sum of a target's rows is its figure.
    """
    rows = items.join(levels(notices).select("invoice_id", "max_level"), "invoice_id", "left")
    wanted = {k: c for k, c in _targets(day).items() if targets is None or k in targets}
    behind = F.array_compact(F.array(*[F.when(c, k) for k, c in wanted.items()]))
    return rows.select(F.explode(behind).alias("target"), "invoice_id", "supplier_id", "due_date", "balance_cents")


def case_list(cases: DataFrame, invoices: DataFrame, entries: DataFrame, notices: DataFrame, day: date) -> DataFrame:
    """Cases with the balance of their invoice, its highest level, its deadline and whether that has passed."""
    deadline = F.coalesce("last_deadline", "due_date")
    return (
        cases.join(invoices.select("invoice_id", "supplier_id", "due_date", "company_id", "hotel_id"), "invoice_id")
        .join(balances_by_invoice(entries, day), "invoice_id", "left")
        .join(levels(notices), "invoice_id", "left")
        .select(
            "case_id", "invoice_id", "supplier_id", "status", "opened_at", F.coalesce("balance_cents", F.lit(0)).alias("balance_cents"), "max_level",
            deadline.alias("deadline"), (F.col("status").isin(*D.ACTIVE_CASES) & (deadline < F.lit(day))).alias("overdue"), "company_id", "hotel_id",
        )
    )


def case_counts(listed: DataFrame) -> DataFrame:
    """One row: open_cases and escalated_cases."""
    active = F.col("status").isin(*D.ACTIVE_CASES)
    return listed.agg(F.count(F.when(active, 1)).alias("open_cases"), F.count(F.when(active & (F.col("max_level") >= ESCALATED_LEVEL), 1)).alias("escalated_cases"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """(status, n)."""
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def _inside(company_id: int | None, hotel_id: int | None) -> Column:
    return F.col("hotel_id") == hotel_id if hotel_id is not None else F.col("company_id") == company_id


def documents_in_scope(documents: DataFrame, company_id: int | None = None, hotel_id: int | None = None) -> DataFrame:
    """Documents of a hotel or company, and those that nobody has been given yet."""
    return documents.where(_inside(company_id, hotel_id) | (F.col("company_id").isNull() & F.col("hotel_id").isNull()))


def payments_in_scope(payments: DataFrame, allocations: DataFrame, invoices: DataFrame, company_id: int | None = None, hotel_id: int | None = None) -> DataFrame:
    """Payments of a hotel or company, and those that pay one of its invoices; each once."""
    its = invoices.where(_inside(company_id, hotel_id)).select("invoice_id")
    paying = allocations.join(its, "invoice_id", "left_semi").select("payment_id").distinct().withColumn("pays", F.lit(True))
    return payments.join(paying, "payment_id", "left").where(_inside(company_id, hotel_id) | F.col("pays")).drop("pays")


def of_invoices_in_scope(rows: DataFrame, invoices: DataFrame, company_id: int | None = None, hotel_id: int | None = None) -> DataFrame:
    """Rows (cases, claims of notices) that belong to an invoice of a hotel or company."""
    return rows.join(invoices.where(_inside(company_id, hotel_id)).select("invoice_id"), "invoice_id", "left_semi")


def ledger_page(entries: DataFrame, entry_type: str | None = None, most: int = 5000) -> DataFrame:
    """The newest entries, of one type or of all, with ``is_reversed``; a page holds ``most``."""
    rows = entries if entry_type is None else entries.where(F.col("entry_type") == entry_type)
    undone = entries.where("reverses_entry_id is not null").select(F.col("reverses_entry_id").alias("entry_id")).distinct().withColumn("is_reversed", F.lit(True))
    newest = rows.orderBy(F.desc("entry_date"), F.desc("entry_id")).limit(most)
    return newest.join(undone, "entry_id", "left").withColumn("is_reversed", F.coalesce("is_reversed", F.lit(False)))


def contains_anywhere(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows of which any column, as text, holds the words, whatever their case."""
    return rows.where(F.contains(F.lower(F.concat_ws("\n", *[F.col(f"`{c}`").cast("string") for c in rows.columns])), F.lit(wanted.lower())))


def figures_behind(invoices: DataFrame, entries: DataFrame, unassigned: DataFrame, reconciled: DataFrame, day: date, start: date) -> DataFrame:
    """(target, id, supplier_id, entry_date, amount_cents): what is behind payments, charges, credits and differences.

    Payments and each kind of charge since ``start`` are entries (id: the invoice, null if there is none), credits are invoices and
    suppliers, differences are notices. The sum of a target's rows is its figure; ``charges`` is the sum of its four kinds.
    ``unassigned`` are the entries without an invoice, ``reconciled`` as of ``reconcile``.
    """
    inside = (F.col("entry_date") >= F.lit(start)) & (F.col("entry_date") <= F.lit(day)) & F.col("category").isin(D.PAYMENT, *D.CHARGES)
    paid = F.col("category") == D.PAYMENT
    target = F.when(paid, "paid_period").otherwise(F.concat(F.lit("charges_"), F.lower("category")))
    none = F.lit(None).cast("bigint")
    of = lambda df: df.where(inside).select(target.alias("target"), F.col("invoice_id").alias("id"), "supplier_id", "entry_date", F.when(paid, -F.col("amount_cents")).otherwise(F.col("amount_cents")).alias("amount_cents"))
    # entries are filtered before their supplier is looked up
    assigned = entries.where(inside).join(invoices.select("invoice_id", "supplier_id"), "invoice_id")
    owed = credits(invoices, entries, unassigned, day).select(F.lit("credits").alias("target"), F.col("invoice_id").alias("id"), "supplier_id", F.lit(None).cast("date").alias("entry_date"), F.col("credit_cents").alias("amount_cents"))
    differ = claim_differences(reconciled).select(F.lit("differences").alias("target"), F.col("notice_id").alias("id"), none.alias("supplier_id"), F.lit(None).cast("date").alias("entry_date"), F.abs("difference_cents").alias("amount_cents"))
    return of(assigned).unionByName(of(unassigned.withColumn("invoice_id", none))).unionByName(owed).unionByName(differ)


def attention_report(most: int = 8, **lists: tuple[DataFrame, str, str, list[Column]]) -> DataFrame:
    """(list, place, id, amount_cents, total): the first of several lists, and how long each is in all.

    Each list is a frame, its id and amount columns, and its order.
    """
    out = None
    for name, (df, key, amount, order) in lists.items():
        named = df.select(F.col(key).cast("bigint").alias("id"), F.col(amount).cast("bigint").alias("amount_cents"), F.struct(*order).alias("order"))
        first = named.orderBy("order").limit(most)  # each task keeps so many, and so does the one that merges them
        n = named.agg(F.count("*").alias("total"))
        placed = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order"))).crossJoin(F.broadcast(n))  # one row
        part = placed.select(F.lit(name).alias("list"), "place", "id", "amount_cents", "total")
        out = part if out is None else out.unionByName(part)
    return out
