"""Known answers of the ledger's operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skonto import domain as D
from skonto.operators import allocation, interest, notices, planners, recurring
from skonto.operators import ledger as L

INVOICES = "invoice_id long, supplier_id long, invoice_number string, invoice_date date, due_date date, gross_cents long, manual_status string"
ENTRIES = "entry_id long, entry_date date, supplier_id long, invoice_id long, entry_type string, category string, amount_cents long, payment_id long, reverses_entry_id long"
ITEMS = "supplier_id long, invoice_id long, due_date date, invoice_date date, open_costs_cents long, open_interest_cents long, open_principal_cents long"
DAY = date(2024, 3, 1)


def entry(k, cat, cents, invoice=1, day=DAY, kind=None, payment=None, reverses=None):
    return (k, day, 7, invoice, kind or cat, cat, cents, payment, reverses)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_worked_example(spark):
    """Fees of 500 and then 1500 are claimed: 500 and 1000 are posted; 40000 paid leave 61500."""
    claims = spark.createDataFrame([(1, 1, 500), (2, 1, 1500)], "notice_id long, invoice_id long, fees_cents long")
    assert rows(notices.plan_postings(claims), "notice_id", "posted_cents") == [(1, 500), (2, 1000)]
    items = spark.createDataFrame([(7, 1, DAY, DAY, 1500, 0, 100_000)], ITEMS)
    pay = spark.createDataFrame([(9, 7, 40_000, DAY)], "payment_id long, supplier_id long, payment_cents long, payment_date date")
    allocated, posted = planners.record_payments(pay, items)
    assert rows(allocated, "component", "allocated_cents") == [("costs", 1500), ("principal", 38_500)]
    assert rows(posted, "invoice_id", "amount_cents") == [(1, -40_000)]
    inv = spark.createDataFrame([(1, 7, "RE-1", DAY, DAY, 100_000, "open")], INVOICES)
    ledger = spark.createDataFrame([entry(1, D.INVOICE, 100_000), entry(2, D.DUNNING_FEE, 500), entry(3, D.DUNNING_FEE, 1000), entry(4, D.PAYMENT, -40_000)], ENTRIES)
    used = allocated.withColumnRenamed("allocated_cents", "amount_cents").withColumn("payment_date", F.lit(DAY))
    got = L.invoice_states(inv, ledger, used).first()
    assert (got.balance_cents, got.status, got.open_costs_cents, got.open_principal_cents) == (61_500, "partially_paid", 0, 61_500)


def test_all_zero_is_open_and_manual_wins(spark):
    inv = spark.createDataFrame([(1, 7, "A", DAY, None, 10, "open"), (2, 7, "B", DAY, None, 10, "disputed"), (3, 7, "C", DAY, None, 10, "open")], INVOICES)
    led = spark.createDataFrame([entry(1, D.INVOICE, 10), entry(2, D.INVOICE, -10, kind=D.REVERSAL, reverses=1), entry(3, D.INVOICE, 10, 2), entry(4, D.INVOICE, 10, 3), entry(5, D.PAYMENT, -15, 3)], ENTRIES)
    assert rows(L.invoice_states(inv, led), "invoice_id", "status", "credit_cents") == [(1, "open", 0), (2, "disputed", 0), (3, "paid", 5)]


def test_running_and_statement(spark):
    led = spark.createDataFrame([entry(1, D.INVOICE, 1000, day=date(2024, 1, 1)), entry(2, D.PAYMENT, -300, day=date(2024, 1, 2)), entry(3, D.DUNNING_FEE, 50, day=date(2024, 2, 1))], ENTRIES)
    ran = L.running_balance(led, ["supplier_id"], ["entry_date", "entry_id"])
    assert rows(ran, "entry_id", "running_cents") == [(1, 1000), (2, 700), (3, 750)]
    shown = L.statement(led, date(2024, 1, 2), DAY, ["entry_date", "entry_id"])
    assert rows(shown, "entry_id", "running_cents") == [(2, 700), (3, 750)]
    assert tuple(L.statement_totals(led, date(2024, 1, 2), DAY).first())[1:] == (1000, 50, 300, 750)


def test_aging_edges(spark):
    days = [(None,), (0,), (1,), (30,), (31,), (60,), (61,), (90,), (91,)]
    df = spark.createDataFrame(days, "d int").withColumn("due", F.date_sub(F.lit(DAY), F.col("d")))
    from skonto.functions.dates import aging_bucket

    got = [r[0] for r in df.select(aging_bucket(F.col("due"), F.lit(DAY))).collect()]
    assert got == ["not_due", "not_due", "1-30", "1-30", "31-60", "31-60", "61-90", "61-90", "90+"]


def test_empty_buckets_are_shown(spark):
    items = spark.createDataFrame([], "bucket string, balance_cents long")
    assert rows(L.aging_totals(items), "open_cents", "n_items") == [(0, 0)] * 5


def test_allocation_against_a_loop(spark):
    import random

    rng = random.Random(5)
    items = [(s, s * 10 + k, date(2024, 1, 1 + rng.randrange(20)), date(2024, 1, 1), rng.randrange(50), rng.randrange(30), rng.randrange(500)) for s in range(4) for k in range(6)]
    pays = [(s, s, rng.randrange(1, 2500), DAY) for s in range(4)]
    for rule in (D.STATUTORY, D.OLDEST_FIRST):
        want = []
        for p, s, amount, _ in pays:
            parts = [(stage, i[2], i[3], i[1], c, i[4 + stage]) for i in items if i[0] == s for stage, c in enumerate(("costs", "interest", "principal"))]
            parts.sort(key=(lambda x: x[:4]) if rule == D.STATUTORY else (lambda x: (*x[1:4], x[0])))
            for *_, inv, comp, size in parts:
                take = min(amount, size)
                amount -= take
                if take > 0:
                    want.append((p, inv, comp, take))
        payments = spark.createDataFrame(pays, "payment_id long, supplier_id long, payment_cents long, payment_date date")
        got = allocation.allocate(payments, spark.createDataFrame(items, ITEMS), rule)
        assert rows(got, "payment_id", "invoice_id", "component", "allocated_cents") == sorted(want)


def test_interest_against_a_day_loop(spark):
    import random
    from datetime import timedelta
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(3)
    table = [(date(2023, 7, 1), 312), (date(2024, 1, 1), 362), (date(2024, 7, 1), 337)]
    claims = [(k, rng.randrange(1, 200_000), date(2023, 1, 1) + timedelta(rng.randrange(500)), date(2023, 6, 1) + timedelta(rng.randrange(700))) for k in range(25)]
    paid = [(rng.randrange(25), date(2023, 1, 1) + timedelta(rng.randrange(800)), rng.randrange(1, 90_000)) for _ in range(40)]
    want = []
    for k, principal, due, until in claims:
        total, day = Decimal(0), due + timedelta(1)
        while day <= until:
            rest = max(0, principal - sum(a for c, d, a in paid if c == k and d < day))
            rate = [r for f, r in table if f <= day] or [table[0][1]]
            total += Decimal(rest) * (rate[-1] + 900) / 100 / 100 / 365
            day += timedelta(1)
        want.append((k, int(total.quantize(Decimal(1), ROUND_HALF_UP))))
    c = spark.createDataFrame(claims, "claim_id long, principal_cents long, due_date date, until date")
    p = spark.createDataFrame(paid, "claim_id long, payment_date date, paid_cents long")
    r = spark.createDataFrame(table, "valid_from date, rate_bp int")
    assert rows(interest.interest_totals(c, interest.interest_segments(c, p, r, 900)), "claim_id", "interest_cents") == want


def test_reconcile(spark):
    led = spark.createDataFrame([entry(1, D.INVOICE, 100_000, day=date(2024, 1, 1)), entry(2, D.DUNNING_FEE, 500, day=date(2024, 1, 5)), entry(3, D.PAYMENT, -40_000, day=date(2024, 2, 1))], ENTRIES)
    claims = spark.createDataFrame(
        [(1, 1, date(2024, 1, 10), 101_500, 0, 0), (2, 1, DAY, 100_500, 0, 0), (3, 1, DAY, 50_500, 0, 0), (4, 1, DAY, 60_500, 60_400, 0), (5, 1, DAY, 100_500, 0, 40_000)],
        "notice_id long, invoice_id long, notice_date date, computed_cents long, total_cents long, credited_cents long",
    )
    assert rows(notices.reconcile(claims, led), "notice_id", "difference_cents", "issues") == [
        (1, 1000, "DIFF"), (2, 40_000, "DIFF,PAYMENT_IGNORED"), (3, -10_000, "DIFF"), (4, -100, "SUM_MISMATCH,DIFF"), (5, 40_000, "DIFF"),
    ]


def test_recurring(spark):
    t = spark.createDataFrame(
        [(1, 7, "Miete Halle", "monthly", 31, date(2024, 1, 31), None, 14, True), (2, 7, "Wartung", "quarterly", 15, date(2024, 1, 1), date(2024, 8, 1), 14, True)],
        "recurring_id long, supplier_id long, title string, period string, day_of_month int, start_date date, end_date date, due_days int, active boolean",
    )
    got = rows(recurring.occurrences(t, date(2024, 12, 31)), "recurring_id", "occurrence")
    assert got[:3] == [(1, date(2024, 1, 31)), (1, date(2024, 2, 29)), (1, date(2024, 3, 31))]
    assert [d for k, d in got if k == 2] == [date(2024, 1, 15), date(2024, 4, 15), date(2024, 7, 15)]
    amounts = spark.createDataFrame([(1, date(2024, 2, 1), 450_000), (1, date(2024, 4, 1), 470_000)], "recurring_id long, valid_from date, gross_cents long")
    runs = spark.createDataFrame([(1, date(2024, 3, 31))], "recurring_id long, occurrence date")
    inv = spark.createDataFrame([(5, 7, "MIETE-2024-02")], "invoice_id long, supplier_id long, invoice_number string")
    due = recurring.due_invoices(t.where("recurring_id = 1"), amounts, runs, inv, date(2024, 4, 30))
    assert rows(due, "invoice_number", "gross_cents", "action") == [("MIETE-2024-01", None, "NO_AMOUNT"), ("MIETE-2024-02", 450_000, "ADOPTED"), ("MIETE-2024-04", 470_000, "CREATE")]


def test_planners_refuse(spark):
    led = spark.createDataFrame(
        [entry(1, D.INVOICE, 1000), entry(2, D.PAYMENT, -400, payment=9), entry(3, D.INVOICE, 70, 2), entry(4, D.INVOICE, -70, 2, kind=D.REVERSAL, reverses=3), entry(5, D.INVOICE, 30, 3)], ENTRIES
    )
    ask = spark.createDataFrame([(k, date(2020, 1, 1)) for k in (2, 3, 4, 5, 99)], "entry_id long, reverse_on date")
    assert rows(planners.reversals(ask, led), "reverses_entry_id", "error") == [(2, "THROUGH_PAYMENT"), (3, "REVERSED"), (4, "IS_REVERSAL"), (5, None), (99, "UNKNOWN_ENTRY")]
    assert planners.accepted(planners.reversals(ask, led)).first().entry_date == DAY
    gone = planners.cancel_invoices(spark.createDataFrame([(1,), (3,)], "invoice_id long"), led, DAY)
    assert rows(gone, "invoice_id", "amount_cents", "error") == [(1, -1000, "HAS_PAYMENTS"), (1, 400, "HAS_PAYMENTS"), (3, -30, None)]
    bad = spark.createDataFrame([entry(1, D.INVOICE, -5), entry(2, D.PAYMENT, 5), entry(3, D.ADJUSTMENT, 0), entry(4, D.ADJUSTMENT, -3)], ENTRIES)
    assert rows(planners.sign_violations(bad), "entry_id") == [(1,), (2,), (3,)]
    net, back = planners.reverse_payments(spark.createDataFrame([(9,)], "payment_id long"), led, spark.createDataFrame([(9, 1, "principal", 400)], "payment_id long, invoice_id long, component string, amount_cents long"), DAY)
    assert rows(net, "amount_cents") == [(-400,)] and rows(back, "amount_cents", "error") == [(400, None)]


def test_active_and_unapplied(spark):
    led = spark.createDataFrame([entry(1, D.PAYMENT, -10, None), entry(2, D.PAYMENT, 10, None, kind=D.REVERSAL, reverses=1), entry(3, D.PAYMENT, -20, None)], ENTRIES)
    assert rows(L.unapplied_payments(led), "entry_id") == [(3,)]
    assert rows(L.active_entries(spark.createDataFrame([], ENTRIES)), "entry_id") == []
