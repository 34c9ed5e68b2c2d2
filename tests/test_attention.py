"""Scopes, pages, drill-downs that add up to their figures, credits of mixed signs, bank files in Windows-1252."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skonto.plans import attention as A
from skonto.plans import dashboard
from skonto.sources import bank_files
from skonto.sources.ledger_tables import LedgerTables

DAY = date(1999, 12, 31)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_credits_of_suppliers_do_not_cancel(spark):
    invoices = frame(spark, [(1, date(2024, 2, 1), "open"), (2, date(2024, 2, 1), "cancelled")], "invoice_id long, due_date date, manual_status string")
    day = date(2024, 1, 10)
    entries = frame(spark, [(1, day, "INVOICE", 100), (1, day, "PAYMENT", -130), (2, day, "PAYMENT", -50)], "invoice_id long, entry_date date, category string, amount_cents long")
    loose = frame(spark, [(5, day, "PAYMENT", -70), (6, day, "ADJUSTMENT", 90), (5, day, "ADJUSTMENT", 10)], "supplier_id long, entry_date date, category string, amount_cents long")
    notices = frame(spark, [], "invoice_id long, level int")
    r = dashboard.key_figures(invoices, entries, loose, notices, date(2024, 3, 1), date(2024, 1, 1)).first()
    assert (r.overpaid, r.unassigned, r.credits, r.paid_period) == (30, 60, 90, 250)


def test_drill_down_adds_up(spark):
    t = LedgerTables(spark, "/root/testdata/sf0.001")
    from skonto.operators.ledger import open_items

    items = open_items(t.invoices, t.entries_by_invoice, DAY)
    k = dashboard.key_figures(t.invoices, t.entries_by_invoice, t.unassigned, t.notices, DAY, date(1999, 1, 1)).first()
    sums = {r.target: r.s for r in A.drill_down(items, t.notices, DAY).groupBy("target").agg(F.sum("balance_cents").alias("s")).collect()}
    assert sums["open"] == k.total_open and all(sums.get(x, 0) == k[x] for x in ("overdue", "due_7", "due_14", "due_30"))
    assert sum(v for x, v in sums.items() if x.startswith("aging_")) == k.total_open
    assert {r.target for r in A.drill_down(items, t.notices, DAY, ["overdue"]).select("target").distinct().collect()} <= {"overdue"}


def test_scopes(spark):
    place = "company_id long, hotel_id long"
    invoices = frame(spark, [(1, 1, 10), (2, 1, 11), (3, 2, 20)], f"invoice_id long, {place}")
    documents = frame(spark, [(1, 1, 10), (2, 1, None), (3, 2, 20), (4, None, None)], f"doc_id long, {place}")
    ids = lambda df, c: sorted(r[c] for r in df.collect())
    assert ids(A.documents_in_scope(documents, company_id=1), "doc_id") == [1, 2, 4] and ids(A.documents_in_scope(documents, hotel_id=10), "doc_id") == [1, 4]
    payments = frame(spark, [(1, 1, 10), (2, None, None), (3, 2, 20), (4, None, None)], f"payment_id long, {place}")
    parts = frame(spark, [(2, 1), (2, 1), (3, 3), (3, 2)], "payment_id long, invoice_id long")
    assert ids(A.payments_in_scope(payments, parts, invoices, company_id=1), "payment_id") == [1, 2, 3]
    cases = frame(spark, [(7, 1), (8, 3), (9, None)], "case_id long, invoice_id long")
    assert ids(A.of_invoices_in_scope(cases, invoices, hotel_id=20), "case_id") == [8]


def test_pages_and_filters(spark):
    rows = [(k, f"2024-01-{k:02}", "PAYMENT" if k % 2 else "REVERSAL", k - 1 if k == 4 else None) for k in range(1, 7)]
    entries = frame(spark, rows, "entry_id long, entry_date string, entry_type string, reverses_entry_id long")
    got = {r.entry_id: r.is_reversed for r in A.ledger_page(entries, "PAYMENT", 2).collect()}
    assert got == {5: False, 3: True}
    assert [r.entry_id for r in A.contains_anywhere(entries, "01-05").collect()] == [5] and A.contains_anywhere(entries, "pay").count() == 3
    assert {r.status: r.n for r in A.status_counts(entries, "entry_type").collect()} == {"PAYMENT": 3, "REVERSAL": 3}


def test_encodings(spark, tmp_path):
    texts = {"utf8.csv": "Größe €".encode(), "windows.csv": "Größe € – „x“".encode("cp1252"), "latin.csv": b"Gr\xf6\xdfe \x81 \x80", "bom.csv": b"\xef\xbb\xbfx"}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in bank_files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"utf8.csv": "Größe €", "windows.csv": "Größe € – „x“", "latin.csv": "Größe \x81 \x80", "bom.csv": "x"}
