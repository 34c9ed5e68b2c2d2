"""Allocation over all invoices against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import date

import pytest

from skonto.queries import QUERIES
from skonto.sources.ledger_tables import LedgerTables

FOLDER = "/root/testdata/sf0.001"


def brute(invoices, oldest_first):
    """(supplier, invoice, component) -> cents, and what each supplier's payment leaves over."""
    of = defaultdict(list)
    for r in invoices:
        of[r.supplier_id].append(r)
    out, rest = Counter(), {}
    for supplier, own in of.items():
        left = sum(r.gross_cents - r.gross_cents % 100 for r in own) // 3
        parts = []
        for r in own:
            age = (r.due_date, r.invoice_date, r.invoice_id)
            for stage, (name, cents) in enumerate((("costs", r.gross_cents // 100), ("interest", r.gross_cents // 200), ("principal", r.gross_cents - r.gross_cents % 100))):
                parts.append(((*age, stage) if oldest_first else (stage, *age), r.invoice_id, name, cents))
        for _, invoice, name, cents in sorted(parts):
            used = min(cents, left)
            left -= used
            if used:
                out[supplier, invoice, name] += used
        rest[supplier] = left
    return out, rest


@pytest.fixture(scope="module")
def invoices(spark):
    rows = LedgerTables(spark, FOLDER).invoices.collect()
    dates = [r.invoice_date for r in rows]
    assert min(dates) < date(1999, 1, 1) and max(dates) >= date(1999, 7, 1)
    return rows


@pytest.mark.parametrize("name, oldest_first", [("allocation_statutory", False), ("allocation_oldest_first", True)])
def test_allocation_takes_all_invoices(spark, invoices, name, oldest_first):
    got = {(r.payment_id, r.invoice_id, r.component): r.allocated_cents for r in QUERIES[name](spark, FOLDER).collect()}
    assert got == brute(invoices, oldest_first)[0]


def test_payment_entries_take_all_invoices(spark, invoices):
    used, rest = brute(invoices, False)
    want = Counter()
    for (supplier, invoice, _), cents in used.items():
        want[supplier, invoice] -= cents
    want.update({(supplier, None): -left for supplier, left in rest.items() if left})
    assert {(r.payment_id, r.invoice_id): r.amount_cents for r in QUERIES["payment_entries"](spark, FOLDER).collect()} == want
