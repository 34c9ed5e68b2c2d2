"""Closed domains and default settings of the payables ledger."""

from __future__ import annotations

from datetime import date

# Entry types and what they mean.
INVOICE, CREDIT_NOTE, PAYMENT = "INVOICE", "CREDIT_NOTE", "PAYMENT"
DUNNING_FEE, LATE_INTEREST, FLAT_FEE, COLLECTION_COST = "DUNNING_FEE", "LATE_INTEREST", "LATE_PAYMENT_FLAT_FEE", "COLLECTION_COST"
ADJUSTMENT, WRITE_OFF, REVERSAL = "ADJUSTMENT", "WRITE_OFF", "REVERSAL"
ENTRY_TYPES = (INVOICE, CREDIT_NOTE, PAYMENT, DUNNING_FEE, LATE_INTEREST, FLAT_FEE, COLLECTION_COST, ADJUSTMENT, WRITE_OFF, REVERSAL)
CHARGES = (DUNNING_FEE, LATE_INTEREST, FLAT_FEE, COLLECTION_COST)
ALWAYS_NEGATIVE = (PAYMENT, CREDIT_NOTE, WRITE_OFF)
ALWAYS_POSITIVE = (INVOICE, *CHARGES)

OPEN, PARTIALLY_PAID, PAID, DISPUTED, CANCELLED = "open", "partially_paid", "paid", "disputed", "cancelled"
CASE_OPEN, CASE_WAITING, CASE_IN_DISPUTE, CASE_PAID, CASE_CLOSED = "open", "waiting", "in_dispute", "paid", "closed"
ACTIVE_CASES = (CASE_OPEN, CASE_WAITING, CASE_IN_DISPUTE)
TX_NEW, TX_MATCHED, TX_BOOKED, TX_IGNORED = "new", "matched", "booked", "ignored"
REVIEW_PENDING, REVIEW_NEEDED, REVIEW_ACCEPTED, REVIEW_REJECTED = "pending", "needs_review", "accepted", "rejected"
COSTS, INTEREST, PRINCIPAL = "costs", "interest", "principal"
STATUTORY, OLDEST_FIRST, MANUAL = "statutory", "oldest_first", "manual"
BUCKETS = ("not_due", "1-30", "31-60", "61-90", "90+")
DUNNING_LEVELS = (1, 2, 3, 4, 5, 6)
SUPPLIER, AGENCY = "supplier", "collection_agency"
MONTHS_OF_PERIOD = {"monthly": 1, "quarterly": 3, "half_yearly": 6, "yearly": 12}

# Defaults of the settings.
MARGIN_B2B, MARGIN_B2C = "9", "5"
FLAT_FEE_CENTS = 4000
PAYMENT_DAYS = 30
LOW_CONFIDENCE = 0.75
BASE_RATES = (
    (date(2020, 1, 1), "-0.88"),
    (date(2021, 1, 1), "-0.88"),
    (date(2022, 1, 1), "-0.88"),
    (date(2022, 7, 1), "-0.88"),
    (date(2023, 1, 1), "1.62"),
    (date(2023, 7, 1), "3.12"),
    (date(2024, 1, 1), "3.62"),
    (date(2024, 7, 1), "3.37"),
    (date(2025, 1, 1), "2.27"),
    (date(2025, 7, 1), "1.27"),
)
