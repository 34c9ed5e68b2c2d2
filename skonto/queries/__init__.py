"""Queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from skonto.queries import attention, bank, changes, ledger, planning, recognition, reviews, text

MODULES = (ledger, attention, planning, bank, text, changes, recognition, reviews)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
