"""Attention lists, drill-downs and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.operators import ledger as L
from skonto.operators import notices as N
from skonto.plans import attention as A
from skonto.queries.base import AS_OF, ENTRIES, INVOICES, LEDGER, NOTICES, START
from skonto.queries.ledger import _CLAIMS, _claims, _items, _typed
from skonto.sources.ledger_tables import LedgerTables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function of the ledger's tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_WORST = "worst AS (SELECT invoice_id, max(level) AS max_level, max(new_deadline) AS last_deadline FROM notices GROUP BY 1)"
_CASES = """cases AS (SELECT invoice_id AS case_id, invoice_id, min(notice_date) AS opened_at, ['open', 'waiting', 'in_dispute', 'closed'][invoice_id % 4 + 1] AS status
  FROM notices WHERE level >= 4 GROUP BY invoice_id)"""
_LISTED = f"""listed AS (SELECT case_id, c.invoice_id, supplier_id, status, opened_at, coalesce(balance_cents, 0) AS balance_cents, max_level, coalesce(last_deadline, due_date) AS deadline,
    status <> 'closed' AND coalesce(last_deadline, due_date) < DATE '{AS_OF}' AS overdue, company_id, hotel_id
  FROM cases c JOIN invoices USING (invoice_id) LEFT JOIN balance USING (invoice_id) LEFT JOIN worst USING (invoice_id))"""


@query(f"""{LEDGER},{NOTICES}, {_WORST}, d AS (SELECT *, coalesce(last_deadline, due_date) AS deadline, CAST(date_diff('day', DATE '{AS_OF}', coalesce(last_deadline, due_date)) AS INTEGER) AS days_left
  FROM open_items LEFT JOIN worst USING (invoice_id))
SELECT invoice_id, supplier_id, deadline, days_left, CASE WHEN days_left <= 2 THEN 'critical' WHEN days_left <= 5 THEN 'warn' ELSE 'info' END AS severity, balance_cents
FROM d WHERE days_left BETWEEN 0 AND 7""")
def deadlines(t: LedgerTables) -> DataFrame:
    """All open items that fall due within a week."""
    return A.deadlines(_items(t), t.notices, AS_OF, most=None)


@query(f"""{LEDGER},{NOTICES}, {_WORST}, d AS (SELECT *, date_diff('day', DATE '{AS_OF}', coalesce(last_deadline, due_date)) AS days_left FROM open_items LEFT JOIN worst USING (invoice_id))
SELECT invoice_id, CAST(days_left AS INTEGER) AS days_left FROM d WHERE days_left BETWEEN 0 AND 7 ORDER BY days_left, invoice_date, invoice_id LIMIT 8""")
def next_deadlines(t: LedgerTables) -> DataFrame:
    """The eight that a dashboard shows."""
    return A.deadlines(_items(t), t.notices, AS_OF).select("invoice_id", "days_left")


@query(f"""WITH {INVOICES},{ENTRIES},{NOTICES}{_CLAIMS}, n AS (SELECT notice_id, sum(difference_cents) AS d FROM r GROUP BY 1)
SELECT CAST(coalesce(sum(abs(d)), 0) AS BIGINT) AS claim_diff_cents, count(*) AS n_notices FROM n WHERE d <> 0""")
def claim_difference(t: LedgerTables) -> DataFrame:
    """By how much notices differ from the ledger, all told."""
    found = A.claim_differences(N.reconcile(_claims(t), _typed(t)))
    return found.agg(F.coalesce(F.sum(F.abs("difference_cents")), F.lit(0)).alias("claim_diff_cents"), F.count("*").alias("n_notices"))


@query(f"""{LEDGER}, u AS (SELECT supplier_id, CAST(-sum(amount_cents) AS BIGINT) AS c FROM entries WHERE invoice_id IS NULL AND entry_date <= DATE '{AS_OF}' GROUP BY 1 HAVING sum(amount_cents) < 0)
SELECT 'unassigned' AS kind, supplier_id, NULL AS invoice_id, c AS credit_cents FROM u
UNION ALL SELECT 'overpaid', supplier_id, invoice_id, -balance_cents FROM balance JOIN invoices USING (invoice_id) WHERE balance_cents < 0 AND manual_status <> 'cancelled'""")
def credit_list(t: LedgerTables) -> DataFrame:
    return A.credits(t.invoices, t.entries_by_invoice, t.unassigned, AS_OF)


def _drill_sql() -> str:
    ahead = f"date_diff('day', DATE '{AS_OF}', due_date)"
    tests = {"open": "true", "overdue": f"due_date < DATE '{AS_OF}'", **{f"due_{n}": f"{ahead} BETWEEN 0 AND {n}" for n in (7, 14, 30)}, **{f"aging_{b}": f"bucket = '{b}'" for b in D.BUCKETS}}
    tests |= {f"forecast_{a}-{b}": f"{ahead} BETWEEN {a} AND {b}" for a, b in ((0, 30), (31, 60), (61, 90))} | {f"level_{n}": f"max_level = {n}" for n in D.DUNNING_LEVELS}
    one = "SELECT '{}' AS target, invoice_id, supplier_id, due_date, balance_cents FROM open_items LEFT JOIN worst USING (invoice_id) WHERE {}"
    return f"{LEDGER},{NOTICES}, {_WORST} " + " UNION ALL ".join(one.format(*x) for x in tests.items())


@query(_drill_sql())
def drill_down(t: LedgerTables) -> DataFrame:
    """The open items behind every figure and segment of the dashboard."""
    return A.drill_down(_items(t), t.notices, AS_OF)


@query(f"{LEDGER},{NOTICES}, {_WORST}, {_CASES}, {_LISTED} SELECT * FROM listed")
def case_list(t: LedgerTables) -> DataFrame:
    return A.case_list(t.cases, t.invoices, t.entries_by_invoice, t.notices, AS_OF)


@query(f"{LEDGER},{NOTICES}, {_WORST}, {_CASES}, {_LISTED} SELECT count(*) FILTER (status <> 'closed') AS open_cases, count(*) FILTER (status <> 'closed' AND max_level >= 5) AS escalated_cases FROM listed")
def case_counts(t: LedgerTables) -> DataFrame:
    return A.case_counts(A.case_list(t.cases, t.invoices, t.entries_by_invoice, t.notices, AS_OF))


@query(f"{LEDGER},{NOTICES}, {_CASES} SELECT case_id, invoice_id, opened_at, status FROM cases JOIN invoices USING (invoice_id) WHERE hotel_id = 7")
def cases_of_hotel(t: LedgerTables) -> DataFrame:
    return A.of_invoices_in_scope(t.cases, t.invoices, hotel_id=7).select("case_id", "invoice_id", "opened_at", "status")


@query(f"""{LEDGER} SELECT invoice_id AS payment_id, company_id, hotel_id FROM invoices WHERE invoice_id IN (SELECT invoice_id FROM invoices WHERE company_id = 2)
  OR company_id = 2 OR invoice_id + 1 IN (SELECT invoice_id FROM invoices WHERE company_id = 2)""")
def payments_of_company(t: LedgerTables) -> DataFrame:
    """A payment for each invoice, that also pays the invoice of the next number: those of a company, or that pay for it."""
    paid = t.invoices.select(F.col("invoice_id").alias("payment_id"), "company_id", "hotel_id")
    parts = paid.select("payment_id", F.explode(F.array("payment_id", F.col("payment_id") + 1)).alias("invoice_id"))
    return A.payments_in_scope(paid, parts, t.invoices, company_id=2).select("payment_id", "company_id", "hotel_id")


_CHARGES = "'DUNNING_FEE', 'LATE_INTEREST', 'LATE_PAYMENT_FLAT_FEE', 'COLLECTION_COST'"


@query(f"""{LEDGER},{NOTICES}{_CLAIMS}, u AS (SELECT supplier_id, CAST(-sum(amount_cents) AS BIGINT) AS c FROM entries WHERE invoice_id IS NULL AND entry_date <= DATE '{AS_OF}' GROUP BY 1 HAVING sum(amount_cents) < 0),
n AS (SELECT notice_id, CAST(sum(difference_cents) AS BIGINT) AS d FROM r GROUP BY 1)
SELECT CASE category WHEN 'PAYMENT' THEN 'paid_period' ELSE 'charges_' || lower(category) END AS target, invoice_id AS id, supplier_id, entry_date, CASE category WHEN 'PAYMENT' THEN -amount_cents ELSE amount_cents END AS amount_cents
  FROM entries WHERE entry_date BETWEEN DATE '{START}' AND DATE '{AS_OF}' AND category IN ('PAYMENT', {_CHARGES})
UNION ALL SELECT 'credits', NULL, supplier_id, NULL, c FROM u
UNION ALL SELECT 'credits', invoice_id, supplier_id, NULL, -balance_cents FROM balance JOIN invoices USING (invoice_id) WHERE balance_cents < 0 AND manual_status <> 'cancelled'
UNION ALL SELECT 'differences', notice_id, NULL, NULL, abs(d) FROM n WHERE d <> 0""")
def figures_behind(t: LedgerTables) -> DataFrame:
    """The payments, charges, credits and differences behind the dashboard's figures."""
    return A.figures_behind(t.invoices, t.entries_by_invoice, t.unassigned, N.reconcile(_claims(t), _typed(t)), AS_OF, START)


@query(f"""{LEDGER},{NOTICES}, {_WORST}, d AS (SELECT invoice_id AS id, balance_cents AS amount_cents, date_diff('day', DATE '{AS_OF}', coalesce(last_deadline, due_date)) AS days_left, invoice_date FROM open_items LEFT JOIN worst USING (invoice_id)),
twice AS (SELECT invoice_id, supplier_id, gross_cents, invoice_date, manual_status FROM invoices
    UNION ALL SELECT invoice_id + 10000000, supplier_id, gross_cents, invoice_date + CAST(invoice_id % 20 AS INTEGER), manual_status FROM invoices WHERE invoice_id % 37 = 0),
x AS (SELECT *, date_diff('day', lag(invoice_date) OVER w, invoice_date) AS between FROM twice WHERE manual_status <> 'cancelled' WINDOW w AS (PARTITION BY supplier_id, gross_cents ORDER BY invoice_date, invoice_id)),
b AS (SELECT event_id AS id, -CAST(round(value * 100) AS BIGINT) AS amount_cents, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0),
l AS (SELECT 'deadlines' AS list, row_number() OVER (ORDER BY days_left, invoice_date, id) AS place, id, amount_cents, count(*) OVER () AS total FROM d WHERE days_left BETWEEN 0 AND 7
  UNION ALL SELECT 'bank_lines', row_number() OVER (ORDER BY day DESC, id), id, amount_cents, count(*) OVER () FROM b
  UNION ALL SELECT 'duplicates', row_number() OVER (ORDER BY invoice_date DESC, invoice_id), invoice_id, gross_cents, count(*) OVER () FROM x WHERE between <= 14)
SELECT list, CAST(place AS INTEGER) AS place, id, amount_cents, total FROM l WHERE place <= 8""")
def attention_report(t: LedgerTables) -> DataFrame:
    """Deadlines, bank lines that wait and duplicates in one report, the first eight of each."""
    dated = A.deadlines(_items(t), t.notices, AS_OF, most=None).join(t.invoices.select("invoice_id", "invoice_date"), "invoice_id")
    waiting = t.bank_lines.where("tx_id % 3 = 0")
    again = t.invoices.where("invoice_id % 37 = 0").withColumns({"invoice_date": F.date_add("invoice_date", (F.col("invoice_id") % 20).cast("int")), "invoice_id": F.col("invoice_id") + 10_000_000})
    double = L.duplicate_invoices(t.invoices.unionByName(again))
    return A.attention_report(
        deadlines=(dated, "invoice_id", "balance_cents", [F.col("days_left"), F.col("invoice_date"), F.col("invoice_id")]),
        bank_lines=(waiting, "tx_id", "amount_cents", [-F.unix_date("booking_date").alias("day"), F.col("tx_id")]),
        duplicates=(double, "invoice_id", "gross_cents", [-F.unix_date("invoice_date").alias("day"), F.col("invoice_id")]),
    )
