"""Dates of the queries and the ledger view in SQL."""

from __future__ import annotations

from datetime import date

AS_OF, START = date(1999, 12, 31), date(1999, 1, 1)

INVOICES = """
ns AS (SELECT count(*) AS n FROM supplier),
invoices AS (
  SELECT o_orderkey AS invoice_id, o_custkey % (SELECT n FROM ns) AS supplier_id,
    'RE-' || year(o_orderdate) || '/' || printf('%06d', o_orderkey) AS invoice_number,
    CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 30 AS due_date, CAST(round(o_totalprice * 100) AS BIGINT) AS gross_cents,
    CASE WHEN o_orderkey % 97 = 0 THEN 'cancelled' WHEN o_orderstatus = 'P' THEN 'disputed' ELSE 'open' END AS manual_status,
    n_regionkey AS company_id, n_nationkey AS hotel_id
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""
ENTRIES = """
line AS (
  SELECT l_orderkey AS order_id, CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN NULL ELSE l_orderkey END AS invoice_id, CAST(l_shipdate AS DATE) AS entry_date,
    CASE l_returnflag WHEN 'A' THEN 'PAYMENT' WHEN 'R' THEN 'CREDIT_NOTE' ELSE CASE WHEN l_linestatus = 'O' THEN 'DUNNING_FEE' ELSE 'LATE_INTEREST' END END AS category,
    CASE WHEN l_returnflag IN ('A', 'R') THEN -CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)
      ELSE CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) END AS amount_cents,
    l_partkey AS part, l_linenumber AS line
  FROM lineitem),
entries AS (
  SELECT o_orderkey AS invoice_id, CAST(o_orderdate AS DATE) AS entry_date, o_custkey % (SELECT n FROM ns) AS supplier_id, 'INVOICE' AS category,
    CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, 0 AS part, 0 AS line FROM orders WHERE round(o_totalprice * 100) <> 0
  UNION ALL
  SELECT line.invoice_id, entry_date, o_custkey % (SELECT n FROM ns), category, amount_cents, part, line FROM line JOIN orders ON order_id = o_orderkey WHERE amount_cents <> 0)"""
NOTICES = """
notices AS (
  SELECT event_id AS notice_id, event_id % (SELECT count(*) FROM orders) AS invoice_id, CAST(ts AS DATE) AS notice_date, CAST(1 + event_id % 6 AS INTEGER) AS level,
    CAST(round(value * 100) AS BIGINT) AS fees_cents, CAST(ts AS DATE) + 14 AS new_deadline FROM events WHERE event_type = 'error')"""
BANK = """
bank AS (
  SELECT event_id AS tx_id, 1 AS account_id, CAST(ts AS DATE) AS booking_date, -CAST(round(value * 100) AS BIGINT) AS amount_cents, 'Kunde ' || user_id AS counterparty_name, props AS purpose
  FROM events WHERE event_type = 'purchase')"""
OPEN = f"""
balance AS (SELECT invoice_id, CAST(sum(amount_cents) AS BIGINT) AS balance_cents FROM entries WHERE entry_date <= DATE '{AS_OF}' AND invoice_id IS NOT NULL GROUP BY invoice_id),
open_items AS (
  SELECT invoices.*, balance_cents, CASE WHEN date_diff('day', due_date, DATE '{AS_OF}') <= 0 THEN 'not_due' WHEN date_diff('day', due_date, DATE '{AS_OF}') <= 30 THEN '1-30'
    WHEN date_diff('day', due_date, DATE '{AS_OF}') <= 60 THEN '31-60' WHEN date_diff('day', due_date, DATE '{AS_OF}') <= 90 THEN '61-90' ELSE '90+' END AS bucket
  FROM invoices JOIN balance USING (invoice_id) WHERE balance_cents > 0 AND manual_status <> 'cancelled')"""
LEDGER = f"WITH {INVOICES},{ENTRIES},{OPEN}"
