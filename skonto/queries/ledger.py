"""Balances, aging, statements, trends and the dashboard."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto.functions.dates import format_day
from skonto.operators import ledger as L
from skonto.operators import notices as N
from skonto.plans import dashboard, reports
from skonto.queries.base import AS_OF, ENTRIES, INVOICES, LEDGER, NOTICES, START
from skonto.sources.ledger_tables import ORDER, LedgerTables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function of the ledger's tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _items(t: LedgerTables) -> DataFrame:
    return L.open_items(t.invoices, t.entries_by_invoice, AS_OF)


@query(f"""{LEDGER}
SELECT b AS bucket, CAST(coalesce(sum(balance_cents), 0) AS BIGINT) AS open_cents, count(invoice_id) AS n_items
FROM (VALUES ('not_due'), ('1-30'), ('31-60'), ('61-90'), ('90+')) v(b) LEFT JOIN open_items ON bucket = b GROUP BY b""")
def aging(t: LedgerTables) -> DataFrame:
    """What is owed and how late it is."""
    return L.aging_totals(_items(t))


@query(f"{LEDGER} SELECT category, CAST(sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS n_entries FROM entries WHERE entry_date <= DATE '{AS_OF}' GROUP BY category")
def category_sums(t: LedgerTables) -> DataFrame:
    return L.sums_by_category(t.entries, AS_OF)


@query(f"{LEDGER} SELECT strftime(entry_date, '%Y-%m') AS month, category, CAST(sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS n_entries FROM entries WHERE entry_date <= DATE '{AS_OF}' GROUP BY ALL")
def category_sums_by_month(t: LedgerTables) -> DataFrame:
    return L.sums_by_category(t.entries, AS_OF, by_month=True)


def _sum(sign: str, category: str) -> str:
    return f"CAST({sign}coalesce(sum(amount_cents) FILTER (category = '{category}'), 0) AS BIGINT)"


@query(f"""WITH {INVOICES},{ENTRIES},
s AS (
  SELECT invoice_id, {_sum('', 'INVOICE')} AS invoiced_cents, {_sum('-', 'CREDIT_NOTE')} AS credits_cents, {_sum('', 'DUNNING_FEE')} AS fees_cents, {_sum('', 'LATE_INTEREST')} AS interest_cents,
    {_sum('-', 'PAYMENT')} AS paid_cents, CAST(sum(amount_cents) AS BIGINT) AS balance_cents
  FROM entries WHERE invoice_id IS NOT NULL AND entry_date <= DATE '{AS_OF}' GROUP BY invoice_id)
SELECT invoice_id, supplier_id, invoiced_cents, credits_cents, fees_cents, interest_cents, paid_cents, balance_cents, fees_cents AS open_costs_cents, interest_cents AS open_interest_cents,
  invoiced_cents - credits_cents AS open_principal_cents, greatest(0, balance_cents) AS open_cents, greatest(0, -balance_cents) AS credit_cents,
  CASE WHEN manual_status <> 'open' THEN manual_status WHEN invoiced_cents = 0 AND credits_cents = 0 AND fees_cents = 0 AND interest_cents = 0 AND paid_cents = 0 THEN 'open'
    WHEN balance_cents <= 0 THEN 'paid' WHEN paid_cents > 0 THEN 'partially_paid' ELSE 'open' END AS status
FROM invoices JOIN s USING (invoice_id)""")
def invoice_states(t: LedgerTables) -> DataFrame:
    """Every invoice with its measures and status."""
    names = "invoiced credits fees interest paid balance open_costs open_interest open_principal open credit".split()
    return L.invoice_states(t.invoices, t.entries_by_invoice, None, AS_OF).select("invoice_id", "supplier_id", *[f"{n}_cents" for n in names], "status")


@query(f"""{LEDGER} SELECT supplier_id, CAST(coalesce(sum(amount_cents) FILTER (invoice_id IS NOT NULL), 0) AS BIGINT) AS invoices_cents,
  CAST(coalesce(sum(amount_cents) FILTER (invoice_id IS NULL), 0) AS BIGINT) AS unapplied_cents, CAST(sum(amount_cents) AS BIGINT) AS balance_cents
FROM entries WHERE entry_date <= DATE '{AS_OF}' GROUP BY supplier_id""")
def supplier_balances(t: LedgerTables) -> DataFrame:
    return L.supplier_balances(t.entries, AS_OF)


@query(f"""{LEDGER} SELECT supplier_id, CAST(sum(balance_cents) AS BIGINT) AS open_cents, CAST(coalesce(sum(balance_cents) FILTER (due_date < DATE '{AS_OF}'), 0) AS BIGINT) AS overdue_cents,
  count(*) AS n_open, count(*) FILTER (due_date < DATE '{AS_OF}') AS n_overdue FROM open_items GROUP BY supplier_id""")
def supplier_overview(t: LedgerTables) -> DataFrame:
    return L.supplier_overview(_items(t), AS_OF)


@query(f"{LEDGER} SELECT supplier_id, CAST(sum(balance_cents) AS BIGINT) AS open_cents, count(*) AS n_items FROM open_items GROUP BY supplier_id ORDER BY open_cents DESC, min((invoice_date, invoice_id)) LIMIT 10")
def top_suppliers(t: LedgerTables) -> DataFrame:
    return L.top_suppliers(_items(t))


@query(f"""{LEDGER} SELECT company_id, hotel_id, CAST(grouping(company_id, hotel_id) AS INTEGER) AS level, CAST(sum(balance_cents) AS BIGINT) AS open_cents, count(*) AS n_items
FROM open_items GROUP BY ROLLUP (company_id, hotel_id)""")
def scope_rollup(t: LedgerTables) -> DataFrame:
    """Open amounts of every scope."""
    return L.scope_rollup(_items(t))


@query(f"""{LEDGER} SELECT hotel_id, bucket, CAST(sum(balance_cents) AS BIGINT) AS open_cents FROM open_items WHERE company_id = 2 GROUP BY ALL""")
def company_aging(t: LedgerTables) -> DataFrame:
    """One company's hotels."""
    return L.scoped(_items(t), company_id=2).groupBy("hotel_id", "bucket").agg(F.sum("balance_cents").alias("open_cents"))


@query(f"""{LEDGER}, r AS (SELECT supplier_id, entry_date, invoice_id, category, amount_cents, part, line,
  CAST(sum(amount_cents) OVER (PARTITION BY supplier_id ORDER BY entry_date, invoice_id NULLS FIRST, category, amount_cents, part, line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents
  FROM entries WHERE entry_date <= DATE '{AS_OF}')
SELECT * FROM r WHERE entry_date >= DATE '{START}'""")
def statement(t: LedgerTables) -> DataFrame:
    """The accounts of all suppliers in a year, with running balances."""
    return L.statement(t.entries, START, AS_OF, ORDER).select("supplier_id", "entry_date", "invoice_id", "category", "amount_cents", "part", "line", "running_cents")


@query(f"""{LEDGER} SELECT supplier_id, CAST(coalesce(sum(amount_cents) FILTER (entry_date < DATE '{START}'), 0) AS BIGINT) AS opening_cents,
  CAST(coalesce(sum(greatest(amount_cents, 0)) FILTER (entry_date >= DATE '{START}'), 0) AS BIGINT) AS debit_cents,
  CAST(coalesce(sum(greatest(-amount_cents, 0)) FILTER (entry_date >= DATE '{START}'), 0) AS BIGINT) AS credit_cents, CAST(sum(amount_cents) AS BIGINT) AS closing_cents
FROM entries WHERE entry_date <= DATE '{AS_OF}' GROUP BY supplier_id""")
def statement_totals(t: LedgerTables) -> DataFrame:
    return L.statement_totals(t.entries, START, AS_OF)


@query(f"""{LEDGER}, m AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '1999-12-01', INTERVAL 1 MONTH))::DATE AS m)
SELECT strftime(m, '%Y-%m') AS month, CAST(coalesce(sum(amount_cents) FILTER (category = 'INVOICE' AND date_trunc('month', entry_date) = m), 0) AS BIGINT) AS invoiced_cents,
  CAST(coalesce(-sum(amount_cents) FILTER (category = 'PAYMENT' AND date_trunc('month', entry_date) = m), 0) AS BIGINT) AS paid_cents, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS balance_cents
FROM m LEFT JOIN entries ON entry_date <= DATE '{AS_OF}' AND entry_date < m + INTERVAL 1 MONTH GROUP BY m""")
def monthly_trend(t: LedgerTables) -> DataFrame:
    return L.monthly_trend(t.entries, AS_OF)


@query(f"""WITH {INVOICES}, x AS (SELECT *, lag(invoice_id) OVER w AS previous_id, date_diff('day', lag(invoice_date) OVER w, invoice_date) AS days_between FROM invoices
  WHERE manual_status <> 'cancelled' WINDOW w AS (PARTITION BY supplier_id, gross_cents ORDER BY invoice_date, invoice_id))
SELECT invoice_id, previous_id, CAST(days_between AS INTEGER) AS days_between FROM x WHERE days_between <= 14""")
def duplicate_invoices(t: LedgerTables) -> DataFrame:
    """Invoices as they are: none comes twice."""
    return L.duplicate_invoices(t.invoices).select("invoice_id", "previous_id", "days_between")


@query(f"""WITH {INVOICES}, twice AS (SELECT invoice_id, supplier_id, gross_cents, invoice_date, manual_status FROM invoices
    UNION ALL SELECT invoice_id + 10000000, supplier_id, gross_cents, invoice_date + CAST(invoice_id % 20 AS INTEGER), manual_status FROM invoices WHERE invoice_id % 37 = 0),
x AS (SELECT *, lag(invoice_id) OVER w AS previous_id, date_diff('day', lag(invoice_date) OVER w, invoice_date) AS days_between FROM twice
  WHERE manual_status <> 'cancelled' WINDOW w AS (PARTITION BY supplier_id, gross_cents ORDER BY invoice_date, invoice_id))
SELECT invoice_id, previous_id, CAST(days_between AS INTEGER) AS days_between FROM x WHERE days_between <= 14""")
def planted_duplicates(t: LedgerTables) -> DataFrame:
    """Each 37th invoice comes a second time, up to twenty days later."""
    again = t.invoices.where("invoice_id % 37 = 0").withColumns({"invoice_date": F.date_add("invoice_date", (F.col("invoice_id") % 20).cast("int")), "invoice_id": F.col("invoice_id") + 10_000_000})
    return L.duplicate_invoices(t.invoices.unionByName(again)).select("invoice_id", "previous_id", "days_between")


@query(f"""WITH {INVOICES},{ENTRIES},
e AS (SELECT invoice_id, {_sum('', 'INVOICE')} AS invoiced, {_sum('-', 'CREDIT_NOTE')} AS credits, {_sum('', 'DUNNING_FEE')} AS fees, {_sum('', 'LATE_INTEREST')} AS interest
  FROM entries WHERE invoice_id IS NOT NULL AND entry_date <= DATE '{AS_OF}' GROUP BY invoice_id),
u AS (SELECT invoice_id, gross_cents // 100 AS costs, CASE WHEN invoice_id % 2 = 0 THEN gross_cents // 200 ELSE 0 END AS i, gross_cents // 4 AS p FROM invoices)
SELECT invoice_id, fees - costs AS open_costs_cents, interest - i AS open_interest_cents, invoiced - credits - p AS open_principal_cents FROM invoices JOIN e USING (invoice_id) JOIN u USING (invoice_id)""")
def allocated_states(t: LedgerTables) -> DataFrame:
    """What is open of each invoice's costs, interest and principal after payments were used for them; later payments don't count."""
    g, used = F.col("gross_cents"), lambda c, cents, day=AS_OF: F.struct(F.lit(c).alias("component"), cents.cast("bigint").alias("amount_cents"), F.lit(day).alias("payment_date"))
    rows = F.array(used("costs", F.floor(g / 100)), used("interest", F.when(F.col("invoice_id") % 2 == 0, F.floor(g / 200)).otherwise(0)), used("principal", F.floor(g / 4)), used("principal", F.floor(g / 2), date(2000, 6, 1)))
    allocations = t.invoices.select("invoice_id", F.inline(rows))
    return L.invoice_states(t.invoices, t.entries_by_invoice, allocations, AS_OF).select("invoice_id", "open_costs_cents", "open_interest_cents", "open_principal_cents")


@query(f"""{LEDGER}, w AS (SELECT CASE WHEN d BETWEEN 0 AND 30 THEN '0-30' WHEN d BETWEEN 31 AND 60 THEN '31-60' WHEN d BETWEEN 61 AND 90 THEN '61-90' END AS win, balance_cents
  FROM (SELECT date_diff('day', DATE '{AS_OF}', due_date) AS d, balance_cents FROM open_items))
SELECT win AS "window", CAST(sum(balance_cents) AS BIGINT) AS open_cents, count(*) AS n_items FROM w WHERE win IS NOT NULL GROUP BY win""")
def forecast(t: LedgerTables) -> DataFrame:
    return L.forecast(_items(t), AS_OF)


@query(f"{LEDGER} SELECT supplier_id, CAST(sum(amount_cents) AS BIGINT) AS unapplied_cents FROM entries WHERE invoice_id IS NULL AND entry_date <= DATE '{AS_OF}' GROUP BY supplier_id")
def unapplied(t: LedgerTables) -> DataFrame:
    return L.unapplied_by_supplier(t.entries, AS_OF)


@query(f"""{LEDGER} SELECT CAST(sum(amount_cents) AS BIGINT) AS all_cents, CAST(sum(amount_cents) FILTER (invoice_id IS NOT NULL) AS BIGINT) AS invoices_cents,
  CAST(sum(amount_cents) FILTER (invoice_id IS NULL) AS BIGINT) AS unapplied_cents FROM entries""")
def invariants(t: LedgerTables) -> DataFrame:
    return L.reconciliation_totals(t.entries)


@query(f"""WITH {INVOICES},{ENTRIES},{NOTICES}, e AS (SELECT invoice_id, entry_date AS day, CASE category WHEN 'INVOICE' THEN 0 WHEN 'CREDIT_NOTE' THEN 3 WHEN 'PAYMENT' THEN 4 ELSE 2 END AS rank,
    category AS kind, amount_cents, CAST(sum(amount_cents) OVER (PARTITION BY invoice_id ORDER BY entry_date, category, amount_cents, part, line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents
  FROM entries WHERE invoice_id IS NOT NULL)
SELECT * FROM e UNION ALL SELECT invoice_id, notice_date, 1, 'NOTICE_' || level, NULL, NULL FROM notices""")
def invoice_history(t: LedgerTables) -> DataFrame:
    return L.invoice_history(t.entries_by_invoice, t.notices, ORDER)


@query(f"""{LEDGER},{NOTICES}, worst AS (SELECT invoice_id, max(level) AS max_level FROM notices GROUP BY 1),
p AS (SELECT CAST(coalesce(-sum(amount_cents) FILTER (category = 'PAYMENT'), 0) AS BIGINT) AS paid_period,
    CAST(coalesce(sum(amount_cents) FILTER (category IN ('DUNNING_FEE', 'LATE_INTEREST', 'LATE_PAYMENT_FLAT_FEE', 'COLLECTION_COST')), 0) AS BIGINT) AS charges
  FROM entries WHERE entry_date BETWEEN DATE '{START}' AND DATE '{AS_OF}'),
u AS (SELECT CAST(coalesce(-sum(s), 0) AS BIGINT) AS unassigned FROM (SELECT sum(amount_cents) AS s FROM entries WHERE invoice_id IS NULL AND entry_date <= DATE '{AS_OF}' GROUP BY supplier_id) WHERE s < 0),
c AS (SELECT CAST(coalesce(-sum(balance_cents), 0) AS BIGINT) AS overpaid FROM balance JOIN invoices USING (invoice_id) WHERE balance_cents < 0 AND manual_status <> 'cancelled'),
o AS (SELECT CAST(coalesce(sum(balance_cents), 0) AS BIGINT) AS total_open, CAST(coalesce(sum(balance_cents) FILTER (due_date < DATE '{AS_OF}'), 0) AS BIGINT) AS overdue,
    {", ".join(f"CAST(coalesce(sum(balance_cents) FILTER (due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + {n}), 0) AS BIGINT) AS due_{n}" for n in (7, 14, 30))},
    count(*) FILTER (max_level >= 5) AS escalated, count(*) AS n_open FROM open_items LEFT JOIN worst USING (invoice_id))
SELECT total_open, overdue, due_7, due_14, due_30, paid_period, charges, overpaid, unassigned, overpaid + unassigned AS credits, escalated, n_open FROM o, p, u, c""")
def dashboard_figures(t: LedgerTables) -> DataFrame:
    """All key figures in one row."""
    return dashboard.key_figures(t.invoices, t.entries_by_invoice, t.unassigned, t.notices, AS_OF, START)


@query(f"""{LEDGER} SELECT s_name AS supplier, invoice_number, invoice_date, due_date, balance_cents, CAST(greatest(0, date_diff('day', due_date, DATE '{AS_OF}')) AS INTEGER) AS overdue_days, bucket
FROM open_items LEFT JOIN supplier ON s_suppkey = supplier_id""")
def open_items_report(t: LedgerTables) -> DataFrame:
    return reports.open_items_report(_items(t), t.parties, AS_OF)


@query(f"""{LEDGER}, x AS (SELECT invoice_id, supplier_id, CASE WHEN invoice_id % 5 <> 0 THEN due_date END AS due_date, balance_cents, CASE WHEN supplier_id % 2 = 0 THEN lower(s_name) ELSE s_name END AS supplier FROM open_items JOIN supplier ON s_suppkey = supplier_id)
SELECT invoice_id, supplier, CASE WHEN due_date IS NULL THEN '' ELSE strftime(due_date, '%d.%m.%Y') END AS due, balance_cents, CAST(row_number() OVER (PARTITION BY lower(supplier) ORDER BY due_date NULLS LAST, invoice_id) AS INTEGER) AS place FROM x""")
def open_items_in_order(t: LedgerTables) -> DataFrame:
    """Open items by supplier and due day, a fifth of them without one."""
    items = _items(t).select("invoice_id", "supplier_id", F.when(F.col("invoice_id") % 5 != 0, F.col("due_date")).alias("due_date"), "balance_cents")
    parties = t.parties.select("party_id", F.when(F.col("party_id") % 2 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"))
    return reports.open_items_in_order(items, parties).select("invoice_id", "supplier", format_day(F.col("due_date")).alias("due"), "balance_cents", "place")


@query(f"""{LEDGER} SELECT company_id, CAST(sum(balance_cents) AS BIGINT) AS balance_cents, count(*) AS n_items, grouping(company_id) > 0 AS is_total FROM open_items GROUP BY GROUPING SETS ((company_id), ())""")
def company_totals(t: LedgerTables) -> DataFrame:
    return reports.with_totals(_items(t), ["company_id"], "balance_cents")


@query(f"""{LEDGER},{NOTICES}, worst AS (SELECT invoice_id, max(level) AS level FROM notices GROUP BY 1)
SELECT CAST(k AS INTEGER) AS level, count(invoice_id) AS n_items, CAST(coalesce(sum(balance_cents), 0) AS BIGINT) AS open_cents
FROM (SELECT unnest(range(1, 7)) AS k) LEFT JOIN (SELECT * FROM worst JOIN open_items USING (invoice_id)) ON level = k GROUP BY k""")
def dunning_levels(t: LedgerTables) -> DataFrame:
    return N.level_histogram(_items(t), t.notices)


@query(f"""WITH {NOTICES} SELECT invoice_id, max(level) AS max_level, arg_max(new_deadline, (notice_date, notice_id)) AS next_deadline, max(new_deadline) AS last_deadline, count(*) AS n_notices
FROM notices GROUP BY invoice_id""")
def notice_levels(t: LedgerTables) -> DataFrame:
    return N.levels(t.notices)


@query(f"""WITH {NOTICES}, x AS (SELECT notice_id, invoice_id, fees_cents, coalesce(max(fees_cents) OVER (PARTITION BY invoice_id ORDER BY notice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS booked FROM notices),
y AS (SELECT notice_id, invoice_id, 'DUNNING_FEE' AS category, greatest(0, fees_cents - booked) AS posted_cents, CASE WHEN fees_cents > 0 AND fees_cents < booked THEN booked - fees_cents ELSE 0 END AS lower_cents FROM x)
SELECT * FROM y WHERE posted_cents > 0 OR lower_cents > 0""")
def notice_postings(t: LedgerTables) -> DataFrame:
    """What every notice adds to the ledger."""
    return N.plan_postings(t.notices)


def _claims(t: LedgerTables) -> DataFrame:
    gross = t.invoices.select("invoice_id", "gross_cents")
    computed = F.col("gross_cents") + F.col("fees_cents")
    stated = F.when(F.col("notice_id") % 3 == 0, computed + 100).otherwise(F.lit(0).cast("bigint"))
    return t.notices.join(gross, "invoice_id").select(
        "notice_id", "invoice_id", "notice_date", computed.alias("computed_cents"), stated.alias("total_cents"), F.lit(0).cast("bigint").alias("credited_cents")
    )


def _typed(t: LedgerTables) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return t.entries_by_invoice.withColumns({"entry_id": none, "entry_type": F.col("category"), "reverses_entry_id": none})


_CLAIMS = """, claims AS (SELECT notice_id, invoice_id, notice_date, gross_cents + fees_cents AS computed_cents, CASE WHEN notice_id % 3 = 0 THEN gross_cents + fees_cents + 100 ELSE 0 END AS total_cents
  FROM notices JOIN invoices USING (invoice_id)),
j AS (SELECT notice_id, c.invoice_id, notice_date, computed_cents, total_cents, CASE WHEN total_cents > 0 THEN total_cents ELSE computed_cents END AS claimed_cents,
    CAST(coalesce(sum(amount_cents) FILTER (entry_date <= notice_date), 0) AS BIGINT) AS expected_cents,
    CAST(coalesce(-sum(amount_cents) FILTER (category = 'PAYMENT' AND entry_date < notice_date), 0) AS BIGINT) AS paid_before_cents
  FROM claims c LEFT JOIN entries e ON e.invoice_id = c.invoice_id GROUP BY ALL),
k AS (SELECT *, claimed_cents - expected_cents AS difference_cents FROM j),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN total_cents > 0 AND total_cents <> computed_cents THEN 'SUM_MISMATCH' END, CASE WHEN difference_cents <> 0 THEN 'DIFF' END,
    CASE WHEN difference_cents > 0 AND paid_before_cents > 0 THEN 'PAYMENT_IGNORED' END], lambda x: x IS NOT NULL), ',') AS issues FROM k)"""


@query(f"""WITH {INVOICES},{ENTRIES},{NOTICES}{_CLAIMS} SELECT notice_id, invoice_id, claimed_cents, expected_cents, paid_before_cents, difference_cents, issues FROM r""")
def reconciliation(t: LedgerTables) -> DataFrame:
    """What every notice claims, against the ledger at its date."""
    return N.reconcile(_claims(t), _typed(t)).select("notice_id", "invoice_id", "claimed_cents", "expected_cents", "paid_before_cents", "difference_cents", "issues")


@query(f"""WITH {INVOICES},{ENTRIES},{NOTICES}{_CLAIMS} SELECT notice_id, notice_date, CAST(sum(claimed_cents) AS BIGINT) AS claimed_cents, CAST(sum(expected_cents) AS BIGINT) AS expected_cents,
  CAST(sum(difference_cents) AS BIGINT) AS difference_cents, count(*) FILTER (issues <> '') AS n_issues FROM r GROUP BY ALL""")
def dunning_overview(t: LedgerTables) -> DataFrame:
    return reports.dunning_overview(_claims(t), _typed(t))


@query(f"WITH {NOTICES} SELECT DISTINCT invoice_id FROM notices WHERE level >= 5")
def escalated(t: LedgerTables) -> DataFrame:
    return N.escalated(t.notices)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aging of open items."""
    return QUERIES["aging"](spark, sf_dir)


