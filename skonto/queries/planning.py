"""Allocation, interest, recurring invoices and planners."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.operators import allocation as A
from skonto.operators import interest as I
from skonto.operators import planners as P
from skonto.operators import recurring as R
from skonto.queries.base import AS_OF, ENTRIES, INVOICES, NOTICES
from skonto.sources.ledger_tables import EARLY_RATES, LedgerTables
from skonto.sources.shared import written

QUERIES, ORACLES = {}, {}
UNTIL = date(1999, 12, 31)


def query(sql: str | None = None):
    """Register a function of the ledger's tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _items(t: LedgerTables) -> DataFrame:
    """Open components of all invoices as if nothing was paid: costs a hundredth, interest a two-hundredth of the amount."""
    g = F.col("gross_cents")
    return t.invoices.select(
        "supplier_id", "invoice_id", "due_date", "invoice_date", (g - g % 100).cast("bigint").alias("open_principal_cents"), F.floor(g / 100).cast("bigint").alias("open_costs_cents"), F.floor(g / 200).cast("bigint").alias("open_interest_cents")
    )


def _payments(t: LedgerTables) -> DataFrame:
    """One payment for each supplier, a third of what it is owed."""
    return _items(t).groupBy("supplier_id").agg(F.floor(F.sum("open_principal_cents") / 3).cast("bigint").alias("payment_cents")).select(F.col("supplier_id").alias("payment_id"), "supplier_id", "payment_cents")


_ITEMS = """
items AS (SELECT supplier_id, invoice_id, due_date, invoice_date, gross_cents - gross_cents % 100 AS p, gross_cents // 100 AS c, gross_cents // 200 AS i FROM invoices),
pay AS (SELECT supplier_id AS payment_id, supplier_id, CAST(sum(p) // 3 AS BIGINT) AS payment_cents FROM items GROUP BY supplier_id),
parts AS (SELECT supplier_id, invoice_id, due_date, invoice_date, 'costs' AS component, 0 AS stage, c AS part FROM items WHERE c > 0
  UNION ALL SELECT supplier_id, invoice_id, due_date, invoice_date, 'interest', 1, i FROM items WHERE i > 0
  UNION ALL SELECT supplier_id, invoice_id, due_date, invoice_date, 'principal', 2, p FROM items WHERE p > 0)"""


def _waterfall(order: str) -> str:
    return f"""WITH {INVOICES},{_ITEMS}, x AS (SELECT payment_id, invoice_id, component, part, payment_cents,
  sum(part) OVER (PARTITION BY payment_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) - part AS before FROM pay JOIN parts USING (supplier_id))
SELECT payment_id, invoice_id, component, CAST(greatest(0, least(part, payment_cents - before)) AS BIGINT) AS allocated_cents FROM x WHERE least(part, payment_cents - before) > 0"""


@query(_waterfall("stage, due_date, invoice_date, invoice_id"))
def allocation_statutory(t: LedgerTables) -> DataFrame:
    return A.allocate(_payments(t), _items(t))


@query(_waterfall("due_date, invoice_date, invoice_id, stage"))
def allocation_oldest_first(t: LedgerTables) -> DataFrame:
    return A.allocate(_payments(t), _items(t), "oldest_first")


@query(f"""WITH {INVOICES}, r AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{d}', {bp})" for d, bp in EARLY_RATES)}) v(valid_from, rate_bp)),
v AS (SELECT CASE WHEN row_number() OVER (ORDER BY valid_from) = 1 THEN DATE '0001-01-01' ELSE valid_from END AS a, lead(valid_from, 1, DATE '9999-12-31') OVER (ORDER BY valid_from) AS b, rate_bp FROM r)
SELECT invoice_id, invoice_date, rate_bp FROM invoices JOIN v ON invoice_date >= a AND invoice_date < b""")
def rate_as_of(t: LedgerTables) -> DataFrame:
    """The base rate on the day of each invoice."""
    return I.with_rate(t.invoices, "invoice_date", t.rates).select("invoice_id", "invoice_date", "rate_bp")


def _paid(t: LedgerTables) -> DataFrame:
    e = t.entries_by_invoice.where("category = 'PAYMENT'")
    return e.select(F.col("invoice_id").alias("claim_id"), F.col("entry_date").alias("payment_date"), (-F.col("amount_cents")).alias("paid_cents"))


def _all_claims(t: LedgerTables) -> DataFrame:
    return t.amounts_due.select(F.col("invoice_id").alias("claim_id"), F.col("gross_cents").alias("principal_cents"), "due_date", F.lit(UNTIL).alias("until")).where("due_date < until")


@query(f"""WITH {INVOICES},{ENTRIES}, r AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{d}', {bp})" for d, bp in EARLY_RATES)}) v(valid_from, rate_bp)),
v AS (SELECT CASE WHEN row_number() OVER (ORDER BY valid_from) = 1 THEN DATE '0001-01-01' ELSE valid_from END AS a, lead(valid_from, 1, DATE '9999-12-31') OVER (ORDER BY valid_from) AS b, rate_bp FROM r),
c AS (SELECT invoice_id AS claim_id, gross_cents AS principal, due_date, DATE '{UNTIL}' AS until FROM invoices WHERE due_date < DATE '{UNTIL}'),
p AS (SELECT claim_id, greatest(entry_date, due_date) + 1 AS day, -amount_cents AS paid FROM c JOIN entries ON invoice_id = claim_id WHERE category = 'PAYMENT'),
points AS (SELECT claim_id, day, sum(paid) AS paid FROM (SELECT claim_id, due_date + 1 AS day, 0 AS paid FROM c UNION ALL SELECT * FROM p UNION ALL SELECT claim_id, valid_from, 0 FROM c, r WHERE valid_from > due_date)
  WHERE day <= DATE '{UNTIL}' GROUP BY ALL),
seg AS (SELECT claim_id, day, coalesce(lead(day) OVER w, DATE '{UNTIL}' + 1) AS till, sum(paid) OVER (PARTITION BY claim_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS paid FROM points WINDOW w AS (PARTITION BY claim_id ORDER BY day)),
s AS (SELECT claim_id, sum(greatest(0, principal - paid) * (rate_bp + 900) * date_diff('day', day, till)) AS n FROM seg JOIN c USING (claim_id) JOIN v ON day >= a AND day < b GROUP BY claim_id)
SELECT claim_id, CAST((2 * coalesce(n, 0) + 3650000) // 7300000 AS BIGINT) AS interest_cents FROM c LEFT JOIN s USING (claim_id)""")
def late_interest(t: LedgerTables) -> DataFrame:
    """Interest of every invoice up to a day, exact to the cent."""
    claims = _all_claims(t)
    return I.interest_totals(claims, I.interest_segments(claims, _paid(t), t.rates, 900))


def _templates(t: LedgerTables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.read("supplier").select(
        k.alias("recurring_id"), k.alias("supplier_id"), F.concat(F.lit("Miete "), "s_name").alias("title"),
        F.element_at(F.array(*map(F.lit, ("monthly", "quarterly", "half_yearly", "yearly"))), (k % 4 + 1).cast("int")).alias("period"), (1 + k % 31).cast("int").alias("day_of_month"),
        F.date_add(F.lit(date(1998, 1, 1)), (k % 200).cast("int")).alias("start_date"), F.when(k % 5 == 0, F.lit(date(1999, 6, 30))).alias("end_date"), F.lit(14).alias("due_days"), F.lit(True).alias("active"),
    )


def _amounts(t: LedgerTables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = F.array(F.struct(F.lit(date(1998, 3, 1)).alias("valid_from"), (100_00 + k).cast("bigint").alias("gross_cents")), F.struct(F.lit(date(1999, 1, 1)).alias("valid_from"), (110_00 + k).cast("bigint").alias("gross_cents")))
    return t.read("supplier").select(k.alias("recurring_id"), F.inline(rows))


@query(f"""WITH t AS (SELECT s_suppkey AS k, [1, 3, 6, 12][s_suppkey % 4 + 1] AS step, 1 + s_suppkey % 31 AS day, DATE '1998-01-01' + CAST(s_suppkey % 200 AS INTEGER) AS a,
    CASE WHEN s_suppkey % 5 = 0 THEN DATE '1999-06-30' ELSE DATE '{UNTIL}' END AS b FROM supplier),
m AS (SELECT k, a, b, day, step, CAST(date_trunc('month', a) + to_months(CAST(i * step AS INTEGER)) AS DATE) AS m FROM t, (SELECT unnest(range(0, 30)) AS i)),
o AS (SELECT k, step, least(CAST(last_day(m) AS DATE), m + CAST(day - 1 AS INTEGER)) AS occurrence FROM m WHERE least(CAST(last_day(m) AS DATE), m + CAST(day - 1 AS INTEGER)) BETWEEN a AND b)
SELECT k AS recurring_id, occurrence, 'MIETE-' || CASE step WHEN 1 THEN strftime(occurrence, '%Y-%m') WHEN 3 THEN year(occurrence) || '-Q' || quarter(occurrence)
  WHEN 6 THEN year(occurrence) || '-H' || CASE WHEN month(occurrence) <= 6 THEN 1 ELSE 2 END ELSE CAST(year(occurrence) AS VARCHAR) END AS invoice_number,
  CASE WHEN occurrence >= DATE '1999-01-01' THEN 11000 + k WHEN occurrence >= DATE '1998-03-01' THEN 10000 + k END AS gross_cents FROM o""")
def recurring_due(t: LedgerTables) -> DataFrame:
    """Occurrences of every template with number and amount."""
    rows = R.with_amount(R.occurrences(_templates(t), UNTIL), _amounts(t))
    return rows.select("recurring_id", "occurrence", R.number_for(F.col("title"), F.col("period"), F.col("occurrence")).alias("invoice_number"), "gross_cents")


@query(f"""WITH {INVOICES},{_ITEMS}, x AS (SELECT payment_id, invoice_id, part, payment_cents, sum(part) OVER (PARTITION BY payment_id ORDER BY stage, due_date, invoice_date, invoice_id ROWS UNBOUNDED PRECEDING) - part AS before
  FROM pay JOIN parts USING (supplier_id)), y AS (SELECT payment_id, invoice_id, payment_cents, least(part, payment_cents - before) AS a FROM x WHERE least(part, payment_cents - before) > 0)
SELECT payment_id, invoice_id, CAST(-sum(a) AS BIGINT) AS amount_cents FROM y GROUP BY ALL
UNION ALL SELECT payment_id, NULL, CAST(coalesce(sum(a), 0) - any_value(pay.payment_cents) AS BIGINT) FROM pay LEFT JOIN y USING (payment_id) GROUP BY payment_id HAVING coalesce(sum(a), 0) < any_value(pay.payment_cents)""")
def payment_entries(t: LedgerTables) -> DataFrame:
    """Entries that payments become."""
    paid = _payments(t).withColumn("payment_date", F.lit(AS_OF))
    return P.record_payments(paid, _items(t))[1].select("payment_id", "invoice_id", "amount_cents")


@query(f"""WITH {INVOICES},{ENTRIES}, e AS (SELECT * FROM entries WHERE invoice_id % 97 = 0), paid AS (SELECT DISTINCT invoice_id FROM e WHERE category = 'PAYMENT')
SELECT e.invoice_id, category, CAST(-sum(amount_cents) AS BIGINT) AS amount_cents, CASE WHEN paid.invoice_id IS NULL THEN NULL ELSE 'HAS_PAYMENTS' END AS error FROM e LEFT JOIN paid USING (invoice_id) GROUP BY ALL""")
def cancellations(t: LedgerTables) -> DataFrame:
    """Reversals of cancelled invoices, by category."""
    none = F.lit(None).cast("bigint")
    e = t.entries.withColumns({"entry_id": F.xxhash64("invoice_id", "entry_date", "category", "amount_cents", "part", "line"), "entry_type": F.col("category"), "payment_id": none, "reverses_entry_id": none})
    ids = t.invoices.where("manual_status = 'cancelled'").select("invoice_id")
    return P.cancel_invoices(ids, e, AS_OF).groupBy("invoice_id", "category", "error").agg(F.sum("amount_cents").alias("amount_cents"))


_LETTERS = "letters AS (SELECT notice_id, invoice_id, notice_date, fees_cents // 2 AS interest_cents, CASE WHEN notice_id % 3 = 0 THEN 4000 + notice_id % 2 ELSE 0 END AS flat_fee_cents FROM notices)"


@query(f"""WITH {INVOICES},{ENTRIES},{NOTICES},{_LETTERS}, r AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{d}', {bp})" for d, bp in EARLY_RATES)}) v(valid_from, rate_bp)),
v AS (SELECT CASE WHEN row_number() OVER (ORDER BY valid_from) = 1 THEN DATE '0001-01-01' ELSE valid_from END AS a, lead(valid_from, 1, DATE '9999-12-31') OVER (ORDER BY valid_from) AS b, rate_bp FROM r),
c AS (SELECT notice_id AS claim_id, l.invoice_id, gross_cents AS principal, due_date, notice_date AS until FROM letters l JOIN invoices USING (invoice_id) WHERE due_date < notice_date),
p AS (SELECT claim_id, greatest(entry_date, due_date) + 1 AS day, -amount_cents AS paid FROM c JOIN entries ON entries.invoice_id = c.invoice_id WHERE category = 'PAYMENT'),
points AS (SELECT claim_id, day, sum(paid) AS paid FROM (SELECT claim_id, due_date + 1 AS day, 0 AS paid FROM c UNION ALL SELECT * FROM p UNION ALL SELECT claim_id, valid_from, 0 FROM c, r WHERE valid_from > due_date)
  JOIN (SELECT claim_id, until FROM c) USING (claim_id) WHERE day <= until GROUP BY ALL),
seg AS (SELECT claim_id, until, principal, day, coalesce(lead(day) OVER w, until + 1) AS till, sum(paid) OVER (PARTITION BY claim_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS paid FROM points JOIN c USING (claim_id) WINDOW w AS (PARTITION BY claim_id ORDER BY day)),
s AS (SELECT claim_id, sum(greatest(0, principal - paid) * (rate_bp + 900) * date_diff('day', day, till)) AS n FROM seg JOIN v ON day >= a AND day < b GROUP BY claim_id),
due AS (SELECT l.*, CAST((2 * coalesce(n, 0) + 3650000) // 7300000 AS BIGINT) AS calculated FROM letters l LEFT JOIN s ON claim_id = notice_id)
SELECT notice_id, invoice_id, 'INTEREST' AS what, CAST(interest_cents AS BIGINT) AS claimed_cents, calculated AS calculated_cents, CAST(interest_cents - calculated AS BIGINT) AS difference_cents FROM due WHERE interest_cents > 0 OR calculated > 0
UNION ALL SELECT notice_id, invoice_id, 'FLAT_FEE', CAST(flat_fee_cents AS BIGINT), 4000, CAST(flat_fee_cents - 4000 AS BIGINT) FROM due WHERE flat_fee_cents > 0""")
def claimed_interest(t: LedgerTables) -> DataFrame:
    """Interest and flat fees that letters claim, beside what is due at their dates."""
    half, fee = F.floor(F.col("fees_cents") / 2).cast("bigint"), F.when(F.col("notice_id") % 3 == 0, 4000 + F.col("notice_id") % 2).otherwise(0)
    letters = t.notices.select("notice_id", "invoice_id", "notice_date", half.alias("interest_cents"), fee.alias("flat_fee_cents"))
    # an invoice's segments run up to its last letter and are made once for all of its letters
    last = letters.groupBy(F.col("invoice_id").alias("claim_id")).agg(F.max("notice_date").alias("until"))
    last = written(last, "last-letters")
    claims = t.amounts_due.select(F.col("invoice_id").alias("claim_id"), F.col("gross_cents").alias("principal_cents"), "due_date").join(last, "claim_id").where("due_date < until")
    paid = _paid(t).join(last.select("claim_id"), "claim_id", "left_semi")
    return I.compare_claims(letters, I.interest_segments(claims, paid, t.rates, 900), D.FLAT_FEE_CENTS)


@query(f"""WITH t AS (SELECT s_suppkey AS k, DATE '1998-01-01' + CAST(s_suppkey % 200 AS INTEGER) AS a, 1 + s_suppkey % 31 AS day, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1999-06-30' ELSE DATE '{UNTIL}' END AS b FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 7 <> 0),
m AS (SELECT k, a, b, day, CAST(date_trunc('month', a) + to_months(CAST(i AS INTEGER)) AS DATE) AS m FROM t, (SELECT unnest(range(0, 30)) AS i)),
o AS (SELECT k, least(CAST(last_day(m) AS DATE), m + CAST(day - 1 AS INTEGER)) AS occurrence FROM m WHERE least(CAST(last_day(m) AS DATE), m + CAST(day - 1 AS INTEGER)) BETWEEN a AND b)
SELECT k AS recurring_id, 'MIETE-' || strftime(occurrence, '%Y-%m') AS invoice_number, occurrence + 14 AS due_date, CASE WHEN occurrence >= DATE '1999-01-01' THEN 11000 + k WHEN occurrence >= DATE '1998-03-01' THEN 10000 + k END AS gross_cents,
  CASE WHEN occurrence < DATE '1998-03-01' THEN 'NO_AMOUNT' WHEN month(occurrence) = 5 THEN 'ADOPTED' ELSE 'CREATE' END AS action
FROM o WHERE month(occurrence) % 3 <> 0""")
def recurring_to_create(t: LedgerTables) -> DataFrame:
    """What monthly templates still have to generate: every third month was, and each May's invoice is there already."""
    templates = _templates(t).where("period = 'monthly'").withColumn("active", F.col("recurring_id") % 7 != 0)
    every = R.occurrences(templates, UNTIL)
    runs = every.where(F.month("occurrence") % 3 == 0).select("recurring_id", "occurrence")
    there = every.where(F.month("occurrence") == 5).select("supplier_id", R.number_for(F.col("title"), F.col("period"), F.col("occurrence")).alias("invoice_number"), (F.col("recurring_id") * 100 + F.year("occurrence")).alias("invoice_id"))
    return R.due_invoices(templates, _amounts(t), runs, there, UNTIL).select("recurring_id", "invoice_number", "due_date", "gross_cents", "action")
