"""Bank lines: fingerprints, the payment that is there already, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto.operators import bank as B
from skonto.operators import ledger as L
from skonto.queries.base import AS_OF, BANK, LEDGER
from skonto.sources.ledger_tables import LedgerTables
from skonto.sources.shared import written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function of the ledger's tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {BANK}, d AS (SELECT tx_id, sha1(account_id || '|' || booking_date || '|' || amount_cents || '||' || lower(counterparty_name) || '|' ||
    upper(regexp_replace(purpose, '[^0-9A-Za-z]', '', 'g'))) AS digest FROM bank)
SELECT tx_id, digest || '-' || (row_number() OVER (PARTITION BY digest ORDER BY tx_id) - 1) AS fingerprint FROM d""")
def bank_fingerprints(t: LedgerTables) -> DataFrame:
    return B.fingerprints(t.bank_lines, "tx_id").select("tx_id", "fingerprint")


@query(f"""WITH {BANK}, p AS (SELECT tx_id AS payment_id, amount_cents, booking_date AS payment_date FROM bank),
x AS (SELECT b.tx_id, arg_min(payment_id, (payment_date, payment_id)) AS payment_id FROM bank b JOIN p ON p.amount_cents = b.amount_cents AND payment_id <> b.tx_id AND abs(date_diff('day', payment_date, booking_date)) <= 5 GROUP BY 1)
SELECT * FROM x""")
def same_amount_nearby(t: LedgerTables) -> DataFrame:
    """For each line another of the same amount within five days: an interval join on equal amounts."""
    lines = t.bank_lines.select("tx_id", F.lit(0).alias("supplier_id"), "amount_cents", "booking_date")
    paid = t.bank_lines.select(F.col("tx_id").alias("payment_id"), F.col("tx_id").alias("own_tx_id"), F.lit(0).alias("supplier_id"), F.abs("amount_cents").alias("payment_cents"), F.col("booking_date").alias("payment_date"))
    return B.existing_payments(lines, paid)


@query()
def bank_matching(t: LedgerTables) -> DataFrame:
    """Suppliers of payments with a misspelt name and an invoice in their purpose: rows only, similarity has no SQL."""
    items = written(L.open_items(t.invoices, t.entries_by_invoice, AS_OF), "open-items")  # every kind of evidence reads them
    lines = items.select(
        F.col("invoice_id").alias("tx_id"), "supplier_id", F.lit("").alias("counterparty_iban"), F.concat(F.lit("Suplier "), F.lpad(F.col("supplier_id").cast("string"), 9, "0")).alias("counterparty_name"),
        F.concat(F.lit("Rechnung "), "invoice_number").alias("purpose"), F.lit("").alias("reference"), (-F.col("balance_cents")).alias("amount_cents"), F.lit(AS_OF).alias("booking_date"),
    )
    ibans = t.parties.select("party_id", F.lit("").alias("iban"))
    none = t.spark.createDataFrame([], "supplier_id long, iban string, payment_date date, payment_id long")
    mentions = written(B.number_mentions(lines, items), "mentions")
    found = B.match_suppliers(lines, t.parties.where(F.col("represents_id").isNull()), ibans, none, items, mentions=mentions)
    return found.select("tx_id", "supplier_id", F.round("score", 6).alias("score"), "ambiguous")


@query(f"""{LEDGER} SELECT invoice_id AS tx_id, supplier_id, invoice_id, 0.85::DOUBLE AS weight FROM open_items""")
def bank_mentions(t: LedgerTables) -> DataFrame:
    """Invoices whose number stands in the purpose of a line that pays them, among all open ones."""
    items = L.open_items(t.invoices, t.entries_by_invoice, AS_OF)
    lines = items.select(F.col("invoice_id").alias("tx_id"), F.concat(F.lit("Zahlung "), "invoice_number", F.lit(" vom Konto")).alias("purpose"), F.lit("").alias("reference"), F.lit("").alias("counterparty_name"))
    return B.number_mentions(lines, items)


@query(f"""{LEDGER}, l AS (SELECT supplier_id, balance_cents, count(*) AS n, min(invoice_id) AS invoice_id FROM open_items GROUP BY 1, 2)
SELECT supplier_id, balance_cents, invoice_id FROM l WHERE n = 1""")
def unique_amounts(t: LedgerTables) -> DataFrame:
    """Open amounts that only one invoice of a supplier has: what an amount alone can tell."""
    items = L.open_items(t.invoices, t.entries_by_invoice, AS_OF)
    return items.groupBy("supplier_id", "balance_cents").agg(F.count("*").alias("n"), F.min("invoice_id").alias("invoice_id")).where("n = 1").drop("n")


@query(f"""{LEDGER}, l AS (SELECT *, invoice_id % 4 AS way FROM open_items), once AS (SELECT supplier_id, balance_cents FROM open_items GROUP BY ALL HAVING count(*) = 1),
owner AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 ELSE s_suppkey END AS supplier_id FROM supplier),
e AS (SELECT invoice_id AS tx_id, o.supplier_id, 0.95 AS w FROM l JOIN owner o ON o.id = l.supplier_id WHERE way = 0
  UNION ALL SELECT invoice_id, supplier_id, 0.85 FROM l WHERE way = 1 AND supplier_id % 2 = 0
  UNION ALL SELECT invoice_id, supplier_id, 0.85 FROM l WHERE way = 2
  UNION ALL SELECT l.invoice_id, once.supplier_id, 0.3 FROM l JOIN once ON once.balance_cents = l.balance_cents)
SELECT tx_id, supplier_id, round(1 - exp(sum(ln(1 - w))), 6) AS score FROM e GROUP BY ALL""")
def bank_exact_evidence(t: LedgerTables) -> DataFrame:
    """Lines that pay open invoices, told by their supplier's IBAN, an IBAN that paid before, the invoice number, or the amount alone."""
    items = written(L.open_items(t.invoices, t.entries_by_invoice, AS_OF), "open-items")
    way = F.col("invoice_id") % 4
    iban = lambda kind, key: F.concat(F.lit(kind), F.lpad(key.cast("string"), 18, "0"))
    lines = items.select(
        F.col("invoice_id").alias("tx_id"), F.when(way == 0, iban("DE11", F.col("supplier_id"))).when(way == 1, iban("AT22", F.col("supplier_id"))).alias("counterparty_iban"), F.lit("").alias("counterparty_name"),
        F.when(way == 2, F.concat(F.lit("Rechnung "), "invoice_number")).otherwise("Zahlung").alias("purpose"), F.lit("").alias("reference"), (-F.col("balance_cents")).alias("amount_cents"),
    )
    ibans = t.parties.select("party_id", iban("DE11", F.col("party_id")).alias("iban"))
    # of two payments from an IBAN the earlier tells whose it is
    paid = F.array(*[F.struct((F.col("party_id") + k).alias("supplier_id"), F.lit(day).alias("payment_date"), (F.col("party_id") * 2 + k).alias("payment_id")) for k, day in ((0, "1998-01-01"), (1, "1998-02-01"))])
    payments = t.parties.where("party_id % 2 = 0").select(iban("AT22", F.col("party_id")).alias("iban"), F.inline(paid))
    evidence = B.exact_evidence(lines, t.parties, ibans, payments, items, B.number_mentions(lines, items))
    return B.noisy_or(evidence, "tx_id", "supplier_id").select("tx_id", "supplier_id", F.round("score", 6).alias("score"))
