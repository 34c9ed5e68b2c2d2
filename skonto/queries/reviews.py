"""Documents of every kind, printed from the ledger, analysed, stored as JSON, read again and proposed for review."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto.functions.money import format_cents
from skonto.operators import documents as DOC
from skonto.operators import labels, links, reviews, senders
from skonto.plans.inbox import scope_in_text
from skonto.queries.base import INVOICES, NOTICES
from skonto.sources.ledger_tables import LedgerTables
from skonto.sources.shared import spread, written

QUERIES, ORACLES = {}, {}
TODAY = date(2026, 1, 1)


def query(sql: str | None = None):
    """Register a function of the tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def letters(t: LedgerTables, invoices: DataFrame, parties: DataFrame) -> DataFrame:
    """(doc_id, text): for every notice a document about its invoice: invoice, credit note, two kinds of letters, payment, or something else."""
    rows = t.notices.join(invoices, "invoice_id").join(parties.select(F.col("party_id").alias("supplier_id"), F.col("name").alias("party")), "supplier_id")
    rows = rows.join(F.broadcast(t.hotels.select("hotel_id", F.col("name").alias("hotel"))), "hotel_id")
    say = lambda c: F.concat(format_cents(c, symbol=False), F.lit(" EUR\n"))
    day = lambda c: F.concat(F.date_format(c, "dd.MM.yyyy"), F.lit("\n"))
    gross, net = F.col("gross_cents"), F.round(F.col("gross_cents") / 1.19, 0).cast("bigint")
    fees, paid = F.lit(500).cast("bigint"), F.lit(100).cast("bigint")
    head = F.concat("party", F.lit(" GmbH\nWeg 1, 12345 Ort\n\n"), "hotel", F.lit("\nSeestraße 1\n23570 Ort\n\n"))
    fresh = F.concat(F.lit("NEU-"), F.lpad(F.col("notice_id").cast("string"), 9, "7"))
    claims = lambda title: (F.lit(f"{title}\n\nDatum: "), day("notice_date"), F.lit("Rechnungsnummer: "), "invoice_number", F.lit("\nHauptforderung: "), say(gross), F.lit("Mahngebühr: "), say(fees))
    ways = (
        F.concat(head, F.lit("Rechnung\n\nRechnungsnummer: "), fresh, F.lit("\nRechnungsdatum: "), day("notice_date"), F.lit("Nettobetrag: "), say(net), F.lit("Umsatzsteuer: "), say(gross - net), F.lit("Rechnungsbetrag: "), say(gross)),
        F.concat(head, F.lit("Gutschrift\n\nGutschriftsnummer: "), fresh, F.lit("\nGutschriftsdatum: "), day("notice_date"), F.lit("Wir erstatten aus "), "invoice_number", F.lit("\nGutschriftsbetrag: "), say(gross)),
        F.concat(head, *claims("1. Mahnung"), F.lit("Gesamtforderung: "), say(gross + fees), F.lit("Zahlungsfrist: "), day("new_deadline")),
        F.concat(head, *claims("Letzte Mahnung"), F.lit("Gesamtforderung: "), say(gross + fees), F.lit("Bereits gezahlt: "), say(paid), F.lit("Restforderung: "), say(gross + fees - paid)),
        F.concat(F.lit("Zahlungsbestätigung\n\nDatum: "), day("notice_date"), F.lit("Ausführungsdatum: "), day("notice_date"), F.lit("Überweisungsbetrag: "), say(gross), F.lit("Verwendungszweck: "), "invoice_number", F.lit("\n")),
        F.concat(head, F.lit("Einladung\n\nwir laden Sie herzlich zu unserem Fest ein.\n")),
    )
    return rows.select(F.col("notice_id").alias("doc_id"), F.element_at(F.array(*ways), (F.col("notice_id") % 6 + 1).cast("int")).alias("text"))


@query(f"""WITH {INVOICES}, {NOTICES},
x AS (SELECT notice_id AS doc_id, notice_id % 6 AS way, n.*, i.supplier_id, i.gross_cents, i.company_id, i.hotel_id, i.supplier_id % 10 = 9 AS agency FROM notices n JOIN invoices i USING (invoice_id))
SELECT doc_id, ['invoice', 'credit', 'notice', 'notice', 'payment', 'none'][way + 1] AS kind,
  CASE WHEN way = 4 THEN supplier_id WHEN agency THEN supplier_id - 1 ELSE supplier_id END AS supplier_id, CASE WHEN way <> 4 THEN supplier_id END AS sender_id,
  CASE WHEN way <> 4 THEN company_id END AS company_id, CASE WHEN way <> 4 THEN hotel_id END AS hotel_id,
  CASE WHEN way <> 5 THEN notice_date END AS document_date, CASE way WHEN 0 THEN notice_date + 30 WHEN 2 THEN notice_date + 14 END AS due_date,
  CASE WHEN way < 2 THEN gross_cents END AS gross_cents, CASE WHEN way IN (1, 2, 3) THEN invoice_id END AS invoice_id, CAST(CASE way WHEN 2 THEN 2 WHEN 3 THEN 4 END AS INTEGER) AS level,
  CASE way WHEN 2 THEN gross_cents WHEN 3 THEN gross_cents - 100 END AS principal_cents, CASE WHEN way IN (2, 3) THEN CAST(500 AS BIGINT) END AS fees_cents,
  CASE way WHEN 2 THEN gross_cents + 500 WHEN 3 THEN gross_cents + 400 ELSE 0 END AS total_claimed_cents, CAST(CASE way WHEN 3 THEN 100 ELSE 0 END AS BIGINT) AS credited_cents,
  CASE way WHEN 4 THEN gross_cents END AS payment_cents, CASE way WHEN 4 THEN invoice_id END AS paid_invoice_id,
  CASE way WHEN 0 THEN 'DUE_ASSUMED' ELSE '' END AS messages
FROM x""")
def review_proposals(t: LedgerTables) -> DataFrame:
    """What is proposed for a document of every kind; analysis and proposal go through JSON and come back."""
    invoices, parties = written(t.invoices, "invoices"), written(t.parties, "parties")
    docs = written(spread(letters(t, invoices, parties), "doc_id"), "letters")
    none = t.spark.createDataFrame([], "party_id long, alias string")
    no_ibans = t.spark.createDataFrame([], "party_id long, iban string")
    parties = parties.select("*", F.lit("").alias("vat_id"), F.lit("").alias("tax_number"), F.lit("").alias("email"))
    fields = written(DOC.analyse(docs, TODAY), "fields")
    contacts = written(senders.contacts(docs), "contacts")
    by = written(senders.senders(docs.join(fields.select("doc_id", "kind"), "doc_id"), parties, none, no_ibans, t.hotels.select("name"), known=contacts), "letter-senders")
    said = written(labels.references(docs), "letter-references")
    hints = fields.join(by.select("doc_id", "supplier_id"), "doc_id").select(
        "doc_id", "kind", "supplier_id", "invoice_number", "principal_cents", "gross_cents", F.col("payment_amount_cents").alias("payment_cents"), F.lit(None).cast("date").alias("referenced_date")
    )
    hints = written(hints, "hints")
    no_known = t.spark.createDataFrame([], "owner_kind string, owner_id long, normalized string")
    found = written(links.link_documents(docs, hints, said, invoices, no_known, t.spark.createDataFrame([], "case_id long, invoice_id long")), "links")
    analysed = reviews.analyses(docs, fields, contacts, by, parties, said, found, invoices)
    stored = written(analysed.select("doc_id", reviews.as_text(F.col("analysis")).alias("stored")), "analyses")
    again = stored.select("doc_id", reviews.from_text(F.col("stored"), reviews.ANALYSIS).alias("analysis"))
    proposed = reviews.proposals(again, scope_in_text(docs, t.hotels, t.companies))
    kept = written(proposed.select("doc_id", reviews.as_text(F.col("proposal")).alias("stored")), "proposals")
    p = kept.select("doc_id", reviews.from_text(F.col("stored"), reviews.PROPOSAL).alias("p"))
    claim = F.get("p.claims", F.lit(0))
    return p.select(
        "doc_id", *[F.col(f"p.{c}") for c in ("kind", "supplier_id", "sender_id", "company_id", "hotel_id", "document_date", "due_date", "gross_cents", "invoice_id", "level")], claim["principal_cents"].alias("principal_cents"),
        claim["fees_cents"].alias("fees_cents"), "p.total_claimed_cents", "p.credited_cents", "p.payment_cents", F.get("p.payment_invoice_ids", F.lit(0)).alias("paid_invoice_id"), F.array_join("p.messages", ",").alias("messages"),
    )
