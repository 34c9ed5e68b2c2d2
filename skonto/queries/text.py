"""Text functions, recognition and search."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto.functions import dates, money
from skonto.functions import text as X
from skonto.operators import documents as DOC
from skonto.operators import layouts as LAY
from skonto.operators import search as S
from skonto.queries.base import INVOICES, LEDGER, NOTICES
from skonto.sources.ledger_tables import LedgerTables
from skonto.sources.shared import spread

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function of the tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(r"""WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)
SELECT o_orderkey, ltrim(reverse(regexp_replace(reverse(CAST(v // 100 AS VARCHAR)), '(\d{3})', '\1.', 'g')), '.') || ',' || lpad(CAST(v % 100 AS VARCHAR), 2, '0') || ' €' AS shown, v AS parsed FROM c""")
def money_round_trip(t: LedgerTables) -> DataFrame:
    """Amounts written in the German way and read again."""
    v = F.round(F.col("o_totalprice") * 100).cast("bigint")
    shown = t.read("orders").select("o_orderkey", money.format_cents(v).alias("shown"))
    return shown.select("o_orderkey", "shown", money.parse_amount(F.col("shown")).alias("parsed"))


@query(f"""WITH {INVOICES} SELECT invoice_id, upper(regexp_replace(invoice_number, '[^0-9A-Za-z]', '', 'g')) AS number_norm,
  strftime(date_trunc('quarter', invoice_date), '%Y-%m-%d') AS quarter, CAST(least(last_day(CAST(date_trunc('month', invoice_date) + INTERVAL 1 MONTH AS DATE)), CAST(date_trunc('month', invoice_date) + INTERVAL 1 MONTH AS DATE) + 30) AS DATE) AS next_month_end
FROM invoices""")
def invoice_keys(t: LedgerTables) -> DataFrame:
    return t.invoices.select(
        "invoice_id", X.normalize_reference(F.col("invoice_number")).alias("number_norm"), dates.period_start(F.col("invoice_date"), "quarter").cast("string").alias("quarter"),
        dates.add_months(F.col("invoice_date"), F.lit(1), F.lit(31)).alias("next_month_end"),
    )


@query("""SELECT s_suppkey AS party_id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS name_norm FROM supplier""")
def party_names(t: LedgerTables) -> DataFrame:
    return t.parties.select("party_id", X.normalize_name(F.col("name")).alias("name_norm"))


@query()
def document_kinds(t: LedgerTables) -> DataFrame:
    """The kind of every document; patterns need look-behind, which the SQL engine lacks."""
    return DOC.classify(t.read("documents").select("doc_id", "text")).select("doc_id", "kind", "kind_confidence")


@query()
def document_fields(t: LedgerTables) -> DataFrame:
    """Fields and issues of every document."""
    return DOC.analyse(t.read("documents").select("doc_id", "text"), date(2026, 1, 1)).select("doc_id", "kind", "gross_cents", "document_date", "invoice_number", "iban", "issues", "confidence")


@query(f"""WITH {INVOICES}, a AS (SELECT *, round(gross_cents / 1.19)::BIGINT AS net FROM invoices)
SELECT invoice_id AS doc_id, net AS net_cents, gross_cents - net AS vat_cents, gross_cents, true AS amounts_agree, invoice_number, invoice_date AS document_date FROM a""")
def invoice_layouts(t: LedgerTables) -> DataFrame:
    """Every invoice printed in one of four layouts and read again: lines, header rows, labels and values by turns, blocks."""
    gross = F.col("gross_cents")
    net = F.round(gross / 1.19, 0).cast("bigint")
    shown = lambda c: money.format_cents(c, symbol=False)
    labels = ("Rechnungsnummer", "Rechnungsdatum", "Nettobetrag", "MwSt.", "Gesamtbetrag")
    values = (F.col("invoice_number"), F.date_format("invoice_date", "dd.MM.yyyy"), shown(net), shown(gross - net), shown(gross))
    lines = [F.concat(F.lit(label + ": "), v) for label, v in zip(labels, values)]
    table = lambda a, b: F.concat_ws("\n", F.lit("   ".join(labels[a:b])), F.concat_ws("   ", *values[a:b]))
    turns = [x for label, v in zip(labels, values) for x in (F.lit(label), v)]
    layouts = (F.concat_ws("\n", *lines), F.concat_ws("\n\n", table(0, 2), table(2, 5)), F.concat_ws("\n", *turns), F.concat_ws("\n", F.lit("Rechnung"), *map(F.lit, labels), *values))
    pick = F.coalesce(*[F.when(F.col("invoice_id") % len(layouts) == k, x) for k, x in enumerate(layouts)])
    rows = spread(t.invoices.select("invoice_id", "invoice_number", "invoice_date", "gross_cents"), "invoice_id")  # patterns are slow, and the orders of a small table are one task
    docs = rows.select(F.col("invoice_id").alias("doc_id"), F.concat(F.lit("Muster GmbH\n\n"), pick, F.lit("\nVielen Dank für Ihren Auftrag.")).alias("text"))
    docs = docs.select("doc_id", F.explode(F.array("text")).alias("text"))  # printed once
    return LAY.complete_fields(DOC.extract_fields(LAY.read_layouts(docs))).select("doc_id", "net_cents", "vat_cents", "gross_cents", "amounts_agree", "invoice_number", "document_date")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS token FROM documents),
h AS (SELECT doc_id, count(*) FILTER (starts_with(token, 'licen')) AS a, count(*) FILTER (starts_with(token, 'under')) AS b FROM w GROUP BY doc_id)
SELECT doc_id, a + b AS n_hits FROM h WHERE a > 0 AND b > 0""")
def fulltext_search(t: LedgerTables) -> DataFrame:
    """Documents with words that begin like those of a query."""
    return S.fulltext(S.inverted_index(t.read("documents"), query="Licen under"), "Licen under").select("doc_id", "n_hits")


_NUMBER = "contains(regexp_replace(invoice_number, '[^0-9A-Z]', '', 'g'), '000042')"
_SEARCH = f"""{LEDGER},{NOTICES},
cases AS (SELECT DISTINCT invoice_id AS case_id, invoice_id FROM notices WHERE level >= 4),
paid AS (SELECT invoice_id AS payment_id, gross_cents % 5000 AS amount_cents FROM invoices),
named_cases AS (SELECT case_id, invoice_id FROM cases WHERE contains(printf('%08d', case_id * 10), '000042')),
s AS (SELECT s_suppkey AS id, 'NAME' AS reason, 1 AS ord FROM supplier WHERE contains(lower(s_name), '000042')),
i0 AS (SELECT invoice_id AS id, 'NUMBER' AS reason, 4 AS ord FROM invoices WHERE {_NUMBER}
  UNION ALL SELECT invoice_id, 'REFERENCE', 5 FROM named_cases UNION ALL SELECT invoice_id, 'AMOUNT', 6 FROM invoices WHERE gross_cents = 4200
  UNION ALL SELECT i.invoice_id, 'PAYMENT', 7 FROM paid JOIN invoices i ON i.invoice_id IN (payment_id, payment_id + 1) WHERE amount_cents = 4200
  UNION ALL SELECT invoice_id, reason, ord + 10 FROM invoices JOIN s ON s.id = supplier_id),
i AS (SELECT id, arg_min(reason, ord) AS reason, min(ord) AS ord FROM i0 GROUP BY id),
c0 AS (SELECT case_id AS id, 'REFERENCE' AS reason, 5 AS ord FROM named_cases UNION ALL SELECT case_id, reason, ord + 10 FROM cases JOIN i ON i.id = invoice_id),
c AS (SELECT id, arg_min(reason, ord) AS reason, min(ord) AS ord FROM c0 GROUP BY id),
d AS (SELECT doc_id AS id, 'REFERENCE' AS reason, 5 AS ord FROM documents WHERE contains(printf('%08d', doc_id * 10), '000042')),
hits AS (SELECT 'supplier' AS kind, * FROM s UNION ALL SELECT 'invoice', * FROM i UNION ALL SELECT 'case', * FROM c UNION ALL SELECT 'document', * FROM d)"""


def _search(t: LedgerTables, per_kind: int | None) -> DataFrame:
    """A number looked up everywhere; cases and documents have a reference made of their id, each invoice a payment that also pays the next."""
    payments = t.invoices.select(F.col("invoice_id").alias("payment_id"), (F.col("gross_cents") % 5000).alias("amount_cents"))
    pays = t.invoices.select(F.col("invoice_id").alias("payment_id"), F.explode(F.array("invoice_id", F.col("invoice_id") + 1)).alias("invoice_id")).join(t.invoices.select("invoice_id"), "invoice_id", "left_semi")
    refers = lambda df, key, kind: df.select(F.lit(kind).alias("owner_kind"), F.col(key).alias("owner_id"), F.format_string("Az. %08d", (F.col(key) * 10).cast("long")).alias("value"))
    references = refers(t.cases, "case_id", "case").unionByName(refers(t.read("documents"), "doc_id", "document"))
    return S.everything("000042", t.parties, t.invoices, payments, pays, references, t.cases, per_kind=per_kind)


@query(f"{_SEARCH} SELECT kind, id, reason FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord, id) AS n FROM hits) WHERE n <= 50")
def global_search(t: LedgerTables) -> DataFrame:
    """The fifty first hits of each kind."""
    return _search(t, 50)


@query(f"""{_SEARCH}, its AS (SELECT * FROM invoices WHERE company_id = 2)
SELECT kind, id, reason FROM hits WHERE CASE kind WHEN 'invoice' THEN id IN (SELECT invoice_id FROM its) WHEN 'case' THEN id IN (SELECT invoice_id FROM its)
  WHEN 'supplier' THEN id IN (SELECT supplier_id FROM its) ELSE id % 3 = 0 OR id % 5 = 2 END""")
def search_of_company(t: LedgerTables) -> DataFrame:
    """All hits that belong to a company; each third document is nobody's, the others belong to companies by turns."""
    place = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5)
    documents = t.read("documents").select("doc_id", place.alias("company_id"), F.lit(None).cast("bigint").alias("hotel_id"))
    return S.search_in_scope(_search(t, None), t.invoices, t.cases, documents, company_id=2)
