"""Text functions, bank files, matching, documents, search, streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skonto.functions import dates, money
from skonto.functions import text as X
from skonto.operators import bank, documents, labels, search
from skonto.sources import bank_files, files
from skonto.streaming import ingest


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[1] for r in sorted(df.select("k", f(F.col("v"))).collect())]


def test_names_and_numbers(spark):
    assert apply(spark, X.normalize_reference, ["RE-2024/001", "äß 1", None, ""]) == ["RE2024001", "AESS1", None, ""]
    assert apply(spark, X.normalize_name, ["Müller & Söhne GmbH", "ACME Ltd."]) == ["mueller soehne", "acme"]
    assert apply(spark, X.valid_iban, ["DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "x"]) == [True, False, False]
    assert apply(spark, X.find_iban, ["an DE89 3704 0044 0532 0130 00 Miete", "nichts"]) == ["DE89370400440532013000", ""]
    assert apply(spark, X.valid_vat_id, ["DE123456789", "DE12", "ATU1234567"]) == [True, False, True]
    assert apply(spark, X.registrable, ["mail.firma.de", "a.b.co.uk"]) == ["firma.de", "b.co.uk"]


def test_money(spark):
    assert apply(spark, money.parse_amount, ["1.234,56", "1,234.56", "1234,5", "12 €", "5,00-", "1.234", "12.5", "abc", "0,005", None]) == [123456, 123456, 123450, 1200, -500, 123400, 1250, None, 1, None]
    assert apply(spark, money.parse_cents, ["-1.234,56", "1234.56", "1.234,56-", "12,00 S", "12,00 H", "", "1,239"]) == [-123456, 123456, -123456, -1200, 1200, None, None]
    assert apply(spark, money.format_cents, [123456, -5, 0, 100_000_000], "long") == ["1.234,56 €", "-0,05 €", "0,00 €", "1.000.000,00 €"]
    df = spark.createDataFrame([(None, "19", 11900), (10000, "19", None), (10000, "19", 11000)], "n long, r string, g long")
    got = [tuple(r[0]) for r in df.select(money.compute_amounts(F.col("n"), F.col("r").cast("decimal(9,4)"), F.col("g"))).collect()]
    assert got == [(10000, 1900, 11900, None), (10000, 1900, 11900, None), (10000, 1000, 11000, "NET_VAT_GROSS")]


def test_dates(spark):
    assert apply(spark, dates.parse_any_date, ["15.03.2024", "2024-03-15", "15 March 2024", "March 15, 2024", "1. März 2024", "03/15/24", "31.02.2024", "x"]) == [date(2024, 3, 15)] * 4 + [date(2024, 3, 1), date(2024, 3, 15), None, None]
    assert apply(spark, dates.parse_day, ["am 1.2.24 gebucht", "2024-01-05", "99.99.2024", None]) == [date(2024, 2, 1), date(2024, 1, 5), None, None]


CSV = """"Konto";"DE89370400440532013000"
"Buchungstag";"Valuta";"Beguenstigter/Zahlungspflichtiger";"Verwendungszweck";"Kontonummer/IBAN";"Betrag";"Waehrung"
"15.03.2024";"16.03.2024";"Muster; GmbH";"Rechnung  RE-2024/001";"DE89370400440532013000";"-1.190,00";"EUR"
"";"";"";"";"";"5,00";"EUR"
"18.03.24";"";"Kunde";"Gutschrift";"";"250,00";""
"""
MT940 = """:20:X
:25:DE89370400440532013000
:60F:C240301EUR1000,00
:61:2403150316D119,50NMSCNONREF//X
:86:166?00UEBERWEISUNG?20SVWZ+Rechnung RE-2024/001?31DE89370400440532013000?32Muster GmbH
:61:240318RD20,NMSCABC
:86:frei
"""
PRINTED = """Kontoauszug 2024
15.03. 16.03. Muster GmbH Rechnung 1.190,00-
RE-2024/001
Seite 1

18.03.2024 Eingang 250,00+
"""


def statement(spark, text, name="a.csv"):
    return spark.createDataFrame([(name, text)], "path string, content string")


def test_statement_formats(spark):
    csv = bank_files.parse_csv(statement(spark, CSV)).orderBy("line_no").collect()
    assert [(r.booking_date, r.amount_cents, r.counterparty_name, r.purpose) for r in csv] == [(date(2024, 3, 15), -119_000, "Muster; GmbH", "Rechnung RE-2024/001"), (date(2024, 3, 18), 25_000, "Kunde", "Gutschrift")]
    assert csv[0].counterparty_iban == "DE89370400440532013000" and csv[1].currency == "EUR"
    mt = bank_files.parse_mt940(statement(spark, MT940)).orderBy("line_no").collect()
    assert [(r.booking_date, r.value_date, r.amount_cents, r.counterparty_name, r.purpose, r.reference) for r in mt] == [
        (date(2024, 3, 16), date(2024, 3, 15), -11_950, "Muster GmbH", "Rechnung RE-2024/001", ""), (date(2024, 3, 18), date(2024, 3, 18), 2_000, "", "frei", "ABC"),
    ]
    pdf = bank_files.parse_printed(statement(spark, PRINTED)).orderBy("line_no").collect()
    assert [(r.booking_date, r.amount_cents, r.purpose) for r in pdf] == [(date(2024, 3, 15), -119_000, "Muster GmbH Rechnung RE-2024/001"), (date(2024, 3, 18), 25_000, "Eingang")]
    kinds = statement(spark, MT940, "x.txt").select(bank_files.looks_like_bank_file(F.col("path"), F.col("content"))).first()[0]
    assert kinds == "mt940"
    assert bank_files.parse_csv(statement(spark, "kein;Kopf\n1;2")).count() == 0


def test_camt(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt><Acct><Id><IBAN>DE89370400440532013000</IBAN></Id></Acct>'
        '<Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">10000.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>'
        '<Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">8810.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>'
        '<Ntry><Amt Ccy="EUR">1190.00</Amt><CdtDbtInd>DBIT</CdtDbtInd><BookgDt><Dt>2024-03-15</Dt></BookgDt><ValDt><Dt>2024-03-16</Dt></ValDt><NtryDtls><TxDtls>'
        "<Refs><EndToEndId>NOTPROVIDED</EndToEndId></Refs><RltdPties><Cdtr><Nm>Muster GmbH</Nm></Cdtr></RltdPties><RmtInf><Ustrd>Rechnung 1</Ustrd></RmtInf></TxDtls></NtryDtls></Ntry></Stmt></BkToCstmrStmt></Document>"
    )
    s = bank_files.read_camt053(spark, str(tmp_path / "a.xml"))
    r = bank_files.camt_transactions(s).first()
    assert (r.booking_date, r.amount_cents, r.counterparty_name, r.purpose, r.reference) == (date(2024, 3, 15), -119_000, "Muster GmbH", "Rechnung 1", "")
    assert tuple(bank_files.camt_balances(s).first())[1:] == ("DE89370400440532013000", 1_000_000, 881_000)


def test_fingerprints_and_overlap(spark):
    lines = spark.createDataFrame([(k, 1, date(2024, 1, 1), -500, "A", "x", "f1") for k in (1, 2)] + [(3, 1, date(2024, 1, 2), -500, "A", "x", "f1")], "tx_id long, account_id long, booking_date date, amount_cents long, counterparty_name string, purpose string, path string")
    first = bank.fingerprints(lines, "tx_id")
    assert first.select("fingerprint").distinct().count() == 3
    again = bank.fingerprints(lines.withColumn("path", F.lit("f2")).unionByName(lines.limit(1).withColumns({"tx_id": F.lit(9).cast("long"), "purpose": F.lit("new"), "path": F.lit("f2")})), "tx_id")
    assert [r.tx_id for r in bank.new_lines(again, first).collect()] == [9]


def test_matching(spark):
    parties = spark.createDataFrame([(1, "Muster Gebäudereinigung GmbH", "supplier", None), (2, "Nordlicht Energie AG", "supplier", None), (3, "Eilig Inkasso", "collection_agency", 1)], "party_id long, name string, role string, represents_id long")
    items = spark.createDataFrame([(1, 11, "RE-2024/001", date(2024, 1, 1), None, 119_000), (1, 12, "RE-2024/002", date(2024, 1, 2), None, 5_000), (1, 13, "RE-2024/003", date(2024, 1, 3), None, 7_000), (2, 21, "77", date(2024, 1, 1), None, 4_000)], "supplier_id long, invoice_id long, invoice_number string, invoice_date date, due_date date, balance_cents long")
    lines = spark.createDataFrame([(1, "", "Muster Gebaudereinigung", "RE 2024 001", "", -119_000, date(2024, 2, 1)), (2, "", "Nordlicht Energie", "", "", -4_000, date(2024, 2, 1)), (3, "", "Muster Gebäudereinigung", "Sammel", "", -12_000, date(2024, 2, 1)), (4, "", "Unbekannt", "", "", 900, date(2024, 2, 1))], "tx_id long, counterparty_iban string, counterparty_name string, purpose string, reference string, amount_cents long, booking_date date")
    none = spark.createDataFrame([], "party_id long, iban string"), spark.createDataFrame([], "supplier_id long, iban string, payment_date date, payment_id long")
    found = bank.match_suppliers(lines, parties, none[0], none[1], items)
    assert {r.tx_id: r.supplier_id for r in found.collect()} == {1: 1, 2: 2, 3: 1}
    proposed = bank.propose_invoices(found, lines, items)
    assert {r.tx_id: (r.invoice_ids, r.exact, r.how) for r in proposed.collect()} == {1: ([11], True, "MENTIONED"), 2: ([21], True, "AMOUNT"), 3: ([12, 13], True, "SUM")}
    decided = bank.decide(lines, found, proposed, spark.createDataFrame([], "iban string"), spark.createDataFrame([], "tx_id long, payment_id long"))
    assert {r.tx_id: r.status for r in decided.collect()} == {1: "matched", 2: "matched", 3: "matched", 4: "ignored"}
    assert bank.subset_sum([5, 7, 9, 3], 12) == [0, 1] and bank.subset_sum([5], 5) is None


def test_mentions_are_whole_numbers(spark):
    """A number that begins or ends another one is not meant; blanks, marks and letters end a number."""
    numbers = ["RE-1996/123456", "RE-1996/1234567", "55001", "5500"]
    items = spark.createDataFrame([(7, k, n) for k, n in enumerate(numbers)], "supplier_id long, invoice_id long, invoice_number string")
    said = {1: "Zahlung RE-1996/1234567 vom Konto", 2: "RE 1996 123456 7 EUR", 3: "RE-1996/123456, Nr. 955001", 4: "RE1996123456vom", 5: "Nr.55001–2", 6: "X55001 5500", 7: ""}
    lines = spark.createDataFrame([(k, p, "", "") for k, p in said.items()], "tx_id long, purpose string, reference string, counterparty_name string")
    got = {(r.tx_id, r.invoice_id) for r in bank.number_mentions(lines, items).collect()}
    assert got == {(1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (5, 2), (6, 2), (6, 3)}


INVOICE = "Muster GmbH\n\nRechnung Nr. RE-2024/001\nRechnungsdatum: 15.03.2024\nKundennummer: K-4711\nNettobetrag 1.000,00 EUR\nzzgl. 19 % MwSt. 190,00 EUR\nGesamtbetrag 1.190,00 EUR\nzahlbar bis 14.04.2024\n"
LETTER = "2. Mahnung\nMahndatum: 01.05.2024\nHauptforderung 1.190,00\nMahngebühr 5,00\nGesamtforderung 1.195,00\n"


def test_documents(spark):
    docs = spark.createDataFrame([(1, INVOICE), (2, LETTER), (3, ""), (4, None), (5, "Lieferschein\nWare wurde geliefert")], "doc_id long, text string")
    got = {r.doc_id: r for r in documents.analyse(docs, date(2024, 6, 1)).collect()}
    one = got[1]
    assert (one.kind, one.net_cents, one.vat_cents, one.gross_cents, one.document_date, one.due_date, one.invoice_number, one.issues) == ("invoice", 100_000, 19_000, 119_000, date(2024, 3, 15), date(2024, 4, 14), "RE-2024/001", "")
    assert (got[2].kind, got[2].fees_cents, got[2].total_claimed_cents, got[2].issues) == ("second_dunning", 500, 119_500, "")
    assert [got[k].kind for k in (3, 4, 5)] == ["other", "other", "delivery_note"] and got[3].kind_confidence == 0.0
    refs = labels.references(docs)
    assert {(r.ref_type, r.normalized) for r in refs.where("doc_id = 1").collect()} == {("customer_number", "K4711")}


def test_patterns_of_fields_run_once(spark):
    """Each pattern on a text stands in the plan once or twice, not once for each use of what it finds."""
    docs = spark.createDataFrame([(1, INVOICE)], "doc_id long, text string")
    one = documents.extract_fields(docs).select("gross_cents", "due_date", "invoice_number")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(_low") <= 3 and plan.count("regexp_extract(text") <= 1
    assert tuple(one.first()) == (119_000, date(2024, 4, 14), "RE-2024/001")


def test_search(spark):
    docs = spark.createDataFrame([(1, "Müller Bau, Rechnung"), (2, "Rechnung Nr 5"), (3, None)], "doc_id long, text string")
    index = search.inverted_index(docs)
    assert [r.doc_id for r in search.fulltext(index, "mull rech").collect()] == [1]
    assert {r.doc_id for r in search.fulltext(index, "RECHNUNG").collect()} == {1, 2}
    assert search.fulltext(index, "...").count() == 0


def test_files(spark, tmp_path):
    for name, body in (("a.txt", "x"), ("b.txt", "x"), ("c.exe", "y"), ("d.txt", "z")):
        (tmp_path / name).write_text(body)
    got = files.import_files(spark, str(tmp_path))
    assert got.count() == 2 and files.import_files(spark, str(tmp_path), got.limit(1)).count() == 1
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff"))], "id long, body binary")
    files.dump({"t": df}, str(tmp_path / "dump"))
    assert files.load(spark, str(tmp_path / "dump"), {"t": "id long, body binary"})["t"].first().body == b"\x00\xff"


def test_stream_is_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.sql("select cast(id as long) event_id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int),0) ts, id % 3 user_id, 'view' event_type, 1.5D value, '' props from range(50)")
    events.unionByName(events.limit(10)).write.parquet(source)
    for _ in range(2):
        q = ingest.append_new(ingest.event_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "check"), "event_id")
        assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    stream = ingest.daily_sums(ingest.event_stream(spark, source), "1 hour").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    assert stream.awaitTermination(60)
    assert spark.table("sums").first().amount_cents == 60 * 150
