"""Analyses and proposals of documents, and both as JSON of this version and the one before."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from skonto.operators import documents as DOC
from skonto.operators import reviews

DAY, DUE = date(2025, 3, 1), date(2025, 3, 15)


def analysis(kind, amounts=None, sender=None, candidates=(), number=None, due=None, day=DAY, paid_on=None, issues=(), ibans=()):
    return (2, 10, kind, 0.9, 0.8, (day, due, paid_on, number, None, ""), amounts or {}, [("customer_number", "KD-1")], list(ibans), [], sender, list(candidates), list(issues))


#: party_id, name, score, supplier_id, supplier_score, creditor_name
KNOWN, AGENT = (7, "Fuchs e.K.", 0.9, 7, None, None), (20, "Kontor AG", 0.9, 7, 0.7, None)
NEW, CLAIMANT = (None, "Winter GmbH", 0.5, None, None, None), (20, "Kontor AG", 0.7, None, None, "Lager OHG")
LINK = (55, 0.75, "NUMBER,SUPPLIER", 8)


@pytest.fixture(scope="module")
def proposed(spark):
    rows = {
        1: analysis("invoice", {"net": 1000, "vat": 190, "gross": 1190}, KNOWN, number="R1"),
        2: analysis("invoice", {"gross": 1190}, NEW, due=DUE, number="R2"),
        3: analysis("credit_note", {"gross": 500}, None, [LINK]),
        4: analysis("first_dunning", {"principal": 1000, "fees": 50, "total_claimed": 1050}, AGENT, [LINK], due=DUE),
        5: analysis("collection_letter", {"principal": 1000, "fees": 50, "total_claimed": 1050, "already_paid": 300}, CLAIMANT, [LINK, (56, 0.4, "NUMBER", 9)]),
        6: analysis("court_order", {}, NEW, day=None, issues=["NO_LINK"]),
        7: analysis("bank_statement", {"payment_amount": 700}, None, [LINK], paid_on=DUE, number="R9", ibans=["DE1", "DE2"]),
        8: analysis("other"),
    }
    df = spark.createDataFrame(list(rows.items()), f"doc_id long, analysis struct<{reviews.ANALYSIS}>")
    scopes = spark.createDataFrame([(1, 3, 4), (2, 3, None)], "doc_id long, company_id int, hotel_id int")
    return {r.doc_id: r.proposal for r in reviews.proposals(df, scopes, payment_days=10).collect()}


def test_bills(proposed):
    p = proposed[1]
    assert (p.kind, p.supplier_id, p.supplier_suggested, p.company_id, p.hotel_id, p.due_date, p.net_cents, p.gross_cents) == ("invoice", 7, False, 3, 4, date(2025, 3, 11), 1000, 1190)
    assert p.messages == ["DUE_ASSUMED"] and p.confidence["due_date"] == 0.3 and str(p.vat_rate) == "19.0000" and p.claims == [] and p.payment_invoice_ids == []
    p = proposed[2]
    assert (p.due_date, p.new_supplier_name, p.new_sender_name, p.new_sender_role, p.supplier_id, p.messages) == (DUE, "Winter GmbH", "", "supplier", None, [])
    p = proposed[3]
    assert (p.kind, p.invoice_id, p.supplier_id, p.gross_cents, p.due_date, p.level) == ("credit", 55, 8, 500, None, None)


def test_letters(proposed):
    p = proposed[4]
    assert (p.kind, p.level, p.supplier_id, p.supplier_suggested, p.sender_id, p.sender_suggested, p.due_date) == ("notice", 2, 7, True, 20, False, DUE)
    assert [tuple(c) for c in p.claims] == [(55, 1000, 50, 0, 0, 0, 1050)] and (p.total_claimed_cents, p.credited_cents, p.gross_cents) == (1050, 0, None)
    p = proposed[5]  # the total is printed before the deduction, which the principal bears
    assert [tuple(c) for c in p.claims] == [(55, 700, 50, 0, 0, 0, 750)] and (p.total_claimed_cents, p.credited_cents, p.new_supplier_name, p.sender_suggested, p.supplier_id) == (750, 300, "Lager OHG", True, 8)
    p = proposed[6]
    assert (p.level, p.new_sender_name, p.new_sender_role, p.claims, p.invoice_id, p.document_date, p.messages) == (6, "Winter GmbH", "other", [], None, None, ["NO_LINK"])


def test_payments_and_others(proposed):
    p = proposed[7]
    assert (p.kind, p.payment_cents, p.payment_invoice_ids, p.document_date, p.bank_reference, p.iban, p.supplier_id, p.invoice_id) == ("payment", 700, [55], DUE, "R9", "DE1", 8, None)
    p = proposed[8]
    assert (p.kind, p.supplier_id, p.company_id, p.due_date, p.total_claimed_cents, p.iban, p.references[0].value) == ("none", None, None, None, 0, "", "KD-1")


def test_json_comes_back(spark, proposed):
    df = spark.createDataFrame([(k, p) for k, p in proposed.items()], f"doc_id long, p struct<{reviews.PROPOSAL}>")
    same = df.select("p", reviews.from_text(reviews.as_text(F.col("p")), reviews.PROPOSAL).alias("q"), reviews.from_text(reviews.confirmed_text(F.col("p")), reviews.PROPOSAL).alias("c")).collect()
    assert len(same) == 8 and all(r.p == r.q for r in same)
    assert all(r.c.messages is None and r.c.confidence is None and r.c.claims == r.p.claims and r.c.references == r.p.references for r in same)


def test_versions(spark):
    old = json.dumps({"kind": "notice", "level": 2, "references": [["customer_number", "KD-1"], ["other", "x"]], "due_date": "2025-03-15"})
    now = json.dumps({"version": 2, "kind": "notice", "references": [{"ref_type": "other", "value": "y"}], "unheard": 1})
    texts = [(0, old), (1, now), (2, json.dumps({"version": 3, "kind": "notice"})), (3, "no json"), (4, ""), (5, None), (6, json.dumps({"version": "x", "kind": "none"}))]
    rows = spark.createDataFrame(texts, "k int, text string").select("k", reviews.from_text(F.col("text"), reviews.PROPOSAL).alias("p")).collect()
    got = {r.k: r.p for r in rows}
    assert got[0].version == 2 and got[0].level == 2 and got[0].due_date == DUE and [tuple(r) for r in got[0].references] == [("customer_number", "KD-1"), ("other", "x")]
    assert [tuple(r) for r in got[1].references] == [("other", "y")] and got[2] is None and got[3] is None and got[4] is None and got[5] is None and got[6].kind == "none"


def test_analyses_of_texts(spark):
    texts = [
        (1, "Fuchs e.K.\n\nRechnung\n\nRechnungsnummer: R-100\nRechnungsdatum: 01.03.2025\nNettobetrag: 100,00\nUmsatzsteuer: 19,00\nRechnungsbetrag: 119,00"),
        (2, "1. Mahnung\nDatum: 01.03.2025\nHauptforderung: 100,00\nGesamtforderung: 100,00"),
        (3, ""), (4, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    fields = DOC.analyse(docs, date(2026, 1, 1))
    contacts = spark.createDataFrame([(1, ["DE1"], [])], "doc_id long, ibans array<string>, vat_ids array<string>")
    by = spark.createDataFrame([(1, 7, 0.9, 7, None, None, None), (2, None, 0.4, None, None, None, "Winter GmbH")], "doc_id long, author_id long, score double, supplier_id long, supplier_score double, creditor_name string, new_name string")
    parties = spark.createDataFrame([(7, "Fuchs")], "party_id long, name string")
    references = spark.createDataFrame([(1, "other", "b"), (1, "customer_number", "a")], "doc_id long, ref_type string, value string")
    links = spark.createDataFrame([(1, 55, 0.75, "NUMBER,SUPPLIER", 1), (1, 56, 0.5, "AMOUNT", 2)], "doc_id long, invoice_id long, score double, reasons string, rank int")
    invoices = spark.createDataFrame([(55, 7), (56, 7)], "invoice_id long, supplier_id long")
    got = {r.doc_id: r.analysis for r in reviews.analyses(docs, fields, contacts, by, parties, references, links, invoices).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    a = got[1]
    assert (a.kind, a.fields.invoice_number, a.amounts, a.sender.name, a.issues) == ("invoice", "R-100", {"gross": 11900, "net": 10000, "vat": 1900, "principal": 11900}, "Fuchs", ["DUPLICATE_INVOICE"]), a
    assert [c.invoice_id for c in a.candidates] == [55, 56] and [r.ref_type for r in a.references] == ["customer_number", "other"]
    assert a.confidence == pytest.approx(0.4 * a.kind_confidence + 0.35 + 0.25 * 0.9 - 0.05, abs=1e-3)
    b = got[2]
    assert (b.kind, b.sender.party_id, b.sender.name, b.issues, b.candidates, b.ibans) == ("first_dunning", None, "Winter GmbH", ["NO_LINK", "NO_SUPPLIER"], [], [])
    assert b.confidence == pytest.approx(0.4 * b.kind_confidence + 0.35 * 2 / 3 - 0.24, abs=1e-3)
    for k in (3, 4):
        assert (got[k].kind, got[k].text_length, got[k].sender, got[k].issues) == ("other", 0, None, []) and got[k].confidence == pytest.approx(0.35 * 0.5 + 0.25 * 0.2, abs=1e-3)
