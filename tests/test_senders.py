"""Senders, suppliers and references of letters with known answers, and the parts of the recognition."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from letters import AGENCIES, KNOWN, OWN, letters
from pyspark.sql import functions as F

from skonto.functions.text import normalize_name
from skonto.operators import labels, senders

DOCS = "doc_id long, text string, kind string"


def master(spark, hard):
    """Parties; with ``hard`` names as somebody typed them, and nothing else known of suppliers."""
    rows = [(f.id, f.short if hard else f.name, "supplier", None, f.vat if not hard and f.id % 3 == 0 else "", "", "") for f in KNOWN]
    rows += [(f.id, f.name, "collection_agency", f.agency_of, "", "", "") for f in AGENCIES]
    ibans = [(f.id, f.iban) for f in KNOWN if not hard and f.id % 2 == 0] + [(f.id, f.iban) for f in AGENCIES[:2]]
    return (
        spark.createDataFrame(rows, "party_id long, name string, role string, represents_id long, vat_id string, tax_number string, email string"),
        spark.createDataFrame([], "party_id long, alias string"),
        spark.createDataFrame(ibans, "party_id long, iban string"),
        spark.createDataFrame([(n,) for n in OWN], "name string"),
    )


@pytest.mark.parametrize("hard, supplier_floor, name_floor", [(False, 0.98, 0.95), (True, 0.90, 0.85)])
def test_letters(spark, hard, supplier_floor, name_floor):
    every = letters(0.07 if hard else 0.0)
    docs = spark.createDataFrame([(k, x.text, x.kind) for k, x in enumerate(every)], DOCS)
    got = {r.doc_id: r for r in senders.senders(docs, *master(spark, hard)).collect()}
    assert len(every) == 72 and sorted(got) == list(range(72))
    known = [k for k, x in enumerate(every) if x.author.id < 40]
    wrong = [(k, every[k].printed, every[k].supplier.name, got[k].supplier_id, got[k].author_id, got[k].reasons, got[k].new_name) for k in known if got[k].supplier_id != every[k].supplier.id]
    assert 1 - len(wrong) / len(known) >= supplier_floor, wrong
    if not hard:
        authors = [(k, every[k].printed, got[k].author_id) for k in known if got[k].author_id != every[k].author.id]
        assert 1 - len(authors) / len(known) >= supplier_floor, authors
    plain = lambda n: (n or "").lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
    new = [k for k, x in enumerate(every) if x.author.id >= 40]
    missed = [(k, every[k].printed, got[k].new_name, got[k].author_id) for k in new if got[k].author_id is not None or SequenceMatcher(None, plain(got[k].new_name), plain(every[k].printed)).ratio() < 0.8]
    assert 1 - len(missed) / len(new) >= name_floor, missed
    if not hard:
        addressed = [k for k in new if got[k].new_address and every[k].author.street in got[k].new_address]
        assert len(addressed) >= 0.5 * len(new) and all(got[k].new_email in (None, f"info@{every[k].author.domain}") for k in new) and all(every[k].author.iban in got[k].new_ibans for k in new)


def test_references_of_letters(spark):
    every = letters()
    docs = spark.createDataFrame([(k, x.text, x.kind) for k, x in enumerate(every)], DOCS)
    got = {(r.doc_id, r.ref_type, r.value) for r in labels.references(docs).collect()}
    want = {(k, kind, v) for k, x in enumerate(every) for kind, v in x.refs.items()}
    assert len(want & got) >= 0.95 * len(want), sorted(want - got)[:10]
    assert len(got & want) >= 0.97 * len(got), sorted(got - want)[:10]


def test_own_names(spark):
    own = spark.createDataFrame([("Hotel Seeblick",), ("Seeblick Hotels GmbH",), ("Kranich",), ("Strandhotel Möwe am Meer",)], "name string")
    names = ["Hotel Seeblick", "Hotel Seeblick Lübeck", "Hotel Seeblick Lübeck Nord", "Seeblick", "Kranich", "Kranich Werft", "Möwe Meer", "Möwe", "Hotel", "Andere Firma", ""]
    segments = spark.createDataFrame([(n,) for n in names], "seg string").select("seg", normalize_name(F.col("seg")).alias("norm"))
    found = {r.norm for r in senders.own_names(segments, own).collect()}
    assert {r.seg for r in segments.collect() if r.norm in found} == {"Hotel Seeblick", "Hotel Seeblick Lübeck", "Kranich", "Möwe Meer"}
    assert senders.own_names(segments, own.limit(0)).count() == 0


def test_contacts(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 BIC\nDE89370400440532013001\nUSt-IdNr. DE123456789, Steuernummer: 27 / 123 / 45678\nInfo@Firma-X.co.uk und x@gmail.com, www.firma-y.de\nTel. 030 1234567"
    r = senders.contacts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].ibans == ["DE89370400440532013000"] and r[0].vat_ids == ["DE123456789"] and r[0].tax_numbers == ["27/123/45678"]
    assert r[0].emails == ["info@firma-x.co.uk", "x@gmail.com"] and r[0].domains == ["firma-x.co.uk", "firma-y.de"] and r[0].phones == ["030 1234567"]
    assert r[1].ibans == [] and r[1].domains == []


def test_payee_creditor_and_nothing(spark):
    parties, aliases, ibans, own = master(spark, False)
    docs = spark.createDataFrame(
        [
            (1, f"Zahlungsbestätigung\nEmpfänger: {KNOWN[3].name}\nBetrag: 5,00", "bank_statement"),
            (2, f"Kontoauszug\nIBAN {KNOWN[2].iban}", "bank_statement"),
            (3, "Unbekanntes Inkasso GmbH\nWeg 1, 12345 Ort\nGläubiger: Niemand Bekanntes KG", "collection_letter"),
            (4, None, "invoice"),
            (5, "", None),
            (6, "x " * 200_000, "invoice"),
        ],
        DOCS,
    )
    got = {r.doc_id: r for r in senders.senders(docs, parties, aliases, ibans, own).collect()}
    assert (got[1].supplier_id, got[1].how, got[1].author_id) == (3, "PAYEE", None) and (got[2].supplier_id, got[2].how) == (2, "PAYEE")
    assert (got[3].author_id, got[3].supplier_id, got[3].creditor_name, got[3].new_name) == (None, None, "Niemand Bekanntes KG", "Unbekanntes Inkasso GmbH")
    assert all(got[k].author_id is None and got[k].supplier_id is None and got[k].how == "NONE" for k in (4, 5, 6))
