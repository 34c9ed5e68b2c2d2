"""References in four layouts, labels as scanners break them, and what is no reference."""

from __future__ import annotations

import pytest

from skonto.operators import labels


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


FOUND = [
    ("Kundennummer: 12345      Vertragsnummer: V-77", {("customer_number", "12345"), ("contract_number", "V-77")}),
    ("Kundennummer 12345 Rechnungsnummer R-1", {("customer_number", "12345")}),
    ("Kundennummer:\n12345", {("customer_number", "12345")}),
    ("Kundennummer   Vertragsnummer\n12345   V-77", {("customer_number", "12345"), ("contract_number", "V-77")}),
    ("Ihre Kundennummer\n4711", {("customer_number", "4711")}),
    ("Aktenzeichen: AZ 61-1090", {("file_number", "AZ 61-1090")}),
    ("Aktenzeichen: INK-NEW-9", {("file_number", "INK-NEW-9")}),
    ("Aktenzeichen: 12 C 345/24", {("file_number", "12 C 345/24")}),
    ("Unser Zeichen: VT/40/192 vom 12.03.2024", {("letter_number", "VT/40/192")}),
    ("Kd.-Nr.4711 und mehr", {("customer_number", "4711")}),
    ("Kunden nummer 4711", {("customer_number", "4711")}),
    ("Forderungs - Nr. F123456", {("claim_number", "F123456")}),
    ("Kundennummer beim Gläubiger: 56789", {("customer_number", "56789")}),
    ("Kundennummer: 12 345 678", {("customer_number", "12 345 678")}),
    ("Mietvertrag Nr.: 77/8, Kundennr. KD-99.", {("contract_number", "77/8"), ("customer_number", "KD-99")}),
    ("Customer no. 55-1 | Order number: PO8812", {("customer_number", "55-1"), ("order_number", "PO8812")}),
    ("Kundennummer: 31.12.2024", set()),
    ("Kundennummer: 1.234,56", set()),
    ("Kundennummer:", set()),
    ("Kundennummer: Musterstraße", set()),
    ("Kundennummer:\nVertragsnummer: V-77", {("contract_number", "V-77")}),
    ("Kundennummerierung 123", set()),
    (None, set()),
    ("", set()),
    (" \n\t\n", set()),
]


def test_references(spark):
    got = {}
    for r in labels.references(docs(spark, [t for t, _ in FOUND])).collect():
        got.setdefault(r.doc_id, set()).add((r.ref_type, r.value))
    assert {k: got.get(k, set()) for k in range(len(FOUND))} == {k: want for k, (_, want) in enumerate(FOUND)}


def test_added_words_and_repeats(spark):
    text = "Zählernummer: Z-998\nKundennummer: 123 \nKunden-Nr. 1 2 3\nKundennummer: 123"
    assert {(r.ref_type, r.value) for r in labels.references(docs(spark, [text]), extra={"other": ["Zähler-Nummer"]}).collect()} == {("other", "Z-998"), ("customer_number", "123")}
    assert labels.references(docs(spark, [])).count() == 0


def test_long_text(spark):
    text = "Zeile ohne Zahl\n" * 20_000 + "Aktenzeichen: A-12\n" + "wort " * 20_000
    assert [(r.ref_type, r.value) for r in labels.references(docs(spark, [text, "x"])).collect()] == [("file_number", "A-12")]


@pytest.mark.parametrize("text, spans", [("Unsere Kunden - Nr . : 5", [(1, 4, "customer_number")]), ("Versicherungs schein nummer 9", [(0, 3, "contract_number")]), ("nichts", [])])
def test_spans(spark, text, spans):
    table = labels.label_keys(labels.W.REFERENCES)
    hits = labels.without_overlaps(labels.label_hits(labels.lines_of(docs(spark, [text])), table))
    assert sorted((r.at, r.upto, r.name) for r in hits.collect()) == spans
