"""Values below their labels and amounts that add up, on known answers."""

from __future__ import annotations

from datetime import date

from skonto.operators import documents
from skonto.operators import layouts as L

DOCS = {
    1: "Rechnung\nRechnungsnummer   Rechnungsdatum\nR-2024-77   12.03.2024\nNettobetrag   MwSt   Gesamtbetrag\n100,00   19,00   119,00\n",
    2: "Rechnungsnummer\nRE-2024-881\nRechnungsdatum\n15.03.2024\nNettobetrag\n200,00\nMwSt.\n38,00\nGesamtbetrag\n238,00",
    3: "Rechnung\nRechnungsnummer:\nRechnungsdatum:\nNettobetrag\nMwSt.\nGesamtbetrag\nR-9\n12.03.2024\n100,00\n19,00\n119,00",
    4: "Gesamt 100,00 19,00 119,00",
    5: "Posten 50,00\n50,00\nsteht 100,00 und 19,00 und 119,00",
    6: "Gesamtbetrag 119,00\nenthält 19 % MwSt",
    7: None,
    8: "",
    9: "Nettobetrag 100,00\nMwSt 19 % 19,00\nNettobetrag 200,00\nMwSt 7 % 14,00\nGesamtbetrag 333,00",
    10: "Nettobetrag 100,00\nGesamtbetrag 119,00",
    11: "Rechnungsnummer\nR-5\n12.03.2024\n7",
    12: "Betrag 3,00 und 4,00",
}


def frame(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")


def test_pairs(spark):
    got = {}
    for r in L.layout_pairs(frame(spark)).collect():
        got.setdefault(r.doc_id, set()).add((r.label, r.value, r.how))
    assert got[1] == {("Rechnungsnummer", "R-2024-77", "header"), ("Rechnungsdatum", "12.03.2024", "header"), ("Nettobetrag", "100,00", "header"), ("MwSt", "19,00", "header"), ("Gesamtbetrag", "119,00", "header")}
    assert ("Rechnungsnummer", "RE-2024-881", "row") in got[2] and len(got[2]) == 5
    assert got[3] == {(a, b, "block") for a, b in (("Rechnungsnummer", "R-9"), ("Rechnungsdatum", "12.03.2024"), ("Nettobetrag", "100,00"), ("MwSt.", "19,00"), ("Gesamtbetrag", "119,00"))}
    assert got[11] == {("Rechnungsnummer", "R-5", "row")} and set(got) == {1, 2, 3, 11}


def test_amounts(spark):
    got = {r.doc_id: (r.net_cents, r.vat_cents, r.gross_cents, r.consistent, r.derived) for r in L.invoice_amounts(frame(spark)).collect()}
    whole = (10_000, 1_900, 11_900, True)
    assert {k: got[k] for k in (1, 3, 4, 5)} == {k: (*whole, "") for k in (1, 3, 4, 5)}
    assert got[2] == (20_000, 3_800, 23_800, True, "") and got[6] == (*whole, "net,vat") and got[9] == (30_000, 3_300, 33_300, True, "") and got[10] == (*whole, "vat")
    assert all(got[k] == (None, None, None, False, "") for k in (7, 8, 11, 12)) and len(got) == len(DOCS)


def test_analysis_reads_layouts(spark):
    got = {r.doc_id: r for r in documents.analyse(frame(spark), date(2024, 6, 1), doc_id="doc_id").collect()}
    assert [(got[k].net_cents, got[k].gross_cents, got[k].invoice_number, got[k].document_date) for k in (1, 3)] == [(10_000, 11_900, "R-2024-77", date(2024, 3, 12)), (10_000, 11_900, "R-9", date(2024, 3, 12))]
    assert len(got) == len(DOCS)


def test_texts_stay_where_they_are(spark):
    """nothing is joined, grouped or written to read layouts, and a long text costs no more than its lines."""
    rows = documents.analyse(frame(spark), date(2024, 6, 1), doc_id="doc_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "parquet" not in plan
    many = 20_000
    text = "\n".join(["Nettobetrag\nMwSt."] + [f"Posten {k % 97}\n{1 + k % 50},00" for k in range(many)] + ["Nettobetrag   MwSt   Gesamtbetrag", "100,00   19,00   119,00"])
    (got,) = L.invoice_amounts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (got.net_cents, got.vat_cents, got.gross_cents, got.consistent) == (10_000, 1_900, 11_900, True)
    labels = "\n".join(["Gesamtbetrag"] * many + ["1,00"] * many)
    pairs = L.layout_pairs(spark.createDataFrame([(1, labels)], "doc_id long, text string"))
    assert pairs.count() == many
