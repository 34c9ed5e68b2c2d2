"""Orders of lists and reports, and names of files and sheets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skonto.functions.dates import format_day
from skonto.functions.text import safe_name, sheet_title
from skonto.plans import reports


def test_lists_by_name(spark):
    df = spark.createDataFrame([(1, "beta"), (2, "Alpha"), (3, "alpha"), (4, "Österreich"), (5, None), (6, "Zeta")], "id long, name string")
    assert [r.id for r in reports.by_name(df, "name", "id").collect()] == [5, 2, 3, 1, 6, 4]


def test_open_items_in_order(spark):
    items = [(1, 10, None), (2, 10, date(2025, 2, 1)), (3, 11, date(2025, 1, 1)), (4, 10, date(2025, 2, 1)), (5, 12, date(2025, 1, 5)), (6, 99, None)]
    df = spark.createDataFrame(items, "invoice_id long, supplier_id long, due_date date")
    parties = spark.createDataFrame([(10, "Beta"), (11, "alpha"), (12, "ALPHA")], "party_id long, name string")
    got = reports.open_items_in_order(df, parties).collect()
    assert [(r.invoice_id, r.supplier, r.place) for r in got] == [(6, "?", 1), (3, "alpha", 1), (5, "ALPHA", 2), (2, "Beta", 1), (4, "Beta", 2), (1, "Beta", 3)]
    assert [r.invoice_id for r in reports.drilled(df).collect()] == [3, 5, 2, 4, 1, 6] and [r.invoice_id for r in reports.drilled(df, 2).collect()] == [3, 5]
    assert reports.open_items_in_order(df.limit(0), parties).count() == 0


def test_sorted_by(spark):
    df = spark.createDataFrame([(1, "b", 10), (2, "A", 9), (3, None, None), (4, "B", 100)], "id long, name string, n int")
    ids = lambda *a, **k: [r.id for r in reports.sorted_by(df, *a, **k).collect()]
    assert ids("name", "id") == [3, 2, 1, 4] and ids("n", "id") == [3, 2, 1, 4] and ids("n", "id", descending=True) == [4, 1, 2, 3] and ids("name", "id", descending=True) == [1, 4, 2, 3]


def test_names_of_files_and_sheets(spark):
    texts = ["Brief/Mai: 2025?.pdf", "  Ä ö (1).txt. ", "...", "", None, "x" * 200, "' [a]*b\\c '"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", safe_name(F.col("t")).alias("f"), sheet_title(F.col("t")).alias("s")).orderBy("k").collect()
    assert [r.f for r in got] == ["Brief_Mai_ 2025_.pdf", "Ä ö (1).txt", "dokument", "dokument", "dokument", "x" * 120, "_ _a__b_c _"]
    assert [r.s for r in got] == ["Brief-Mai- 2025-.pdf", "Ä ö (1).txt.", "...", "Bericht", "Bericht", "x" * 28, "-a--b-c"]
    days = spark.createDataFrame([(1, date(2026, 12, 31)), (2, None)], "k int, d date").select(format_day(F.col("d")).alias("d")).collect()
    assert [r.d for r in days] == ["31.12.2026", ""]
