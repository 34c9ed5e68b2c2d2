"""Links of documents to invoices, reports, child rows, and streams that keep their state."""

from __future__ import annotations

import shutil
from datetime import date

from pyspark.sql import functions as F

from skonto.functions.text import normalize_name
from skonto.operators import interest, links
from skonto.operators import search as S
from skonto.plans import reports
from skonto.sources import children, files
from skonto.streaming import ingest

FIELDS = "doc_id long, kind string, supplier_id long, invoice_number string, principal_cents long, gross_cents long, payment_cents long, referenced_date date"


def test_links(spark):
    invoices = spark.createDataFrame(
        [(1, 7, "RE-2024/0158", 11_900, date(2024, 1, 5)), (2, 7, "RE-2024/0159", 500, date(2024, 1, 6)), (3, 8, "B8-1", 700, date(2024, 1, 7)), (4, 7, "X", 900, date(2024, 1, 8))],
        "invoice_id long, supplier_id long, invoice_number string, gross_cents long, invoice_date date",
    )
    texts = ["Rechnung RE-2024/0158 offen", "Nr. RE 2O24 / OI5B.", None, "re-2024-0159!", "Az 55-1", "nichts " * 50_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = [(0, "first_dunning", 7, "RE-2024/0158", None, None, None, None), (1, "first_dunning", None, None, None, None, None, None), (2, "bank_statement", 7, None, None, 900, 900, date(2024, 1, 8)), (3, "invoice", 8, None, None, None, None, None), (4, "invoice", 7, None, 500, None, None, None), (5, None, None, None, None, None, None, None)]
    known = spark.createDataFrame([("case", 70, "551"), ("document", 1, "551")], "owner_kind string, owner_id long, normalized string")
    got = links.link_documents(
        docs, spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(4, "551")], "doc_id long, normalized string"), invoices, known,
        spark.createDataFrame([(70, 2)], "case_id long, invoice_id long"), spark.createDataFrame([(4, 900)], "invoice_id long, balance_cents long"),
    )
    assert {(r.doc_id, r.invoice_id): (round(r.score, 3), r.reasons) for r in got.collect()} == {
        (0, 1): (0.75, "NUMBER,SUPPLIER"), (1, 1): (0.4, "MISREAD"), (2, 4): (0.65, "SUPPLIER,AMOUNT,DATE,BALANCE"), (4, 2): (0.85, "REFERENCE,SUPPLIER,AMOUNT"),
    }


def test_misread_numbers_in_long_texts(spark, monkeypatch):
    """A number at every place of a text, in pieces shorter and longer than it."""
    numbers = spark.createDataFrame([(1, "RE20240158"), (2, "AB1200")], "invoice_id long, number string")
    rows = [(k, "x" * k + " RE-2O24/OI5B " + "y" * (30 - k)) for k in range(30)] + [(100, "AB12OO"), (101, "B1200"), (102, "q" * 300_000 + "ab 12 oo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(k, 1) for k in range(30)} | {(100, 2), (102, 2)}
    for piece in (7, 16, 4096):
        monkeypatch.setattr(links, "PIECE", piece)
        some = docs if piece > 100 else docs.where("doc_id < 102")
        assert {tuple(r) for r in links.misread_numbers(some, numbers).collect()} == {w for w in want if piece > 100 or w[0] < 102}


def test_misread_numbers_are_whole(spark, monkeypatch):
    """A number that begins or ends another one is not meant, also where its digits are read as letters."""
    numbers = spark.createDataFrame([(1, "RE1996123456"), (2, "RE19961234567"), (3, "4711234"), (4, "RE19961234568")], "invoice_id long, number string")
    said = ["RE - I996/I234S67 offen", "RE-I996/I234S6", "RE-1996/123456Seite", "RE-1996/12345678", "94711234", "O47II234", "x4711234", "RE-1996/123456 7", "RE 1996/12345I–B", "RE-1996/123456 - bitte"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for piece in (7, 4096):
        monkeypatch.setattr(links, "PIECE", piece)
        assert {tuple(r) for r in links.misread_numbers(docs, numbers).collect()} == {(0, 2), (1, 1), (2, 1), (6, 3), (7, 1), (7, 2), (9, 1)}


def test_payments_report(spark):
    payments = spark.createDataFrame([(1, 5, date(2024, 1, 1), 100), (2, 5, date(2024, 1, 2), 100), (3, 6, date(2024, 1, 3), 50)], "payment_id long, supplier_id long, payment_date date, payment_cents long")
    used = spark.createDataFrame([(1, 11, "costs", 40), (1, 12, "principal", 60), (1, 11, "principal", 0), (2, 12, "principal", 30)], "payment_id long, invoice_id long, component string, allocated_cents long")
    invoices = spark.createDataFrame([(11, "B"), (12, "A")], "invoice_id long, invoice_number string")
    got = {r.payment_id: (r.invoice_numbers, r.allocated_cents, r.status) for r in reports.payments_report(payments, used, invoices, spark.createDataFrame([(1,), (2,), (2,)], "payment_id long")).collect()}
    assert got == {1: ("A, B", 100, "booked"), 2: ("A", 30, "credit"), 3: ("", 0, "cancelled")}


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([("b;c", date(2024, 3, 1), 123_456), ('a "x"', None, -5), (None, None, None)], "name string, day date, cents long")
    files.write_report(df, f"{tmp_path}/r", ["name"], "Titel", "Stand; heute", money=["cents"], totals=["cents"])
    part = next((tmp_path / "r").glob("part-*")).read_bytes()
    assert part.decode("utf-8").split("\n") == ["﻿Titel", '"Stand; heute"', "name;day;cents", ";;", '"a ""x""";;-0,05', '"b;c";01.03.2024;1.234,56', "Summe;;1.234,51", ""]
    empty = files.report_lines(df.limit(0), "T", "", ["name"], totals=["cents"])
    assert [r.line for r in empty.orderBy("place").collect()] == ["﻿T", "", "name;day;cents", "Summe;;0"]


def test_children(spark, tmp_path):
    path, norm = f"{tmp_path}/aliases", normalize_name(F.col("alias"))
    rows = lambda *x: spark.createDataFrame(list(x), "party_id long, alias string")
    children.create_children(rows((1, "Alpha GmbH"), (1, "alpha"), (1, " "), (2, "Beta"), (3, "Gamma")), path, "party_id", "alias", norm, buckets=2)
    children.replace_children(path, rows((1, ""), (3, "")), rows((1, "Neu"), (1, "neu!"), (2, "gehört niemandem")), "party_id", "alias", norm, buckets=2)
    table = spark.read.parquet(path)
    assert sorted((r.party_id, r.alias) for r in table.collect()) == [(1, "Neu"), (2, "Beta")]
    children.replace_children(path, rows((1, ""), (2, "")), rows(), "party_id", "alias", norm, buckets=2)
    children.replace_children(path, rows(), rows((2, "x")), "party_id", "alias", norm, buckets=2)
    assert spark.read.schema(table.schema).parquet(path).count() == 0
    nested = children.with_children(spark.createDataFrame([(1,), (2,)], "party_id long"), "party_id", aliases=rows((1, "b"), (1, "a")))
    assert {r.party_id: r.aliases for r in nested.collect()} == {1: ["a", "b"], 2: []}


def test_interest_as_of_against_day_loop(spark):
    rates = spark.createDataFrame([(date(2023, 1, 1), 162), (date(2023, 7, 1), 312)], "valid_from date, rate_bp long")
    claims = spark.createDataFrame([(1, 100_000, date(2023, 5, 20), date(2023, 9, 1)), (2, 5_000, date(2023, 6, 1), date(2023, 9, 1))], "claim_id long, principal_cents long, due_date date, until date")
    paid = spark.createDataFrame([(1, date(2023, 6, 10), 30_000), (2, date(2023, 6, 20), 5_000)], "claim_id long, payment_date date, paid_cents long")
    segments = interest.interest_segments(claims, paid, rates, 900)
    days = [date.fromordinal(date(2023, 5, 15).toordinal() + k) for k in range(0, 100, 3)]
    asked = spark.createDataFrame([(c, d) for c in (1, 2, 3) for d in days] + [(1, days[7])], "claim_id long, day date")
    got = {(r.claim_id, r.day): r.interest_cents for r in interest.interest_as_of(asked, segments).collect()}

    def loop(principal, due, payments, day):
        units = 0
        for k in range(due.toordinal() + 1, day.toordinal() + 1):
            d = date.fromordinal(k)
            units += max(0, principal - sum(c for x, c in payments if x < d)) * ((312 if d >= date(2023, 7, 1) else 162) + 900)
        return (2 * units + 3_650_000) // 7_300_000

    assert got == {(1, d): loop(100_000, date(2023, 5, 20), [(date(2023, 6, 10), 30_000)], d) for d in days} | {(2, d): loop(5_000, date(2023, 6, 1), [(date(2023, 6, 20), 5_000)], d) for d in days} | {(3, d): 0 for d in days}


def test_chosen_parties(spark):
    parties = spark.createDataFrame([(1, "Müller & Co", "Weg 1"), (2, "Schulz", None), (3, "Otto", "Müllerstraße 3")], "party_id long, name string, address string")
    aliases, ibans = spark.createDataFrame([(2, "Mueller Nord")], "party_id long, alias string"), spark.createDataFrame([(3, "DE89 3704 0044")], "party_id long, iban string")
    ask = lambda typed: sorted(r.party_id for r in S.chosen_parties(parties, aliases, ibans, typed).collect())
    assert ask("müller") == [1, 2, 3] and ask("de893704") == [3] and ask("  ") == [1, 2, 3] and ask("schulz") == [2] and ask("niemand") == []


def test_streams_remember_what_came(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    lines = lambda ids: spark.createDataFrame([(k, f"2024-01-0{1 + k % 9} 10:00:00", k, "purchase", 1.0, "") for k in ids], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    run = lambda: ingest.append_new(ingest.event_stream(spark, source), out, check, "event_id").awaitTermination(120)
    lines([1, 2, 2, 3]).coalesce(1).write.mode("append").parquet(source)
    run()
    shutil.rmtree(out)  # nothing of the target is read: what came is known all the same, and after a restart too
    lines([2, 3, 4]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [4]


def test_change_feed(spark, tmp_path):
    source, told = f"{tmp_path}/in", []
    add = lambda rows: spark.createDataFrame(rows, "id long, entity string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.change_feed(spark.readStream.schema("id long, entity string").parquet(source), f"{tmp_path}/c", lambda df, k: told.append({tuple(r) for r in df.collect()})).awaitTermination(120)
    add([(1, "invoice"), (2, "invoice"), (3, "payment")])
    run()
    add([(5, "invoice")])
    run()
    assert [x for x in told if x] == [{("invoice", 2, 2), ("payment", 3, 1)}, {("invoice", 5, 3)}]
