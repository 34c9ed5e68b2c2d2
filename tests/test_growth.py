"""Work that grows with the input, where many rows share an amount, a name or a number's end."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from skonto.operators import bank, links, senders
from skonto.sources.shared import MOST_SENT, written
from metrics import most_joined


def test_existing_payments_of_a_common_amount(spark):
    """lines of one amount do not meet every payment of that amount."""
    days = [date(2024, 1, 1) + timedelta(days=k * 7 % 23) for k in range(600)]
    own = [k if k % 3 else (k - 1 if k % 2 else None) for k in range(600)]
    lines = spark.createDataFrame([(k, 5, -100, d) for k, d in enumerate(days)], "tx_id long, supplier_id long, amount_cents long, booking_date date")
    paid = spark.createDataFrame([(1000 - k, o, 5, 100, d) for k, (d, o) in enumerate(zip(days, own))], "payment_id long, own_tx_id long, supplier_id long, payment_cents long, payment_date date")
    found = bank.existing_payments(lines, paid)
    wanted = {}
    for k, d in enumerate(days):
        near = [(e, 1000 - j) for j, (e, o) in enumerate(zip(days, own)) if abs((e - d).days) <= 5 and o != k]
        wanted[k] = min(near)[1]
    assert {r.tx_id: r.payment_id for r in found.collect()} == wanted
    assert most_joined(found) <= 2 * 600


def test_matching_of_a_common_name_and_amount(spark):
    """a line meets few of the suppliers that share its name or amount, and has the best and the second of all evidence."""
    n = 60
    parties = spark.createDataFrame([(k, f"Haus Mueller {k % 3}", "supplier", None) for k in range(n)], "party_id long, name string, role string, represents_id long")
    aliases = spark.createDataFrame([(k, "Seeblick") for k in range(40, n)], "party_id long, alias string")
    items = spark.createDataFrame([(k, k, f"RE-{k:05d}", 100 * (1 + k % 4)) for k in range(n)], "supplier_id long, invoice_id long, invoice_number string, balance_cents long")
    names = ("Haus Mueller 2", "Seeblick", "Haus Muller", "Niemand")
    lines = [(k, "", names[k % 4], f"RE-{k // 2:05d}" if k % 5 == 0 else "Zahlung", "", -100 * (1 + k % 7)) for k in range(400)]
    lines = spark.createDataFrame(lines, "tx_id long, counterparty_iban string, counterparty_name string, purpose string, reference string, amount_cents long")
    ibans, paid = spark.createDataFrame([], "party_id long, iban string"), spark.createDataFrame([], "supplier_id long, iban string, payment_date date, payment_id long")
    every = bank.exact_evidence(lines, parties, ibans, paid, items, bank.number_mentions(lines, items)).unionByName(bank.name_evidence(lines, parties, aliases).select("*", F.lit("NAME").alias("reason")))
    wanted = bank.best_with_runner_up(bank.noisy_or(every, "tx_id", "supplier_id"), "tx_id", "supplier_id")
    shown = lambda df: {r.tx_id: (r.supplier_id, round(r.score, 9), r.reasons, r.ambiguous) for r in df.collect()}
    assert shown(bank.match_suppliers(lines, parties, ibans, paid, items, aliases)) == shown(wanted) and wanted.count() > 300
    told = bank.leading_evidence(lines, parties, items, every.limit(0), aliases)
    assert told.count() <= 12 * 400 < every.count()


def test_namesakes(spark, monkeypatch):
    """F8: of many parties with one name a letter meets the first ones, and ranks them as among all of them."""
    n = 40
    parties = spark.createDataFrame([(k, "Seeblick Handel" if k % 2 else "Nordlicht Energie", "supplier", None, f"DE{100_000_000 + k}", "", "") for k in range(n)], "party_id long, name string, role string, represents_id long, vat_id string, tax_number string, email string")
    aliases = spark.createDataFrame([(7, "Blickfang")], "party_id long, alias string")
    body = "\nWeg 1, 12345 Ort\n\nMahnung\nHauptforderung: 100,00 EUR\n"
    texts = [f"Seeblick Handel GmbH{body}", f"Seeblick Handel GmbH{body}USt-IdNr. DE100000039\n", f"Blickfang GmbH{body}", f"Nordlicht Energie{body}wir schreiben Seeblick Handel\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, ibans = spark.createDataFrame([("Haus Eigen",)], "name string"), spark.createDataFrame([], "party_id long, iban string")
    known = senders.contacts(docs)
    names = senders.written(senders.sender_names(docs, own, known), "names")
    found = []
    for most in (senders.NAMESAKES, 1000):
        monkeypatch.setattr(senders, "NAMESAKES", most)
        evidence = senders.written(senders.author_evidence(docs, names, known, parties, aliases, ibans, own), "evidence")
        found.append((evidence.count(), sorted(map(tuple, senders.ranked(evidence).collect()))))
    assert found[0][1] == found[1][1] and len({r[0] for r in found[0][1]}) == 4
    assert found[0][0] < 60 < found[1][0]


def test_misread_numbers_that_end_alike(spark):
    """a stretch meets only the number that it is, not all that end like it."""
    numbers = spark.createDataFrame([(k, f"RE{1000 + k}123456") for k in range(300)], "invoice_id long, number string")
    docs = spark.createDataFrame([(k, f"Betreff RE-{1000 + k}/1Z3456 und RE-{1000 + k}/I23456") for k in range(100)], "doc_id long, text string")
    found = links.misread_numbers(docs, numbers)
    assert {(r.doc_id, r.invoice_id) for r in found.collect()} == {(k, k) for k in range(100)}
    assert most_joined(found) <= 200


def test_written_tables_are_not_sent_whole(spark):
    """a join doesn't take a table for small because its files are; a small one may still go to every task."""
    rows = lambda n: spark.range(n).select("id", F.lit("the same for all").alias("same"))
    large, small, other = written(rows(MOST_SENT + 1), "large"), written(rows(100), "small"), rows(10 * MOST_SENT).select("id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    met = other.join(large, "id")
    assert met.count() == MOST_SENT + 1 and "Broadcast" not in plan(met)
    assert "Broadcast" not in plan(other.join(large.where("id > 5").groupBy("id").agg(F.count("*")), "id", "left_anti"))
    assert "Broadcast" in plan(other.join(small, "id"))
