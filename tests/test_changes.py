"""Decisions of users and what waits for them, on known answers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from skonto.operators import changes as C
from skonto.operators import planners as P
from skonto.operators import search as S
from skonto.plans import inbox as I

DAY = date(2024, 5, 1)
PARTIES = [(1, "Muster GmbH", "supplier", None), (2, "Nord AG", "supplier", None), (3, "Eilig Inkasso", "collection_agency", 1), (4, "Lose Inkasso", "collection_agency", None)]
CLAIM = "notice_id long, invoice_id long, principal_cents long, fees_cents long, interest_cents long, flat_fee_cents long, other_costs_cents long, total_cents long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def parties(spark):
    return frame(spark, PARTIES, "party_id long, name string, role string, represents_id long")


def invoices(spark):
    return frame(spark, [(11, 1, "RE-11", DAY, DAY, 100, 5, 50), (12, 1, "RE-12", DAY, DAY, 200, 5, None), (21, 2, "N-21", DAY, None, 300, None, None)],
                 "invoice_id long, supplier_id long, invoice_number string, invoice_date date, due_date date, gross_cents long, company_id int, hotel_id int")


def test_case_status(spark):
    rows = [("paid", c) for c in ("open", "waiting", "in_dispute", "paid", "closed")] + [("cancelled", "open"), ("disputed", "closed"), ("open", "paid"), ("open", "in_dispute"), ("open", "waiting"), ("open", "closed")]
    got = frame(spark, [(k, *r) for k, r in enumerate(rows)], "k int, i string, c string").select("k", P.case_status(F.col("i"), F.col("c")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == ["paid", "paid", "paid", "paid", "closed", "paid", "in_dispute", "open", "open", "waiting", "closed"]


def test_notices(spark):
    letter = lambda k, sender, supplier=None, level=1, total=0: (k, sender, supplier, DAY, level, None, total)
    drafts = frame(spark, [letter(1, 3), letter(2, 3), letter(3, 4), letter(4, 2), letter(5, 1), letter(6, 1, level=2), letter(7, 9), letter(8, 1, level=3), letter(9, 4, 1)],
                   "notice_id long, sender_id long, supplier_id long, notice_date date, level int, new_deadline date, total_claimed_cents long")
    claim = lambda n, i, fees, total=0: (n, i, 100, fees, 0, 0, 0, total)
    claims = frame(spark, [claim(1, 11, 5), claim(1, 12, 7), claim(2, 12, 7), claim(2, 11, 5), claim(3, 11, 1), claim(4, 11, 1), claim(6, 11, 9), claim(6, 11, 9), claim(7, 11, 1), claim(8, 11, 3, 400), claim(9, 12, 20)], CLAIM)
    none = frame(spark, [], "dedup_key string")
    planned = C.book_notices(drafts, claims, parties(spark), invoices(spark), none)
    got = {r.notice_id: r for r in planned.collect()}
    assert {k: r.error for k, r in got.items()} == {1: None, 2: "DUPLICATE", 3: "REPRESENTS_NOBODY", 4: "OTHER_SUPPLIER", 5: "NO_CLAIM", 6: "INVOICE_TWICE", 7: "UNKNOWN_SENDER", 8: None, 9: None}
    assert (got[1].supplier_id, got[1].principal_cents, got[1].fees_cents, got[1].total_claimed_cents, got[8].total_claimed_cents) == (1, 200, 12, 212, 400)
    again = C.book_notices(drafts, claims, parties(spark), invoices(spark), planned.where("notice_id = 1").select("dedup_key"))
    assert {r.notice_id: r.error for r in again.where("notice_id in (1, 8)").collect()} == {1: "DUPLICATE", 8: None}
    booked = frame(spark, [(11, "DUNNING_FEE", 4), (11, "LATE_INTEREST", 9)], "invoice_id long, category string, booked_cents long")
    posted = {(r.notice_id, r.invoice_id): (r.posted_cents, r.lower_cents, r.entry_date) for r in C.notice_postings(planned, claims, booked).collect()}
    assert posted == {(1, 11): (1, 0, DAY), (1, 12): (7, 0, DAY), (8, 11): (0, 2, DAY), (9, 12): (13, 0, DAY)}
    cases = frame(spark, [(5, 12)], "case_id long, invoice_id long")
    assert [tuple(r) for r in C.cases_to_open(planned, claims, cases).collect()] == [(11, DAY)]
    letters = planned.select("notice_id", F.lit(1).alias("supplier_id"), F.lit(1).cast("long").alias("sender_id"))
    asked = frame(spark, [(1, 1), (2, 3), (3, 4), (4, 2), (5, 99), (77, 1)], "notice_id long, new_sender_id long")
    assert {r.notice_id: (r.changed, r.error) for r in C.change_senders(asked, letters, parties(spark)).collect()} == {
        1: (False, None), 2: (True, None), 3: (False, "REPRESENTS_OTHER"), 4: (False, "OTHER_SUPPLIER"), 5: (False, "UNKNOWN_SENDER"), 77: (False, "UNKNOWN_NOTICE")
    }
    assert {(r.notice_id, r.party_id) for r in I.possible_senders(letters.where("notice_id = 1"), parties(spark)).collect()} == {(1, 1), (1, 3)}


def test_due_dates_leave_a_trail(spark):
    asked = frame(spark, [(11, date(2024, 6, 1)), (12, date(2024, 4, 1)), (21, date(2024, 7, 1)), (99, DAY)], "invoice_id long, due_date date")
    changes = C.change_due_dates(asked, invoices(spark))
    assert {r.invoice_id: (r.changed, r.error) for r in changes.collect()} == {11: (True, None), 12: (False, "DUE_BEFORE_DATE"), 21: (True, None), 99: (False, "UNKNOWN_INVOICE")}
    log = C.audit(changes, "due_date", "invoice", "invoice_id", C.from_to(), F.lit(datetime(2024, 5, 2)))
    assert {(r.entity_id, r.details) for r in log.collect()} == {(11, "01.05.2024 -> 01.06.2024"), (21, "– -> 01.07.2024")}
    events = C.case_events(changes.where("changed"), frame(spark, [(5, 11)], "case_id long, invoice_id long"), "due_date", C.from_to(), DAY)
    assert [(r.case_id, r.kind) for r in events.collect()] == [(5, "due_date")]
    moved = C.change_deadlines(frame(spark, [(1, DAY), (2, DAY), (3, DAY)], "notice_id long, deadline date"), frame(spark, [(1, None), (2, DAY)], "notice_id long, new_deadline date"))
    assert {r.notice_id: (r.changed, r.error) for r in moved.collect()} == {1: (True, None), 2: (False, None), 3: (False, "UNKNOWN_NOTICE")}


def test_what_is_learned(spark):
    ibans = frame(spark, [(2, "DE02120300000000202051")], "party_id long, iban string")
    printed = frame(spark, [(1, "DE89 3704 0044 0532 0130 00"), (1, "DE02120300000000202051"), (1, "DE11"), (1, "GB82WEST12345698765432"), (2, "GB82WEST12345698765432"), (2, None)], "party_id long, iban string")
    assert [tuple(r) for r in C.free_ibans(printed, ibans).collect()] == [(1, "DE89370400440532013000")]
    named = frame(spark, [(1, "MUSTER"), (1, "Muster Gebäudereinigung Süd"), (1, "Nord AG"), (1, " "), (2, None)], "party_id long, name string")
    none = frame(spark, [], "party_id long, alias string")
    assert {tuple(r) for r in C.new_aliases(named, parties(spark), none).collect()} == {(1, "Muster Gebäudereinigung Süd")}
    p = frame(spark, [(1, "", "a@b.de"), (2, "DE1", None)], "party_id long, vat_id string, email string")
    said = frame(spark, [(1, "DE2", "c@d.de"), (2, "DE3", "e@f.de")], "party_id long, vat_id string, email string")
    assert {tuple(r) for r in C.fill_parties(p, said, "vat_id", "email").collect()} == {(1, "DE2", "a@b.de"), (2, "DE1", "e@f.de")}


def test_documents_and_claims(spark):
    docs = frame(spark, [(k, s, p, "") for k, s, p in ((1, "pending", False), (2, "needs_review", False), (3, "accepted", False), (4, "accepted", True), (5, "pending", False))], "doc_id long, review_status string, assignment_pending boolean, pending_json string")
    asked = frame(spark, [(1, "confirm", "invoice", [], False, ""), (2, "confirm", "notice", [], True, "{x}"), (3, "confirm", "none", [], False, ""), (4, "confirm", "notice", [11], False, ""), (5, "confirm", "credit", None, False, ""), (9, "reject", "none", [], False, "")],
                  "doc_id long, action string, kind string, invoice_ids array<long>, allow_unassigned boolean, review_json string")
    got = {r.doc_id: (r.review_status, r.assignment_pending, r.pending_json, r.books, r.error) for r in C.decide_documents(asked, docs).collect()}
    assert got == {1: ("accepted", False, "", True, None), 2: ("accepted", True, "{x}", False, None), 3: ("accepted", False, "", False, "ACCEPTED"), 4: ("accepted", False, "", True, None), 5: ("pending", False, "", False, "NO_INVOICE"), 9: (None, None, None, False, "UNKNOWN_DOCUMENT")}
    keys = ("principal", "fees", "interest", "flat_fee", "collection_costs", "court_costs", "already_paid", "total_claimed", "remaining")
    rows = [(1, 1000, 50, None, None, None, None, 300, 1050, None), (2, 1000, 50, None, None, None, None, 300, None, 750), (3, None, 50, None, None, None, None, None, 1050, None), (4, 1000, 50, None, None, None, None, None, None, None)]
    f = frame(spark, rows, "k int, " + ", ".join(f"{k}_cents long" for k in keys))
    assert {r.k: (r.principal_cents, r.charges_cents, r.claim_cents) for r in C.notice_claims(f).collect()} == {1: (700, 50, 750), 2: (700, 50, 750), 3: (1000, 50, 1050), 4: (1000, 50, 1050)}


def test_pages(spark):
    docs = frame(spark, [(1, "pending", None), (2, "accepted", True), (3, "accepted", None), (4, "rejected", False)], "doc_id long, review_status string, assignment_pending boolean")
    assert {m: [r.doc_id for r in I.documents_page(docs, m).orderBy("doc_id").collect()] for m in ("review", "unassigned", "accepted", "rejected", "all")} == {"review": [1], "unassigned": [2], "accepted": [3], "rejected": [4], "all": [1, 2, 3, 4]}
    lines = frame(spark, [("a", "x", "new", DAY), ("a", "y", "matched", DAY), ("b", "x", "new", date(2024, 5, 3))], "path string, fingerprint string, status string, booking_date date")
    got = {r.path: (r.n_lines, r.n_new, r.n_known, r.n_matched, r.date_to) for r in I.import_summary(lines, frame(spark, [("x",)], "fingerprint string")).collect()}
    assert got == {"a": (2, 1, 1, 1, DAY), "b": (1, 0, 1, 0, date(2024, 5, 3)), None: (3, 1, 2, 1, date(2024, 5, 3))}
    chosen = I.chosen_total(frame(spark, [(1, -300, [11, 12]), (2, -5, [11]), (3, -5, [])], "tx_id long, amount_cents long, invoice_ids array<long>"), frame(spark, [(11, 100), (12, 200)], "invoice_id long, balance_cents long"))
    assert {tuple(r) for r in chosen.collect()} == {(1, 300, True), (2, 100, False), (3, 0, False)}
    log = frame(spark, [(k, datetime(2024, 5, 1, 8, k), "create" if k % 2 else "login", "invoice", k, "") for k in range(50)], "id long, created_at timestamp, action string, entity string, entity_id long, details string")
    assert [r.id for r in I.activity(log, 3).collect()] == [49, 47, 45]
    hotels, companies = frame(spark, [(5, 50, "Seehof"), (5, 51, "Haus am Park")], "company_id int, hotel_id int, name string"), frame(spark, [(5, "Park Holding")], "company_id int, name string")
    texts = frame(spark, [(1, "An: Seehof, Herrn X"), (2, "Park Holding GmbH"), (3, "Seehofstr. 5"), (4, None), (5, "Haus am Park\nund Seehof")], "doc_id long, text string")
    assert {tuple(r) for r in I.scope_in_text(texts, hotels, companies).collect()} == {(1, 5, 50), (2, 5, None), (3, None, None), (4, None, None), (5, 5, 50)}


def test_search_everywhere(spark):
    cases = frame(spark, [(5, 11), (6, 21)], "case_id long, invoice_id long")
    refs = frame(spark, [("case", 6, "AZ 4711"), ("document", 9, "AZ/4711"), ("invoice", 12, "47110")], "owner_kind string, owner_id long, value string")
    pays, parts = frame(spark, [(1, 4711)], "payment_id long, amount_cents long"), frame(spark, [(1, 11)], "payment_id long, invoice_id long")
    docs = frame(spark, [(9, "AZ 4711"), (8, "Muster sagt"), (7, None)], "doc_id long, text string")
    search = lambda q: {(r.kind, r.id): r.reason for r in S.everything(q, parties(spark), invoices(spark), pays, parts, refs, cases, S.inverted_index(docs)).collect()}
    assert search("4711") == {("invoice", 12): "REFERENCE", ("invoice", 21): "REFERENCE", ("case", 6): "REFERENCE", ("document", 9): "REFERENCE"}
    assert search("47,11") == {("invoice", 11): "PAYMENT", ("case", 5): "PAYMENT", ("invoice", 12): "REFERENCE", ("invoice", 21): "REFERENCE", ("case", 6): "REFERENCE", ("document", 9): "REFERENCE"}
    assert search("muster") == {("supplier", 1): "NAME", ("invoice", 11): "NAME", ("invoice", 12): "NAME", ("case", 5): "NAME", ("document", 8): "TEXT"}
    assert search("   ") == {}
