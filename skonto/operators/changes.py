"""Decisions of users as planners: notices to book, later changes, bank lines, documents, what is learned from them.

As in ``planners``, requests and tables go in and rows come out, each with an ``error`` that is null if the request is to
be carried out. Requests are decided set-based: each sees the tables as they were, and of notices also the notices
before it, in the order of their ids. ``audit`` and ``case_events`` make the trail of what was carried out.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto import domain as D
from skonto.functions.text import normalize_iban, normalize_name, valid_iban
from skonto.operators.bank import existing_payments
from skonto.operators.names import similar_names
from skonto.operators.notices import plan_postings

CLAIM_PARTS = ("principal_cents", "fees_cents", "interest_cents", "flat_fee_cents", "other_costs_cents", "total_cents")
#: A printed name that agrees so far with another party's name is no alias.
OTHER_PARTY = 0.8


def _claimed() -> Column:
    """What a claim comes to: the stated total, or the sum of its parts."""
    return F.when(F.col("total_cents") > 0, F.col("total_cents")).otherwise(sum((F.col(c) for c in CLAIM_PARTS[1:-1]), F.col(CLAIM_PARTS[0])))


def book_notices(drafts: DataFrame, claims: DataFrame, parties: DataFrame, invoices: DataFrame, known_keys: DataFrame) -> DataFrame:
    """(notice_id, supplier_id, sender_id, notice_date, level, new_deadline, principal_cents … total_claimed_cents, dedup_key, error).

    ``drafts``: notice_id, sender_id, supplier_id (or null), notice_date, level, new_deadline, total_claimed_cents (or 0);
    ``claims``: notice_id, invoice_id and the parts; ``known_keys``: dedup_key of notices that are booked. A letter belongs to
    the supplier it names, else to its sender or whom that agency represents. A letter equal to one booked, or to one
    before it, is a duplicate.
    """
    who = parties.select(F.col("party_id").alias("sender_id"), "role", "represents_id")
    owner = F.coalesce("supplier_id", F.when(F.col("role") == D.AGENCY, F.col("represents_id")).when(F.col("role").isNotNull(), F.col("sender_id")))
    letters = drafts.join(who, "sender_id", "left").withColumn("supplier_id", owner)
    of_invoice = invoices.select("invoice_id", F.col("supplier_id").alias("owner_id"))
    told = F.concat_ws(":", "invoice_id", *CLAIM_PARTS)
    summed = (
        claims.join(of_invoice, "invoice_id", "left").join(letters.select("notice_id", "supplier_id"), "notice_id")
        .groupBy("notice_id")
        .agg(
            F.count("*").alias("n"), F.countDistinct("invoice_id").alias("n_invoices"), F.bool_or(~F.col("owner_id").eqNullSafe(F.col("supplier_id"))).alias("strange"),
            *[F.sum(c).alias(c) for c in CLAIM_PARTS[:-1]], F.sum(_claimed()).alias("claimed_cents"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("invoice_id", told.alias("told")))), lambda x: x["told"]), "|").alias("told"),
        )
    )
    key = F.sha2(F.concat_ws("|", "supplier_id", "sender_id", "notice_date", "level", "total_claimed_cents", "told"), 256)
    wrong = (
        F.when(F.col("n").isNull(), "NO_CLAIM").when(F.col("supplier_id").isNull(), F.when(F.col("role").isNull(), "UNKNOWN_SENDER").otherwise("REPRESENTS_NOBODY"))
        .when(F.col("n") > F.col("n_invoices"), "INVOICE_TWICE").when(F.col("strange"), "OTHER_SUPPLIER")
    )
    keyed = letters.join(summed, "notice_id", "left").withColumn("dedup_key", key).withColumn("wrong", wrong)
    booked = known_keys.select("dedup_key", F.lit(True).alias("booked")).distinct()
    first = F.min(F.when(F.col("wrong").isNull(), F.col("notice_id"))).over(Window.partitionBy("dedup_key"))
    error = F.coalesce("wrong", F.when(F.col("booked") | (F.col("notice_id") > F.col("first")), "DUPLICATE"))
    total = F.when(F.col("total_claimed_cents") != 0, F.col("total_claimed_cents")).otherwise(F.col("claimed_cents"))
    return keyed.withColumn("first", first).join(booked, "dedup_key", "left").select(
        "notice_id", "supplier_id", "sender_id", "notice_date", "level", "new_deadline", *CLAIM_PARTS[:-1], total.alias("total_claimed_cents"), "dedup_key", error.alias("error")
    )


def notice_postings(planned: DataFrame, claims: DataFrame, booked: DataFrame) -> DataFrame:
    """(notice_id, invoice_id, supplier_id, entry_date, category, posted_cents, lower_cents) of the notices that are carried out.

    ``booked``: invoice_id, category, booked_cents of charges before; it counts like a claim before all others.
    """
    good = planned.where("error is null").select("notice_id", "supplier_id", F.col("notice_date").alias("entry_date"))
    columns = ["fees_cents", "interest_cents", "flat_fee_cents", "other_costs_cents"]
    kinds = (D.DUNNING_FEE, D.LATE_INTEREST, D.FLAT_FEE, D.COLLECTION_COST)
    before = booked.groupBy("invoice_id").agg(*[F.coalesce(F.sum(F.when(F.col("category") == k, F.col("booked_cents"))), F.lit(0)).alias(c) for c, k in zip(columns, kinds)])
    history = before.select(F.lit(None).cast("bigint").alias("notice_id"), "invoice_id", *columns)  # a null id sorts first
    rows = claims.join(good.select("notice_id"), "notice_id", "left_semi").select("notice_id", "invoice_id", *columns)
    return plan_postings(rows.unionByName(history)).join(good, "notice_id")


def cases_to_open(planned: DataFrame, claims: DataFrame, cases: DataFrame) -> DataFrame:
    """(invoice_id, opened_at): a case for each invoice of a booked notice that has none, opened by the first notice."""
    good = planned.where("error is null").select("notice_id", "notice_date")
    return claims.join(good, "notice_id").join(cases.select("invoice_id"), "invoice_id", "left_anti").groupBy("invoice_id").agg(F.min_by("notice_date", "notice_id").alias("opened_at"))


def change_due_dates(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """(invoice_id, old, new, changed, error) of requests (invoice_id, due_date)."""
    known = invoices.select("invoice_id", "invoice_date", F.col("due_date").alias("old"))
    new = F.col("due_date")
    error = F.when(F.col("invoice_date").isNull(), "UNKNOWN_INVOICE").when(new < F.col("invoice_date"), "DUE_BEFORE_DATE")
    return requests.join(known, "invoice_id", "left").select("invoice_id", "old", new.alias("new"), (error.isNull() & ~new.eqNullSafe(F.col("old"))).alias("changed"), error.alias("error"))


def assign_scopes(requests: DataFrame, invoices: DataFrame, hotels: DataFrame, companies: DataFrame) -> DataFrame:
    """(invoice_id, company_id, hotel_id, error) of requests (invoice_id, company_id, hotel_id): a hotel brings its company."""
    h = hotels.select("hotel_id", F.col("company_id").alias("its_company"))
    c = companies.select("company_id", F.lit(True).alias("known"))
    i = invoices.select("invoice_id", F.lit(True).alias("there"))
    error = (
        F.when(F.col("there").isNull(), "UNKNOWN_INVOICE").when(F.col("hotel_id").isNotNull() & F.col("its_company").isNull(), "UNKNOWN_HOTEL")
        .when(F.col("hotel_id").isNull() & F.col("company_id").isNotNull() & F.col("known").isNull(), "UNKNOWN_COMPANY")
    )
    return (
        requests.join(i, "invoice_id", "left").join(F.broadcast(h), "hotel_id", "left").join(F.broadcast(c), "company_id", "left")  # an organisation's hotels are few
        .select("invoice_id", F.when(F.col("hotel_id").isNotNull(), F.col("its_company")).otherwise(F.col("company_id")).alias("company_id"), "hotel_id", error.alias("error"))
    )


def change_deadlines(requests: DataFrame, notices: DataFrame) -> DataFrame:
    """(notice_id, old, new, changed, error) of requests (notice_id, deadline)."""
    known = notices.select("notice_id", F.col("new_deadline").alias("old"), F.lit(True).alias("there"))
    error = F.when(F.col("there").isNull(), "UNKNOWN_NOTICE")
    return requests.join(known, "notice_id", "left").select("notice_id", "old", F.col("deadline").alias("new"), (error.isNull() & ~F.col("deadline").eqNullSafe(F.col("old"))).alias("changed"), error.alias("error"))


def change_senders(requests: DataFrame, notices: DataFrame, parties: DataFrame) -> DataFrame:
    """(notice_id, old, new, changed, error): who wrote a letter is its supplier or an agency that represents it.

    ``requests``: notice_id, new_sender_id; ``notices``: notice_id, supplier_id, sender_id.
    """
    who = parties.select(F.col("party_id").alias("new_sender_id"), "role", "represents_id")
    same = F.col("sender_id") == F.col("new_sender_id")
    error = (
        F.when(F.col("supplier_id").isNull(), "UNKNOWN_NOTICE").when(same, None).when(F.col("role").isNull(), "UNKNOWN_SENDER")
        .when((F.col("role") == D.AGENCY) & ~F.col("represents_id").eqNullSafe(F.col("supplier_id")), "REPRESENTS_OTHER")
        .when((F.col("role") != D.AGENCY) & (F.col("new_sender_id") != F.col("supplier_id")), "OTHER_SUPPLIER")
    )
    rows = requests.join(notices.select("notice_id", "supplier_id", "sender_id"), "notice_id", "left").join(who, "new_sender_id", "left")
    return rows.select("notice_id", F.col("sender_id").alias("old"), F.col("new_sender_id").alias("new"), (error.isNull() & ~same).alias("changed"), error.alias("error"))


def decide_lines(requests: DataFrame, lines: DataFrame, parties: DataFrame) -> DataFrame:
    """Bank lines after decisions: tx_id, status, supplier_id, invoice_ids, confidence, note, error.

    ``requests``: tx_id, action (assign, ignore, reopen), supplier_id, invoice_ids, note; ``lines``: tx_id, amount_cents, status,
    supplier_id, invoice_ids, confidence, note. Only money that goes out is matched; a reopened line is new until it
    is matched again.
    """
    who = parties.select(F.col("party_id").alias("to_id"), "role")
    asked = requests.select("tx_id", "action", F.col("supplier_id").alias("to_id"), F.col("invoice_ids").alias("to_invoices"), F.col("note").alias("said"))
    assign, ignore, reopen = (F.col("action") == a for a in ("assign", "ignore", "reopen"))
    error = (
        F.when(F.col("status").isNull(), "UNKNOWN_LINE").when(F.col("status") == D.TX_BOOKED, "BOOKED")
        .when(assign & F.col("to_id").isNotNull() & (F.col("role").isNull() | (F.col("role") == D.AGENCY)), "NO_SUPPLIER")
    )
    given = assign & F.col("to_id").isNotNull() & (F.col("amount_cents") < 0)
    status = F.when(ignore, D.TX_IGNORED).when(given, D.TX_MATCHED).otherwise(D.TX_NEW)
    note = F.when(reopen, "").when(ignore, F.coalesce(F.nullif("said", F.lit("")), "note")).otherwise(F.coalesce("said", "note"))
    none = F.array().cast("array<bigint>")
    return asked.join(lines, "tx_id", "left").join(who, "to_id", "left").select(
        "tx_id", F.when(error.isNull(), status).otherwise(F.col("status")).alias("status"), F.when(error.isNull() & assign, F.col("to_id")).otherwise(F.col("supplier_id")).alias("supplier_id"),
        F.when(error.isNull() & assign, F.coalesce("to_invoices", none)).otherwise(F.col("invoice_ids")).alias("invoice_ids"),
        F.when(error.isNull() & assign, F.when(given, 1.0).otherwise(0.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(error.isNull(), note).otherwise(F.col("note")).alias("note"), error.alias("error"),
    )


def book_lines(lines: DataFrame, payments: DataFrame, force: bool = False) -> DataFrame:
    """Payments (tx_id, supplier_id, payment_date, payment_cents, invoice_ids, bank_reference, iban, notes, error) of bank lines.

    ``record_payments`` allocates those without an error. A payment to the same supplier over the same amount within some
    days stands in the way unless forced; ``payments``: payment_id, supplier_id, payment_cents, payment_date.
    """
    there = existing_payments(lines.where("supplier_id is not null"), payments)
    error = (
        F.when(F.col("status") == D.TX_BOOKED, "BOOKED").when(F.col("amount_cents") >= 0, "INCOMING").when(F.col("supplier_id").isNull(), "NO_SUPPLIER")
        .when(F.lit(not force) & F.col("payment_id").isNotNull(), "PAYMENT_EXISTS")
    )
    said = F.array_join(F.array_compact(F.array(F.nullif("counterparty_name", F.lit("")), F.nullif("purpose", F.lit("")))), " – ")
    reference = F.when(F.col("reference") == "NOTPROVIDED", "").otherwise(F.coalesce("reference", F.lit("")))
    return lines.join(there, "tx_id", "left").select(
        "tx_id", "supplier_id", F.col("booking_date").alias("payment_date"), F.abs("amount_cents").alias("payment_cents"), "invoice_ids", reference.alias("bank_reference"),
        F.col("counterparty_iban").alias("iban"), F.substring(said, 1, 300).alias("notes"), error.alias("error"),
    )


def free_ibans(printed: DataFrame, ibans: DataFrame) -> DataFrame:
    """(party_id, iban) to add: valid IBANs (party_id, iban) that no party has yet; one printed for several parties is nobody's."""
    said = printed.select("party_id", normalize_iban(F.col("iban")).alias("iban")).where("iban <> '' and party_id is not null").distinct()
    new = said.where(valid_iban(F.col("iban"))).join(ibans.select(normalize_iban(F.col("iban")).alias("iban")), "iban", "left_anti")
    return new.groupBy("iban").agg(F.min("party_id").alias("party_id"), F.count("*").alias("n")).where("n = 1").select("party_id", "iban")


def new_aliases(printed: DataFrame, parties: DataFrame, aliases: DataFrame) -> DataFrame:
    """(party_id, alias) to add: printed names (party_id, name) that are not known for their party and don't describe another."""
    called = parties.select("party_id", "name").unionByName(aliases.select("party_id", F.col("alias").alias("name"))).select("party_id", normalize_name(F.col("name")).alias("known")).where("known <> ''").distinct()
    said = printed.select("party_id", F.trim("name").alias("alias"), normalize_name(F.col("name")).alias("printed")).where("printed <> '' and party_id is not null")
    first = said.groupBy("party_id", "printed").agg(F.min("alias").alias("alias")).join(called.select("party_id", F.col("known").alias("printed")), ["party_id", "printed"], "left_anti")
    near = similar_names(first.select("printed"), called.select("known"), OTHER_PARTY).select("printed", "known")
    others = first.select("party_id", "printed").join(near, "printed").join(called.withColumnRenamed("party_id", "other_id"), "known").where("other_id <> party_id")
    return first.join(others.select("party_id", "printed"), ["party_id", "printed"], "left_anti").select("party_id", "alias")


def fill_parties(parties: DataFrame, printed: DataFrame, *columns: str) -> DataFrame:
    """``parties`` with empty columns (VAT id, tax number, e-mail …) filled from what documents print; the smallest of several counts."""
    said = printed.groupBy("party_id").agg(*[F.min(F.nullif(F.trim(c), F.lit(""))).alias(f"_{c}") for c in columns])
    filled = parties.join(said, "party_id", "left")
    return filled.select(*[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in parties.columns])


def review_status(confidence: Column, text: Column, errors: Column) -> Column:
    """Of an analysed document: what is unsure, without text or with grave issues needs a review."""
    unsure = (confidence < D.LOW_CONFIDENCE) | (F.trim(F.coalesce(text, F.lit(""))) == "") | errors
    return F.when(F.coalesce(unsure, F.lit(True)), D.REVIEW_NEEDED).otherwise(D.REVIEW_PENDING)


def decide_documents(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents after decisions: doc_id, review_status, assignment_pending, pending_json, books, error.

    ``requests``: doc_id, action (confirm, reject), kind (invoice, credit, notice, payment, none), invoice_ids, allow_unassigned,
    review_json; ``documents``: doc_id, review_status, assignment_pending, pending_json. A letter or credit note
    without an invoice is filed and waits for one if that is allowed; a payment without one becomes a credit.
    ``books`` says whether something is to be booked.
    """
    confirm, kind = F.col("action") == "confirm", F.col("kind")
    done = (F.col("review_status") == D.REVIEW_ACCEPTED) & ~F.coalesce("assignment_pending", F.lit(False))
    missing = kind.isin("notice", "credit", "payment") & (F.coalesce(F.size("invoice_ids"), F.lit(0)) <= 0)
    error = (
        F.when(F.col("review_status").isNull(), "UNKNOWN_DOCUMENT").when(done, "ACCEPTED").when(confirm & ~kind.isin("invoice", "credit", "notice", "payment", "none"), "KIND")
        .when(confirm & missing & ~F.coalesce("allow_unassigned", F.lit(False)), "NO_INVOICE")
    )
    files = confirm & missing & kind.isin("notice", "credit")
    carried = error.isNull()
    return requests.join(documents.select("doc_id", "review_status", "assignment_pending", "pending_json"), "doc_id", "left").select(
        "doc_id", F.when(carried, F.when(confirm, D.REVIEW_ACCEPTED).otherwise(D.REVIEW_REJECTED)).otherwise(F.col("review_status")).alias("review_status"),
        F.when(carried, files).otherwise(F.col("assignment_pending")).alias("assignment_pending"),
        F.when(carried, F.when(files, F.col("review_json")).otherwise("")).otherwise(F.col("pending_json")).alias("pending_json"),
        (carried & confirm & ~files & (kind != "none")).alias("books"), error.alias("error"),
    )


def notice_claims(fields: DataFrame) -> DataFrame:
    """``fields`` of letters with principal_cents, charges_cents, credited_cents and claim_cents as they are to be booked.

    What remains to be paid is the claim; a total that is printed before a deduction is lowered by it, and so is the
    principal if the sender counts that way.
    """
    c = {k: F.coalesce(F.col(f"{k}_cents"), F.lit(0)) for k in ("principal", "fees", "interest", "flat_fee", "collection_costs", "court_costs", "already_paid")}
    charges = c["fees"] + c["interest"] + c["flat_fee"] + c["collection_costs"] + c["court_costs"]
    paid, total, remaining, zero = c["already_paid"], F.col("total_claimed_cents"), F.col("remaining_cents"), F.lit(0)
    before = (paid != 0) & (F.abs(total - (c["principal"] + charges)) <= 1)
    claim = F.when(remaining.isNotNull(), remaining).when(before, F.greatest(zero, total - paid)).otherwise(F.coalesce(total, c["principal"] + charges))
    lowered = (paid != 0) & (c["principal"] != 0) & (F.abs(c["principal"] - paid + charges - claim) <= 1)
    principal = F.when(lowered, c["principal"] - paid).when((c["principal"] == 0) & (claim != 0), F.greatest(zero, claim - charges)).otherwise(c["principal"])
    return fields.withColumns({"principal_cents": principal.cast("bigint"), "charges_cents": charges.cast("bigint"), "credited_cents": paid.cast("bigint"), "claim_cents": claim.cast("bigint")})


def audit(carried_out: DataFrame, action: str, entity: str, key: str, details: Column, at: Column, username: str = "") -> DataFrame:
    """Rows of the audit log (created_at, action, entity, entity_id, details, username) for what was carried out."""
    rows = carried_out.where("error is null") if "error" in carried_out.columns else carried_out
    rows = rows.where("changed") if "changed" in rows.columns else rows
    return rows.select(at.alias("created_at"), F.lit(action).alias("action"), F.lit(entity).alias("entity"), F.col(key).cast("bigint").alias("entity_id"), details.alias("details"), F.lit(username).alias("username"))


def from_to() -> Column:
    """Details of a changed day."""
    day = lambda c: F.coalesce(F.date_format(c, "dd.MM.yyyy"), F.lit("–"))
    return F.concat(day("old"), F.lit(" -> "), day("new"))


def case_events(changes: DataFrame, cases: DataFrame, kind: str, text: Column, day: date) -> DataFrame:
    """(case_id, event_date, kind, text) for changes (invoice_id, …) of invoices that have a case."""
    return changes.join(cases.select("case_id", "invoice_id"), "invoice_id").select("case_id", F.lit(day).alias("event_date"), F.lit(kind).alias("kind"), text.alias("text"))
