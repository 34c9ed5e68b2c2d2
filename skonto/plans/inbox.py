"""What waits for a user: documents to review, documents without an invoice, bank lines, and what has been done lately."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.functions.text import normalize_name, normalize_reference

NOTICE_TYPES = ("payment_reminder", "first_dunning", "second_dunning", "final_dunning", "collection_letter", "court_order")
# Actions that an activity feed tells.
ACTIONS = (
    ("import", "document"), ("confirm", "document"), ("review", "document"), ("create", "invoice"), ("create", "payment"), ("create", "notice"), ("reverse", "payment"),
    ("reverse", "ledger_entry"), ("open_case", "case"), ("case_status", "case"), ("create", "party"), ("cancel", "invoice"), ("apply_credit", "payment"),
)
#: Pages of bank lines and the states they show.
LINE_GROUPS = {"open": (D.TX_NEW, D.TX_MATCHED), "matched": (D.TX_MATCHED,), "new": (D.TX_NEW,), "booked": (D.TX_BOOKED,), "ignored": (D.TX_IGNORED,)}


def activity(log: DataFrame, most: int = 12) -> DataFrame:
    """(id, created_at, action, entity, entity_id, details): the newest told actions among three times as many rows of the log."""
    newest = log.orderBy(F.desc("id")).limit(3 * most)
    told = F.concat_ws(" ", "action", "entity").isin(*[" ".join(a) for a in ACTIONS])
    return newest.where(told).orderBy(F.desc("id")).limit(most).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"), "action", "entity", "entity_id", "details")


def to_review(documents: DataFrame, supplier_id: int | None = None) -> DataFrame:
    """Documents that wait for a review; with a supplier its own and those of nobody."""
    waiting = documents.where(F.col("review_status").isin(D.REVIEW_PENDING, D.REVIEW_NEEDED))
    return waiting if supplier_id is None else waiting.where(F.col("supplier_id").isNull() | (F.col("supplier_id") == supplier_id))


def document_attention(documents: DataFrame, supplier_id: int | None = None, low: float = D.LOW_CONFIDENCE, most: int | None = 8) -> DataFrame:
    """(list, doc_id, doc_type, percent): new notices and unsure documents among those to review, the newest ``most`` of each or all."""
    unsure = (F.col("review_status") == D.REVIEW_NEEDED) | (F.col("confidence") < low)
    lists = F.array_compact(F.array(F.when(F.col("doc_type").isin(*NOTICE_TYPES), "new_notices"), F.when(unsure, "low_confidence")))
    rows = to_review(documents, supplier_id).select(F.explode(lists).alias("list"), "doc_id", "doc_type", F.floor(F.col("confidence") * 100 + 1e-9).cast("int").alias("percent"))
    if most is None:
        return rows
    parts = [rows.where(F.col("list") == k).orderBy(F.desc("doc_id")).limit(most) for k in ("new_notices", "low_confidence")]
    return parts[0].unionByName(parts[1])


def unassigned_documents(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """(doc_id, invoice_id): filed documents without an invoice, with the one that has been entered since, if any.

    ``pending_json`` holds the confirmed proposal; the first of its invoice numbers that an invoice of the supplier has counts.
    """
    waiting = documents.where("assignment_pending").select("doc_id", "supplier_id", F.from_json("pending_json", "references array<struct<ref_type string, value string>>")["references"].alias("refs"))
    named = waiting.select("doc_id", "supplier_id", F.posexplode("refs").alias("pos", "r")).where("r.ref_type = 'invoice_number'").select("doc_id", "supplier_id", "pos", normalize_reference(F.col("r.value")).alias("number"))
    known = invoices.select("supplier_id", "invoice_id", normalize_reference(F.col("invoice_number")).alias("number"))
    hints = named.where("number <> ''").join(known, ["supplier_id", "number"]).groupBy("doc_id").agg(F.min_by("invoice_id", F.struct("pos", "invoice_id")).alias("invoice_id"))
    return waiting.select("doc_id").join(hints, "doc_id", "left")


def documents_page(documents: DataFrame, mode: str) -> DataFrame:
    """Documents as a page shows them: review, unassigned, accepted, rejected, or all."""
    pending = F.coalesce("assignment_pending", F.lit(False))
    modes: dict[str, Column] = {
        "review": F.col("review_status").isin(D.REVIEW_PENDING, D.REVIEW_NEEDED), "unassigned": pending,
        "accepted": (F.col("review_status") == D.REVIEW_ACCEPTED) & ~pending, "rejected": F.col("review_status") == D.REVIEW_REJECTED,
    }
    return documents.where(modes.get(mode, F.lit(True)))


def bank_page(lines: DataFrame, group: str | None = None, account_id: int | None = None, statement_id: int | None = None, supplier_id: int | None = None) -> DataFrame:
    """Bank lines of a group of states, an account, a statement or a supplier."""
    out = lines if group is None else lines.where(F.col("status").isin(*LINE_GROUPS[group]))
    for column, value in (("account_id", account_id), ("statement_id", statement_id), ("supplier_id", supplier_id)):
        out = out if value is None else out.where(F.col(column) == value)
    return out


def bank_waiting(lines: DataFrame) -> DataFrame:
    """One row: lines that wait for a decision, and how many of them have a proposal."""
    return lines.agg(F.count(F.when(F.col("status").isin(*LINE_GROUPS["open"]), 1)).alias("waiting"), F.count(F.when(F.col("status") == D.TX_MATCHED, 1)).alias("matched"))


def import_summary(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(path, n_lines, n_new, n_known, n_matched, date_from, date_to) of imported files; ``path`` is null in the totals.

    ``lines``: path, fingerprint, status, booking_date; ``known``: fingerprint of lines from before.
    """
    seen = known.select("fingerprint", F.lit(True).alias("seen")).distinct()
    rows = lines.join(seen, "fingerprint", "left")
    new = F.col("seen").isNull()
    return rows.rollup("path").agg(
        F.count("*").alias("n_lines"), F.count(F.when(new, 1)).alias("n_new"), F.count(F.when(~new, 1)).alias("n_known"), F.count(F.when(new & (F.col("status") == D.TX_MATCHED), 1)).alias("n_matched"),
        F.min("booking_date").alias("date_from"), F.max("booking_date").alias("date_to"),
    )


def chosen_total(lines: DataFrame, items: DataFrame) -> DataFrame:
    """(tx_id, chosen_cents, exact): what the invoices chosen for a line come to, and whether that is its amount."""
    ids = lines.select("tx_id", F.abs("amount_cents").alias("amount_cents"), F.explode_outer("invoice_ids").alias("invoice_id"))
    sums = ids.join(items.select("invoice_id", "balance_cents"), "invoice_id", "left").groupBy("tx_id", "amount_cents").agg(F.coalesce(F.sum("balance_cents"), F.lit(0)).alias("chosen_cents"))
    return sums.select("tx_id", "chosen_cents", (F.col("chosen_cents") == F.col("amount_cents")).alias("exact"))


def payment_scopes(allocations: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, company_id, hotel_id): what all invoices of a payment have in common, null where they differ or lack it."""
    rows = allocations.join(invoices.select("invoice_id", "company_id", "hotel_id"), "invoice_id")
    common = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    return rows.groupBy("payment_id").agg(common("company_id"), common("hotel_id"))


def booked_charges(entries: DataFrame) -> DataFrame:
    """(invoice_id, category, booked_cents): charges of every invoice, reversals taken off."""
    return entries.where(F.col("invoice_id").isNotNull() & F.col("category").isin(*D.CHARGES)).groupBy("invoice_id", "category").agg(F.sum("amount_cents").alias("booked_cents"))


def scope_in_text(documents: DataFrame, hotels: DataFrame, companies: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, company_id, hotel_id): the first hotel, else the first company, whose name stands in the text word for word.

    Names meet texts by their longest word, so texts are not compared with all names; names of fewer than four letters don't count.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    longest = lambda c: F.array_max(F.transform(words(c), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    h = hotels.select(normalize_name(F.col("name")).alias("known"), F.lit(0).alias("ord"), "company_id", "hotel_id")
    c = companies.select(normalize_name(F.col("name")).alias("known"), F.lit(1).alias("ord"), "company_id", F.lit(None).cast("int").alias("hotel_id"))
    names = h.unionByName(c).where(F.length("known") >= 4).withColumn("word", longest(F.col("known")))
    said = documents.select(F.col(doc_id), normalize_name(F.col(text)).alias("said"))
    whole = F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "known", F.lit(" ")))
    found = said.select(doc_id, "said", F.explode(words(F.col("said"))).alias("word")).join(names, "word").where(whole)
    best = found.groupBy(doc_id).agg(F.min(F.struct("ord", "hotel_id", "company_id")).alias("b"))
    return documents.select(doc_id).join(best, doc_id, "left").select(doc_id, F.col("b.company_id").alias("company_id"), F.col("b.hotel_id").alias("hotel_id"))


def has_items(keys: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """``keys`` with ``has_items``: whether any row of some tables belongs to them."""
    used = tables[0].select(key)
    for other in tables[1:]:
        used = used.unionByName(other.select(key))
    return keys.join(used.where(F.col(key).isNotNull()).distinct().withColumn("has_items", F.lit(True)), key, "left").withColumn("has_items", F.coalesce("has_items", F.lit(False)))


def possible_senders(notices: DataFrame, parties: DataFrame) -> DataFrame:
    """(notice_id, party_id): the supplier of a letter and the agencies that represent it."""
    able = parties.where(F.col("role") != D.AGENCY).select("party_id", F.col("party_id").alias("supplier_id")).unionByName(
        parties.where((F.col("role") == D.AGENCY) & F.col("represents_id").isNotNull()).select("party_id", F.col("represents_id").alias("supplier_id"))
    )
    return notices.select("notice_id", "supplier_id").join(able, "supplier_id").select("notice_id", "party_id")
