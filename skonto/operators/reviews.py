"""What the recognition says about a document as one nested value, the proposal made of it for review, and both as JSON.

An analysis gathers fields, sender, references and links of a document, adds the issues that need more than its fields, and
rates the whole. A proposal is a projection of the analysis, so it can be made again from a stored one. Both are kept
as JSON with a version; texts of earlier versions are read too.

Defined cases: a document without fields, sender, links or references has them null or empty; text that is no JSON, or of a
later version, is read as null. ``doc_id`` is unique in every table but references and links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.operators.changes import notice_claims
from skonto.operators.document_rules import AMOUNTS
from skonto.operators.documents import DUNNING_KINDS

VERSION = 2
INVOICE, CREDIT, NOTICE, PAYMENT, NONE = "invoice", "credit", "notice", "payment", "none"
# What a kind of document is reviewed as, levels of letters, and what is sure or assumed.
REVIEWED_AS = {"invoice": INVOICE, "credit_note": CREDIT, "bank_statement": PAYMENT, **dict.fromkeys(DUNNING_KINDS, NOTICE)}
LEVELS = {kind: k for k, kind in enumerate(DUNNING_KINDS, start=1)}
SURE, ASSUMED_DUE, ASSUMED_RATE, OTHER_ROLE = 0.75, 0.3, "19", "other"
ERRORS = ("MISSING_AMOUNT", "MISSING_NUMBER", "MISSING_DATE", "NO_LINK", "NO_SUPPLIER")
KIND_SHARE, COVERAGE_SHARE, LINK_SHARE, ERROR_LESS, WARNING_LESS, NO_SENDER, NO_KEYS = 0.4, 0.35, 0.25, 0.12, 0.05, 0.2, 0.5

REFERENCES = "array<struct<ref_type: string, value: string>>"
ANALYSIS = f"""version: int, text_length: int, kind: string, kind_confidence: double, confidence: double,
  fields: struct<document_date: date, due_date: date, payment_date: date, invoice_number: string, vat_rate: decimal(9,4), derived: string>,
  amounts: map<string, bigint>, references: {REFERENCES}, ibans: array<string>, vat_ids: array<string>,
  sender: struct<party_id: bigint, name: string, score: double, supplier_id: bigint, supplier_score: double, creditor_name: string>,
  candidates: array<struct<invoice_id: bigint, score: double, reasons: string, supplier_id: bigint>>, issues: array<string>"""
PROPOSAL = f"""version: int, kind: string, doc_type: string, supplier_id: bigint, supplier_suggested: boolean, sender_id: bigint, sender_suggested: boolean,
  new_sender_name: string, new_sender_role: string, new_supplier_name: string, company_id: int, hotel_id: int, document_date: date, due_date: date,
  invoice_number: string, net_cents: bigint, vat_cents: bigint, gross_cents: bigint, vat_rate: decimal(9,4), invoice_id: bigint, level: int,
  claims: array<struct<invoice_id: bigint, principal_cents: bigint, fees_cents: bigint, interest_cents: bigint, flat_fee_cents: bigint, other_costs_cents: bigint, total_cents: bigint>>,
  total_claimed_cents: bigint, credited_cents: bigint, payment_cents: bigint, payment_invoice_ids: array<bigint>, bank_reference: string, iban: string,
  references: {REFERENCES}, sender_ibans: array<string>, sender_vat_ids: array<string>, messages: array<string>, confidence: map<string, double>"""
#: Version 1 kept references as pairs.
PAIRS = "array<array<string>>"


def _with_pairs(schema: str) -> str:
    return schema.replace(REFERENCES, PAIRS)


def analyses(
    documents: DataFrame, fields: DataFrame, contacts: DataFrame, senders: DataFrame, parties: DataFrame, references: DataFrame, links: DataFrame, invoices: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, analysis): one nested value per document.

    ``fields`` as of ``documents.analyse``, ``contacts`` and ``senders`` as of ``senders``, ``references`` as of ``labels.references``, ``links`` as of
    ``links.link_documents``; ``parties``: party_id, name; ``invoices``: invoice_id, supplier_id.
    """
    of = lambda df, *columns: df.select(F.col(doc_id).alias("doc_id"), *columns)
    told = of(references, "ref_type", "value").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref_type", "value"))).alias("references"))
    linked = of(links, "invoice_id", "score", "reasons", "rank").join(invoices.select("invoice_id", "supplier_id"), "invoice_id", "left")
    linked = linked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "invoice_id", "score", "reasons", "supplier_id"))).alias("found"))
    named = of(senders, "author_id", "score", "supplier_id", "supplier_score", "creditor_name", "new_name").join(parties.select(F.col("party_id").alias("author_id"), F.col("name").alias("author_name")), "author_id", "left")
    sender = F.struct(
        F.col("author_id").alias("party_id"), F.coalesce("author_name", "new_name").alias("name"), F.col("score").cast("double").alias("score"), F.col("supplier_id").cast("bigint").alias("supplier_id"),
        F.col("supplier_score").cast("double").alias("supplier_score"), "creditor_name",
    )
    named = named.select("doc_id", F.when(F.coalesce("author_name", "new_name", "creditor_name").isNotNull() | F.col("supplier_id").isNotNull(), sender).alias("sender"))
    read = of(fields, "kind", "kind_confidence", "document_date", "due_date", "payment_date", "invoice_number", "vat_rate", "derived", "issues", *[f"{k}_cents" for k in AMOUNTS])
    rows = of(documents, F.length(F.coalesce(F.col(text), F.lit(""))).alias("text_length"))
    for part in (read, of(contacts, "ibans", "vat_ids"), named, told, linked):
        rows = rows.join(part, "doc_id", "left")
    candidates = F.transform("found", lambda x: F.struct(x["invoice_id"], x["score"], x["reasons"], x["supplier_id"]))
    empty = lambda c, of: F.coalesce(c, F.array().cast(of))
    amounts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{k}_cents").alias("value")) for k in AMOUNTS]), lambda e: e["value"].isNotNull()))
    rows = rows.withColumns({"candidates": empty(candidates, "array<struct<invoice_id: bigint, score: double, reasons: string, supplier_id: bigint>>"), "amounts": amounts, "kind": F.coalesce("kind", F.lit("other"))})
    dunning, payment = F.col("kind").isin(*DUNNING_KINDS), F.col("kind") == "bank_statement"
    entered = F.exists("candidates", lambda c: (c["supplier_id"] == F.col("sender.supplier_id")) & F.array_contains(F.split(c["reasons"], ","), "NUMBER"))
    lacks = F.array_compact(F.array(
        F.when((F.col("kind") == "invoice") & F.col("invoice_number").isNotNull() & entered, "DUPLICATE_INVOICE"), F.when((dunning | payment) & (F.size("candidates") == 0), "NO_LINK"),
        F.when(dunning & F.col("sender").isNotNull() & F.col("sender.supplier_id").isNull(), "NO_SUPPLIER"),
    ))
    found = F.filter(F.split(F.coalesce("issues", F.lit("")), ","), lambda x: x != "")
    rows = rows.withColumn("issues", F.concat(found, lacks))
    fields_of = F.struct("document_date", "due_date", "payment_date", "invoice_number", "vat_rate", "derived")
    analysis = F.struct(
        F.lit(VERSION).alias("version"), "text_length", "kind", "kind_confidence", rating(rows).alias("confidence"), fields_of.alias("fields"), "amounts", empty(F.col("references"), REFERENCES).alias("references"),
        empty(F.col("ibans"), "array<string>").alias("ibans"), empty(F.col("vat_ids"), "array<string>").alias("vat_ids"), "sender", "candidates", "issues",
    )
    return rows.select("doc_id", analysis.cast(f"struct<{ANALYSIS}>").alias("analysis"))


def rating(rows: DataFrame) -> Column:
    """How sure an analysis is: its kind, the share of the fields that matter to that kind, its link or sender, less for issues."""
    kind, has = rows["kind"], lambda c: F.col(c).isNotNull()
    linked = F.size("candidates") > 0
    amount = lambda *keys: F.coalesce(*[F.try_element_at("amounts", F.lit(k)) for k in keys]).isNotNull()
    keys = {
        ("invoice",): (has("invoice_number"), has("document_date"), amount("gross"), has("sender")),
        ("credit_note",): (has("document_date"), amount("gross"), has("sender")),
        ("bank_statement",): (has("payment_date") | has("document_date"), amount("payment_amount"), linked | has("invoice_number")),
        DUNNING_KINDS: (has("document_date"), amount("total_claimed", "remaining"), linked),
    }
    coverage, of_claims = F.lit(None).cast("double"), kind.isin(*DUNNING_KINDS, "bank_statement")
    for kinds, wanted in keys.items():
        coverage = F.coalesce(coverage, F.when(kind.isin(*kinds), sum((w.cast("int") for w in wanted), F.lit(0)) / len(wanted)))
    best = F.coalesce(F.array_max(F.transform("candidates", lambda c: c["score"])), F.lit(0.0))
    sure = F.when(of_claims, best).otherwise(F.coalesce(F.col("sender.score"), F.lit(NO_SENDER)))
    grave = F.size(F.filter("issues", lambda x: x.isin(*ERRORS)))
    less = ERROR_LESS * grave + WARNING_LESS * (F.size("issues") - grave)
    whole = KIND_SHARE * F.coalesce("kind_confidence", F.lit(0.0)) + COVERAGE_SHARE * F.coalesce(coverage, F.lit(NO_KEYS)) + LINK_SHARE * F.least(F.lit(1.0), sure) - less
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 3)


def proposals(analysed: DataFrame, scopes: DataFrame, payment_days: int = D.PAYMENT_DAYS) -> DataFrame:
    """(doc_id, proposal): what is to be booked for each document, for a user to confirm.

    ``analysed``: doc_id, analysis; ``scopes``: doc_id, company_id, hotel_id, as the document has them or as its text names them. An invoice
    without a due day gets one from its date; a letter, credit note or payment goes to the likeliest invoice and, without a
    supplier of its own, to that invoice's. What is claimed is ``notice_claims``.
    """
    a = lambda path: F.col(f"analysis.{path}")
    cents = lambda k: F.try_element_at(a("amounts"), F.lit(k))
    flat = notice_claims(analysed.select("doc_id", "analysis", *[cents(k).alias(f"{k}_cents") for k in AMOUNTS]))
    rows = flat.join(scopes.select("doc_id", F.col("company_id").cast("int").alias("company_id"), F.col("hotel_id").cast("int").alias("hotel_id")), "doc_id", "left")
    mapped = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    kind = F.coalesce(F.try_element_at(mapped(REVIEWED_AS), a("kind")), F.lit(NONE))
    rows = rows.withColumns({"as": kind, "top": F.get(a("candidates"), F.lit(0)), "s": a("sender")})
    kind, top, s = F.col("as"), F.col("top"), F.col("s")
    bill, notice, payment = kind.isin(INVOICE, CREDIT), kind == NOTICE, kind == PAYMENT
    number, day = a("fields.invoice_number"), F.when(payment, F.coalesce(a("fields.payment_date"), a("fields.document_date"))).otherwise(a("fields.document_date"))
    assumed = (kind == INVOICE) & a("fields.due_date").isNull() & day.isNotNull()
    due = F.when(assumed, F.date_add(day, payment_days)).otherwise(a("fields.due_date"))
    unknown = s.isNotNull() & s["party_id"].isNull() & ~payment
    own_supplier, name = s["supplier_id"], F.coalesce(s["name"], F.lit(""))
    role = F.when(unknown & (a("kind") == "court_order"), OTHER_ROLE).when(unknown & ~a("kind").isin(*DUNNING_KINDS), D.SUPPLIER).otherwise(D.AGENCY)
    new_supplier = (
        F.when(unknown & bill, name).when((kind == INVOICE) & s.isNotNull() & own_supplier.isNull(), name).when(notice & own_supplier.isNull(), F.coalesce(s["creditor_name"], F.lit("")))
        .when(payment & own_supplier.isNull(), F.coalesce(s["creditor_name"], F.lit(""))).otherwise("")
    )
    sure = F.when(s["supplier_id"].eqNullSafe(s["party_id"]) | s["supplier_score"].isNull(), s["score"]).otherwise(s["supplier_score"])
    only = lambda cond, c: F.when(cond, c)
    zero = F.lit(0).cast("bigint")
    part = lambda *keys: sum((F.coalesce(cents(k), zero) for k in keys), zero)
    claim = F.struct(
        top["invoice_id"].alias("invoice_id"), "principal_cents", part("fees").alias("fees_cents"), part("interest").alias("interest_cents"), part("flat_fee").alias("flat_fee_cents"),
        part("collection_costs", "court_costs").alias("other_costs_cents"), F.col("claim_cents").alias("total_cents"),
    )
    known = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("double").alias("value"))
    confidence = F.map_from_entries(F.filter(F.array(
        known("doc_type", a("kind_confidence")), known("sender", s["score"]), known("invoice", top["score"]), known("due_date", F.when(assumed, ASSUMED_DUE)), known("all", a("confidence")),
    ), lambda e: e["value"].isNotNull()))
    proposal = F.struct(
        F.lit(VERSION).alias("version"), kind.alias("kind"), a("kind").alias("doc_type"),
        F.coalesce(own_supplier, only(kind.isin(CREDIT, NOTICE, PAYMENT), top["supplier_id"])).alias("supplier_id"), F.coalesce(own_supplier.isNotNull() & (sure < SURE), F.lit(False)).alias("supplier_suggested"),
        s["party_id"].alias("sender_id"), F.coalesce(s["party_id"].isNotNull() & (s["score"] < SURE), F.lit(False)).alias("sender_suggested"),
        F.when(unknown & ~bill, name).otherwise("").alias("new_sender_name"), role.alias("new_sender_role"), new_supplier.alias("new_supplier_name"), "company_id", "hotel_id",
        day.alias("document_date"), due.alias("due_date"), F.coalesce(number, F.lit("")).alias("invoice_number"), *[only(bill, F.col(f"{k}_cents")).alias(f"{k}_cents") for k in ("net", "vat", "gross")],
        F.coalesce(only(bill, a("fields.vat_rate")), F.lit(ASSUMED_RATE).cast("decimal(9,4)")).alias("vat_rate"), only(kind.isin(CREDIT, NOTICE), top["invoice_id"]).alias("invoice_id"),
        only(notice, F.try_element_at(mapped(LEVELS), a("kind"))).alias("level"), F.filter(F.array(only(notice & top.isNotNull(), claim)), lambda c: c.isNotNull()).alias("claims"),
        F.when(notice, F.col("claim_cents")).otherwise(zero).alias("total_claimed_cents"), F.when(notice, F.col("credited_cents")).otherwise(zero).alias("credited_cents"), only(payment, cents("payment_amount")).alias("payment_cents"),
        F.array_compact(F.array(only(payment, top["invoice_id"]))).alias("payment_invoice_ids"), F.coalesce(only(payment, number), F.lit("")).alias("bank_reference"), F.coalesce(only(payment, F.get(a("ibans"), F.lit(0))), F.lit("")).alias("iban"),
        a("references").alias("references"), a("ibans").alias("sender_ibans"), a("vat_ids").alias("sender_vat_ids"), F.concat(a("issues"), F.array_compact(F.array(F.when(assumed, "DUE_ASSUMED")))).alias("messages"), confidence.alias("confidence"),
    )
    return rows.select("doc_id", proposal.cast(f"struct<{PROPOSAL}>").alias("proposal"))


def as_text(value: Column) -> Column:
    """A nested value as JSON; null stays null."""
    return F.to_json(value)


def confirmed_text(proposal: Column) -> Column:
    """A confirmed proposal as JSON: without messages and confidence, which are made anew when the document is opened."""
    return F.to_json(proposal.dropFields("messages", "confidence"))


def from_text(text: Column, schema: str) -> Column:
    """The nested value (``ANALYSIS`` or ``PROPOSAL``) that JSON of this version or an earlier one holds; null for anything else."""
    version = F.coalesce(F.get_json_object(text, "$.version").try_cast("int"), F.lit(1))
    now = F.from_json(text, f"struct<{schema}>")
    before = F.from_json(text, f"struct<{_with_pairs(schema)}>")
    # pairs become structs and the version is that of now
    pairs = F.transform(before["references"], lambda p: F.struct(F.get(p, F.lit(0)).alias("ref_type"), F.get(p, F.lit(1)).alias("value")))
    raised = before.withField("references", pairs).withField("version", F.lit(VERSION))
    told = F.get_json_object(text, "$.kind").isNotNull()
    return F.when(told & (version == VERSION), now).when(told & (version == 1), raised)
