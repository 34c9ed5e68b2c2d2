"""Full-text search over documents, and one search over everything that has a name, a number or an amount."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.functions.money import parse_amount
from skonto.functions.text import fold, normalize_iban, normalize_name, normalize_reference


def inverted_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", query: str | None = None) -> DataFrame:
    """(token, doc_id, tf, doc_tokens), to be kept as a table; with ``query`` only of tokens that one of its words begins.

    One exchange, by document and token; a query's words filter each text before anything is moved.
    """
    tokens = F.filter(F.split(fold(F.col(text)), " "), lambda t: t != "")
    words = query_words(query or "")
    asked = F.filter("all", lambda t: reduce(lambda a, b: a | b, [t.startswith(w) for w in words])) if words else F.col("all")
    fenced = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(tokens)).alias("all"))  # tokens are made once
    sized = fenced.select("doc_id", F.size("all").alias("doc_tokens"), F.explode(asked).alias("token"))
    return sized.groupBy("doc_id", "doc_tokens", "token").agg(F.count("*").alias("tf"))


def query_words(query: str) -> list[str]:
    """The folded words of a query."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", query.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


def fulltext(index: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(doc_id, n_hits, score) of documents in which every word of the query begins some token.

    ``score`` weighs hits by how few documents have the word.
    """
    spark = index.sparkSession
    words = query_words(query)
    if not words:
        return spark.createDataFrame([], "doc_id long, n_hits long, score double")
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("word"))
    begins = [F.col("token").startswith(w) for w in words]
    some = begins[0]
    for b in begins[1:]:
        some = some | b
    # the filter on tokens reaches the index before the join
    hits = index.where(some).join(F.broadcast(asked), F.col("token").startswith(F.col("word"))).groupBy("doc_id", "doc_tokens", "word").agg(F.sum("tf").alias("tf"))
    rare = hits.groupBy("word").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(rare), "word").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("tf").alias("n_hits"), F.round(F.sum(F.col("tf") * 2.2 / (F.col("tf") + 1.2) / F.log1p(F.col("df"))), 6).alias("score")
    )
    found = scored.where(F.col("n") == len(set(words))).drop("n")
    return found if limit is None else found.orderBy(F.desc("score"), "doc_id").limit(limit)


def snippet(documents: DataFrame, word: str, text: str = "text", before: int = 40, after: int = 60) -> DataFrame:
    """``documents`` with the surroundings of the first place where a folded word stands."""
    at = F.locate(word, fold(F.col(text)))
    return documents.withColumn("snippet", F.when(at > 0, F.substring(F.col(text), F.greatest(F.lit(1), at - before), F.lit(before + after))))


def everything(
    query: str, parties: DataFrame, invoices: DataFrame, payments: DataFrame | None = None, allocations: DataFrame | None = None, references: DataFrame | None = None,
    cases: DataFrame | None = None, index: DataFrame | None = None, aliases: DataFrame | None = None, ibans: DataFrame | None = None, per_kind: int | None = 50,
) -> DataFrame:
    """(kind, id, reason) of suppliers, invoices, cases and documents that a query names by name, number, reference, amount or words.

    ``payments`` and ``allocations`` lead to the invoices that were paid, ``references`` (owner_kind, owner_id, value) to their owners, a
    case to its invoice, a supplier to its invoices, an invoice to its case; ``index`` is that of ``inverted_index``. The
    first reason counts, of suppliers in the order NAME, IBAN, VAT_ID, of invoices NUMBER, REFERENCE, AMOUNT, PAYMENT and then the
    supplier's. A kind has ``per_kind`` hits, or all of them.
    """
    name, number, cents, iban = normalize_name(F.lit(query)), normalize_reference(F.lit(query)), parse_amount(F.lit(query)), normalize_iban(F.lit(query))
    spark = parties.sparkSession
    hit = lambda df, key, reason, ord_: df.select(F.col(key).cast("bigint").alias("id"), F.lit(reason).alias("reason"), F.lit(ord_).alias("ord"))
    holds = lambda value, least: (F.length(number) > 0) & F.when(F.length(number) >= least, F.contains(normalize_reference(value), number)).otherwise(normalize_reference(value) == number)
    is_name = (F.length(name) > 0) & F.contains(normalize_name(F.col("name")), name)
    of_suppliers = [hit(parties.where(is_name), "party_id", "NAME", 1)]
    if aliases is not None:
        of_suppliers.append(hit(aliases.where((F.length(name) > 0) & F.contains(normalize_name(F.col("alias")), name)), "party_id", "NAME", 1))
    if ibans is not None:
        of_suppliers.append(hit(ibans.where((F.length(iban) >= 15) & (normalize_iban(F.col("iban")) == iban)), "party_id", "IBAN", 2))
    if "vat_id" in parties.columns:
        of_suppliers.append(hit(parties.where((F.length(F.lit(query)) >= 8) & (normalize_iban(F.col("vat_id")) == iban)), "party_id", "VAT_ID", 3))
    suppliers = _first(of_suppliers)

    of_invoices = [hit(invoices.where(holds(F.col("invoice_number"), 3)), "invoice_id", "NUMBER", 4), hit(invoices.where((cents > 0) & (F.col("gross_cents") == cents)), "invoice_id", "AMOUNT", 6)]
    empty = spark.createDataFrame([], "id bigint, reason string, ord int")
    of_cases, of_documents = [empty], [empty]
    if references is not None:
        named = references.where(holds(F.col("value"), 4))
        owned = lambda kind: hit(named.where(F.col("owner_kind") == kind), "owner_id", "REFERENCE", 5)
        of_invoices.append(owned("invoice"))
        of_documents.append(owned("document"))
        if cases is not None:
            of_cases.append(owned("case"))
            of_invoices.append(hit(cases.join(owned("case").select(F.col("id").alias("case_id")), "case_id", "left_semi"), "invoice_id", "REFERENCE", 5))
    if payments is not None and allocations is not None:
        of_invoices.append(hit(allocations.join(payments.where((cents > 0) & (F.col("amount_cents") == cents)).select("payment_id"), "payment_id", "left_semi"), "invoice_id", "PAYMENT", 7))
    of_invoices.append(invoices.join(suppliers.select(F.col("id").alias("supplier_id"), "reason", (F.col("ord") + 10).alias("ord")), "supplier_id").select(F.col("invoice_id").alias("id"), "reason", "ord"))
    found = _first(of_invoices)
    if cases is not None:
        of_cases.append(cases.join(found.select(F.col("id").alias("invoice_id"), "reason", (F.col("ord") + 10).alias("ord")), "invoice_id").select(F.col("case_id").alias("id"), "reason", "ord"))
    if index is not None:
        of_documents.append(hit(fulltext(index, query), "doc_id", "TEXT", 8))
    kinds = (("supplier", suppliers), ("invoice", found), ("case", _first(of_cases)), ("document", _first(of_documents)))
    hits = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in kinds])
    if per_kind is not None:  # a limit of the window, so that each task passes on so many of a kind at most
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("ord", "id"))).where(F.col("rank") <= per_kind)
    return hits.select("kind", "id", "reason")


def _first(hits: list[DataFrame]) -> DataFrame:
    """(id, reason, ord) with the first reason of each id."""
    return reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.min_by("reason", "ord").alias("reason"), F.min("ord").alias("ord"))


def search_in_scope(hits: DataFrame, invoices: DataFrame, cases: DataFrame, documents: DataFrame, company_id: int | None = None, hotel_id: int | None = None) -> DataFrame:
    """Hits that belong to a hotel or company: its invoices, their cases and suppliers, its documents and those nobody has."""
    inside = F.col("hotel_id") == hotel_id if hotel_id is not None else F.col("company_id") == company_id
    its = invoices.where(inside)
    of = lambda df, key, kind: df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"))
    own = (
        of(its, "invoice_id", "invoice").unionByName(of(its, "supplier_id", "supplier")).unionByName(of(cases.join(its.select("invoice_id"), "invoice_id", "left_semi"), "case_id", "case"))
        .unionByName(of(documents.where(inside | F.col("company_id").isNull()), "doc_id", "document"))
    )
    return hits.join(own, ["kind", "id"], "left_semi")


def chosen_parties(parties: DataFrame, aliases: DataFrame, ibans: DataFrame, typed: str) -> DataFrame:
    """The parties (party_id, name, address, ...) that a typed text leaves in a list: it stands in the name, an alias, the address or an IBAN.

    Names and addresses are compared normalised, IBANs without blanks; nothing typed leaves all.
    """
    word, number = normalize_name(F.lit(typed)), normalize_iban(F.lit(typed))
    named = lambda df, c: df.where((F.length(word) > 0) & F.contains(normalize_name(F.coalesce(F.col(c), F.lit(""))), word)).select("party_id")
    by_iban = ibans.where((F.length(number) > 0) & F.contains(normalize_iban(F.col("iban")), number)).select("party_id")
    hits = reduce(DataFrame.unionByName, [named(parties, "name"), named(parties, "address"), named(aliases, "alias"), by_iban]).distinct()
    return parties if not typed.strip() else parties.join(hits, "party_id", "left_semi")
