"""Which invoices a document is about.

Every hint is a row of evidence, found by an equi join: the labelled number, a number in the text, a number as a scanner misreads it, a
known reference of the invoice or its case. Amount and date count for invoices of the document's supplier. No invoice is left
out for being old, and no text for being long.

A misread number is found by canonical letters: O and 0, I, l and 1, S and 5, B and 8 are the same. Every stretch of a text
that is as long as some number and holds two digits among its last six canonical characters is looked up whole, so it meets no
number but its own, however many end alike. What begins or ends within a run of digits, or of letters read for them, is
part of another number; a letter within a word is not read for a number's last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.functions.text import inside_runs, normalize_reference, spaced_reference
from skonto.sources.shared import written

# What each hint weighs, and what is left out.
LABELLED, IN_TEXT, REFERENCE, MISREAD, SAME_SUPPLIER, OTHER_SUPPLIER, AMOUNT, DATE, BALANCE = 0.6, 0.45, 0.5, 0.4, 0.15, -0.3, 0.2, 0.15, 0.15
LEAST, MOST = 0.3, 6
LEAST_TOKEN, LEAST_MISREAD, POSTED = 4, 6, 6
#: A compact text is searched in pieces of so many bytes.
PIECE = 4096
#: A digit, or a letter read for one, that more digits follow, or letters read for them up to the end of the word.
JOINED = "[0-9OILSB](?=[OILSB]{0,40}+[0-9]|[OILSB]{1,40}+(?: |$)|[OILSB]{41})"
#: A letter that could be read for a digit, within a word: a number may follow it but not end with it.
IN_WORD = "[OILSB](?=[0-9A-Z+])"
TOKEN = r"[\p{L}\d][\p{L}\d\-/.]*"


def canonical(number: Column) -> Column:
    """A normalised number with characters that look alike made one."""
    return F.translate(number, "OILSB", "01158")


def numbers_in_texts(documents: DataFrame, numbers: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, invoice_id): invoices (invoice_id, number) whose number is a word of a text."""
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), normalize_reference), lambda w: (F.length(w) >= LEAST_TOKEN) & w.rlike("[0-9]")))
    return documents.select(F.col(doc_id).alias("doc_id"), F.explode(words).alias("number")).join(numbers, "number").select("doc_id", "invoice_id")


def misread_numbers(documents: DataFrame, numbers: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, invoice_id): invoices whose number stands in a text if characters that look alike are one, across blanks and marks."""
    posted = numbers.where(F.length("number") >= LEAST_MISREAD).select("invoice_id", canonical(F.col("number")).alias("key"))
    spaced = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(spaced_reference(F.coalesce(F.col(text), F.lit(""))))).alias("spaced"))
    # byte k of ``runs`` is a + if character k - 1 and the next belong to one run, a - if only no number ends there
    runs = F.concat(F.lit("."), inside_runs(F.regexp_replace(F.regexp_replace("spaced", JOINED, "+"), IN_WORD, "-"))).cast("binary")
    compact = spaced.select("doc_id", F.explode(F.array(F.struct(canonical(F.replace("spaced", F.lit(" "), F.lit(""))).cast("binary").alias("said"), runs.alias("runs")))).alias("x")).select("doc_id", "x.*")
    # the longest number says how far back a stretch has to reach; a text is cut into pieces that overlap by so much, and
    # bytes are cut where they are, so a long text costs no more than its length
    longest = posted.agg(F.coalesce(F.max(F.length("key")), F.lit(POSTED)).alias("longest"), F.array_sort(F.collect_set(F.length("key"))).alias("sizes"))
    able = compact.crossJoin(F.broadcast(longest)).where(F.length("said") >= POSTED)  # one row
    lead = lambda i: F.least(i, F.col("longest") - 1)
    cut = F.transform(F.sequence(F.lit(0), F.length("said") - 1, F.lit(PIECE)), lambda i: F.struct(lead(i).alias("lead"), F.substr("said", i - lead(i) + 1, lead(i) + PIECE).alias("piece"), F.substr("runs", i - lead(i) + 1, lead(i) + PIECE + 1).alias("around")))
    pieces = able.select("doc_id", "sizes", F.inline(cut)).where(F.length("piece") >= POSTED)
    last = lambda k: F.substr("piece", k - POSTED + 1, F.lit(POSTED)).cast("string")
    first = F.greatest(F.lit(POSTED), F.col("lead") + 1)
    mark = lambda c, k: F.substr(c, k, F.lit(1)).cast("string")
    ends = F.when(first <= F.length("piece"), F.filter(F.sequence(first, F.greatest(first, F.length("piece"))), lambda k: ~mark("around", k + 1).isin("+", "-") & last(k).rlike("[0-9].*[0-9]")))
    # what ends at a place is as long as some number, and begins where no run goes on
    begins = lambda k: F.filter("sizes", lambda n: (n <= k) & (mark("around", k - n + 1) != "+"))
    keys = F.flatten(F.transform(ends, lambda k: F.transform(begins(k), lambda n: F.substr("piece", k - n + 1, n).cast("string"))))
    met = pieces.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).join(posted, "key")
    return met.select("doc_id", "invoice_id").distinct()


def link_documents(
    documents: DataFrame, fields: DataFrame, references: DataFrame, invoices: DataFrame, known: DataFrame, cases: DataFrame, balances: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, invoice_id, score, reasons, rank): at most six invoices a document, the likeliest first.

    ``fields``: doc_id, kind, supplier_id, invoice_number, principal_cents, gross_cents, payment_cents, referenced_date;
    ``references``: doc_id, normalized; ``invoices``: invoice_id, supplier_id, invoice_number, gross_cents, invoice_date; ``known``: owner_kind,
    owner_id, normalized; ``cases``: case_id, invoice_id; ``balances``: invoice_id, balance_cents.
    """
    numbers = written(invoices.select("invoice_id", normalize_reference(F.col("invoice_number")).alias("number")), "numbers").where(F.length("number") >= LEAST_TOKEN)
    say = lambda df, weight, reason: df.select("doc_id", "invoice_id", F.lit(float(weight)).alias("weight"), F.lit(reason).alias("reason"))
    labelled = fields.select(F.col(doc_id).alias("doc_id"), normalize_reference(F.col("invoice_number")).alias("number")).join(numbers, "number")
    owners = known.where("owner_kind = 'invoice'").select("normalized", F.col("owner_id").alias("invoice_id")).unionByName(
        known.where("owner_kind = 'case'").join(cases.select(F.col("case_id").alias("owner_id"), "invoice_id"), "owner_id").select("normalized", "invoice_id")
    )
    referred = references.select(F.col(doc_id).alias("doc_id"), "normalized").where(F.length("normalized") >= 3).join(owners, "normalized")
    found = say(labelled, LABELLED, "NUMBER").unionByName(say(numbers_in_texts(documents, numbers, doc_id, text), IN_TEXT, "NUMBER")).groupBy("doc_id", "invoice_id", "reason").agg(F.max("weight").alias("weight"))
    found = written(found, "numbers-found")
    misread = misread_numbers(documents, numbers, doc_id, text).join(found, ["doc_id", "invoice_id"], "left_anti")
    told = found.select("doc_id", "invoice_id", "weight", "reason").unionByName(say(referred.distinct(), REFERENCE, "REFERENCE")).unionByName(say(misread, MISREAD, "MISREAD"))

    f = fields.select(F.col(doc_id).alias("doc_id"), "kind", F.col("supplier_id").alias("own_supplier"), "principal_cents", F.col("gross_cents").alias("own_gross"), "payment_cents", "referenced_date")
    inv = invoices.select("invoice_id", "supplier_id", "gross_cents", "invoice_date")
    # invoices of the supplier that share an amount or a date are candidates without a number
    amounts = f.where("own_supplier is not null").select("doc_id", F.col("own_supplier").alias("supplier_id"), F.explode(F.array_distinct(F.array_compact(F.array("principal_cents", "own_gross")))).alias("gross_cents"))
    dated = f.where("own_supplier is not null and referenced_date is not null").select("doc_id", F.col("own_supplier").alias("supplier_id"), F.col("referenced_date").alias("invoice_date"))
    near = amounts.join(inv, ["supplier_id", "gross_cents"]).select("doc_id", "invoice_id").unionByName(dated.join(inv, ["supplier_id", "invoice_date"]).select("doc_id", "invoice_id"))
    hints = written(told.groupBy("doc_id", "invoice_id").agg(F.sum("weight").alias("sum"), F.array_sort(F.collect_list("reason")).alias("said")), "hints")
    rows = hints.unionByName(near.distinct().join(hints, ["doc_id", "invoice_id"], "left_anti").select("doc_id", "invoice_id", F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("said")))
    rows = rows.join(inv, "invoice_id").join(f, "doc_id")
    if balances is not None:
        rows = rows.join(balances.select("invoice_id", "balance_cents"), "invoice_id", "left")
    same, money = F.col("supplier_id") == F.col("own_supplier"), F.col("gross_cents").isin(F.col("principal_cents"), F.col("own_gross"))
    more = [
        (F.when(same, SAME_SUPPLIER).when(F.col("own_supplier").isNotNull(), OTHER_SUPPLIER), F.when(same, "SUPPLIER").otherwise("OTHER_SUPPLIER")),
        (F.when(F.col("gross_cents").isNotNull() & F.coalesce(money, (F.col("gross_cents") == F.col("principal_cents")), F.col("gross_cents") == F.col("own_gross"), F.lit(False)), AMOUNT), F.lit("AMOUNT")),
        (F.when(F.col("invoice_date") == F.col("referenced_date"), DATE), F.lit("DATE")),
    ]
    if balances is not None:
        more.append((F.when((F.col("kind") == "bank_statement") & (F.col("balance_cents") == F.col("payment_cents")), BALANCE), F.lit("BALANCE")))
    total = F.col("sum")
    for weight, _ in more:
        total = total + F.coalesce(weight, F.lit(0.0))
    reasons = F.array_join(F.concat("said", F.array_compact(F.array(*[F.when(w.isNotNull(), r) for w, r in more]))), ",")
    scored = rows.select("doc_id", "invoice_id", F.round(F.least(F.lit(1.0), total), 3).alias("score"), reasons.alias("reasons")).where(F.col("score") >= LEAST)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "invoice_id"))
    return scored.withColumn("rank", best).where(F.col("rank") <= MOST).withColumnRenamed("doc_id", doc_id)
