"""Recognition of business documents: kind, labelled amounts, dates and references, issues, and links to invoices.

Everything is column functions on a text column, so it runs where the texts are; nothing but the found values moves.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.functions.dates import parse_any_date
from skonto.functions.money import parse_amount, percent_of
from skonto.functions.text import find_iban, normalize_reference, once
from skonto.operators import document_rules as R
from skonto.operators.layouts import complete_fields, read_layouts
from skonto.operators.needles import may_match

#: Patterns see lines and know letters beyond ASCII. On lower-cased texts they need not ignore case, which is much faster.
LINES, FLAGS = "(?mU)", "(?imuU)"
#: What every amount holds.
HAS_AMOUNT = r"(?U)\d[.,]\d{2}"
DUNNING_KINDS = ("payment_reminder", "first_dunning", "second_dunning", "final_dunning", "collection_letter", "court_order")
OTHER = "other"


def class_scores(text: Column) -> Column:
    """Of a lower-cased text an array of structs (score, kind): the weights of all patterns that occur, half as much again if among the first lines."""
    title = F.substring_index(text, "\n", R.TITLE_LINES)

    def score(patterns: tuple[tuple[str, float], ...]) -> Column:
        hit = lambda rx, w: F.when(may_match(text, rx.lower()) & text.rlike(LINES + rx.lower()), F.when(title.rlike(LINES + rx.lower()), w * R.TITLE_BONUS).otherwise(float(w))).otherwise(0.0)
        return reduce(lambda a, b: a + b, [hit(rx, w) for rx, w in patterns])

    return F.array(*[F.struct(score(p).alias("score"), F.lit(-k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, p) in enumerate(R.CLASSES.items())])


def classify(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``kind`` and ``kind_confidence``; ties go to the kind that is listed first."""
    # a step of its own for the lower-cased text, so that it is made once
    once = documents.select("*", F.explode(F.array(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("_low"))
    ranked = once.withColumn("_scores", F.sort_array(class_scores(F.col("_low")), asc=False))
    top, second = F.col("_scores")[0]["score"], F.col("_scores")[1]["score"]
    margin = (top - second) / F.greatest(top * 0.6, F.lit(1.0))
    confidence = F.round(F.least(F.lit(1.0), top / 6.0) * (0.55 + 0.45 * F.least(F.lit(1.0), margin)), 3)
    none = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", 0.0).otherwise(0.2)
    return ranked.select(
        *documents.columns, F.when(top < 2.0, OTHER).otherwise(F.col("_scores")[0]["kind"]).alias("kind"), F.when(top < 2.0, none).otherwise(confidence).alias("kind_confidence")
    )


def _label(labels: str, flags: str = LINES) -> str:
    return rf"{flags}(?<![a-zäöüß])(?:{labels})(?![a-zäöüß])"


def labelled_amount(text: Column, labels: str) -> Column:
    """Cents of the first amount after a label in a lower-cased text, on its line or at the beginning of the next."""
    same = rf"{_label(labels)}[^\n]{{0,90}}?(?<![\w.,'’])({R.AMOUNT})(?!\d)(?![.,]\d)"
    below = rf"{_label(labels)}[^\n\d]*\n[ \t]{{0,12}}({R.AMOUNT})(?!\d)(?![.,]\d)"
    found = once(F.regexp_extract(text, same, 1), lambda x: F.when(x != "", x).otherwise(F.regexp_extract(text, below, 1)))
    return F.when(may_match(text, labels) & text.rlike(HAS_AMOUNT), once(F.regexp_replace(found, "[ ’]", ""), parse_amount))


def summed_amount(text: Column, labels: str) -> Column:
    """The sum of the amounts after all occurrences of a label; null without any."""
    hits = F.regexp_extract_all(text, F.lit(rf"{_label(labels)}[^\n]{{0,90}}?(?<![\w.,'’])({R.AMOUNT})(?!\d)(?![.,]\d)"), F.lit(1))
    cents = F.transform(hits, lambda x: once(F.regexp_replace(x, "[ ’]", ""), parse_amount))
    total = once(cents, lambda every: F.when(F.size(every) > 0, F.aggregate(every, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))))
    return F.when(may_match(text, labels) & text.rlike(HAS_AMOUNT), total)


def labelled_date(text: Column, labels: str) -> Column:
    """The first date after a label, on its line or the next."""
    found = F.regexp_extract(text, rf"{_label(labels)}[^\n\d]{{0,70}}\n?[^\n\d]{{0,20}}?(?<![\w.,/\-])({R.DATE})(?![\d/\-])", 1)
    return F.when(may_match(text, labels), once(found, lambda x: F.when(x != "", parse_any_date(x))))


def extract_fields(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with amounts in cents, dates, invoice number, IBAN and VAT rate as far as labels name them."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.col("_low")
    amounts = [(summed_amount(low, rx) if k == "fees" else labelled_amount(low, rx)).alias(f"{k}_cents") for k, rx in R.AMOUNTS.items()]
    dates = [labelled_date(low, rx).alias(f"{k}_date") for k, rx in R.DATES.items()]
    number = F.regexp_extract(t, rf"{_label(R.INVOICE_NUMBER, FLAGS)}\s*[:#.]?[ \t]*((?=[\w\-/.]*\d)[\w\-/.]{{2,32}})", 1)
    # letters that are i or s to a pattern that ignores case, but not when lower-cased
    told = once(F.translate(low, "ſı\u0307", "si"), lambda x: may_match(x, R.INVOICE_NUMBER))
    number = F.when(told, number).otherwise("")
    rate = F.regexp_extract(t, rf"{FLAGS}(\d{{1,2}}(?:[.,]\d+)?)\s*%\s*(?:mwst|ust|mehrwertsteuer|umsatzsteuer|vat)", 1)
    filled = lambda x: F.nullif(x, F.lit(""))
    return documents.select("*", F.explode(F.array(F.lower(t))).alias("_low")).select(
        *documents.columns, *amounts, *dates, once(F.regexp_replace(number, "[.\\-/]+$", ""), filled).alias("invoice_number"), once(find_iban(t), filled).alias("iban"),
        F.when(F.contains(t, F.lit("%")), F.replace(rate, F.lit(","), F.lit(".")).try_cast("decimal(9,4)")).alias("vat_rate"),
    )


def complete_amounts(fields: DataFrame) -> DataFrame:
    """Net, VAT and gross of invoices: one that is missing is derived from the others and told in ``derived``."""
    net, vat, gross = (F.col(f"{k}_cents") for k in ("net", "vat", "gross"))
    rate_net = F.round(gross.cast("decimal(24,4)") * 100 / (F.col("vat_rate") + 100), 0).cast("bigint")
    new_net = F.coalesce(net, gross - vat, rate_net)
    new_gross = F.coalesce(gross, net + vat, net + percent_of(net, F.col("vat_rate")))
    new_vat = F.coalesce(vat, new_gross - new_net)
    told = F.array_join(F.array_compact(F.array(*[F.when(a.isNull() & b.isNotNull(), n) for a, b, n in ((net, new_net, "net"), (vat, new_vat, "vat"), (gross, new_gross, "gross"))])), ",")
    return fields.withColumns({"net_cents": new_net, "vat_cents": new_vat, "gross_cents": new_gross, "derived": told})


def issues(fields: DataFrame, today: date) -> DataFrame:
    """``fields`` with ``issues``: codes of what is missing or does not agree."""
    kind = F.col("kind")
    invoice, dunning = kind.isin("invoice", "credit_note"), kind.isin(*DUNNING_KINDS)
    c = {k: F.col(f"{k}_cents") for k in R.AMOUNTS}
    parts = reduce(lambda a, b: a + b, [F.coalesce(c[k], F.lit(0)) for k in ("principal", "fees", "interest", "flat_fee", "collection_costs", "court_costs")])
    day, due = F.col("document_date"), F.col("due_date")
    checks = (
        ("NET_VAT_GROSS", invoice & (F.abs(c["net"] + c["vat"] - c["gross"]) > 1)),
        ("VAT_RATE", invoice & (F.abs(percent_of(c["net"], F.col("vat_rate")) - c["vat"]) > 2)),
        ("AMOUNT_DERIVED", invoice & (F.col("derived") != "")),
        ("MISSING_AMOUNT", (invoice & c["gross"].isNull()) | (dunning & c["total_claimed"].isNull() & c["remaining"].isNull()) | ((kind == "bank_statement") & c["payment_amount"].isNull())),
        ("MISSING_NUMBER", (kind == "invoice") & F.col("invoice_number").isNull()),
        ("CLAIM_SUM", dunning & (parts != 0) & (F.abs(parts - c["total_claimed"]) > 1)),
        ("REMAINING_SUM", dunning & (F.abs(c["total_claimed"] - c["already_paid"] - c["remaining"]) > 1)),
        ("DATE_FUTURE", day > F.date_add(F.lit(today), 7)),
        ("DATE_OLD", F.year(day) < 1990),
        ("DUE_BEFORE_DATE", invoice & (due < day)),
        ("DEADLINE_BEFORE_DATE", dunning & (due < day)),
        ("MISSING_DATE", day.isNull() & ~kind.isin(OTHER, "delivery_note")),
    )
    return fields.withColumn("issues", F.array_join(F.array_compact(F.array(*[F.when(cond, code) for code, cond in checks])), ","))


def analyse(documents: DataFrame, today: date, text: str = "text", doc_id: str | None = None) -> DataFrame:
    """Kind, fields and issues of every document, and how sure all that is.

    With a ``doc_id`` values below their labels count too, and amounts that add up.
    """
    fields = extract_fields(classify(documents, text), text) if doc_id is None else complete_fields(extract_fields(read_layouts(classify(documents, text), text), text))
    out = issues(complete_amounts(fields), today)
    wanted = F.when(F.col("kind").isin("invoice", "credit_note"), F.array(*[F.col(c).isNotNull() for c in ("gross_cents", "document_date", "invoice_number")])).otherwise(
        F.array(*[F.col(c).isNotNull() for c in ("total_claimed_cents", "document_date")])
    )
    coverage = F.size(F.filter(wanted, lambda x: x)) / F.size(wanted)
    n = F.when(F.col("issues") == "", 0).otherwise(F.size(F.split("issues", ",")))
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.0), 0.4 * F.col("kind_confidence") + 0.35 * coverage + 0.25 - 0.12 * n), 3))
