"""Bank statements (CSV of many banks, CAMT.053, MT940, text of printed statements) as transactions.

Input is one row for each file: path and content. Files are small, but there may be very many: everything is column
functions over files, and windows that never leave a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.functions.dates import full_year, make_day, parse_day
from skonto.functions.money import parse_cents
from skonto.functions.text import find_iban, normalize_iban

SCHEMA = (
    "path string, line_no int, booking_date date, value_date date, amount_cents bigint, currency string, counterparty_name string, "
    "counterparty_iban string, purpose string, booking_text string, reference string"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]

# The names that banks give to the columns of their CSV files.
HEADERS = {
    "booking": ("buchungstag", "buchungsdatum", "buchung", "datum", "booking date", "date", "bokfoeringsdag"),
    "value": ("valuta", "valutadatum", "wertstellung", "wert", "value date", "wertstellungsdatum"),
    "amount": ("betrag", "betrag (eur)", "betrag in eur", "betrag eur", "umsatz", "amount", "umsatz in eur", "betrag (€)", "betrag in €"),
    "debit": ("soll", "belastung", "ausgang"),
    "credit": ("haben", "gutschrift", "eingang"),
    "name": (
        "beguenstigter/zahlungspflichtiger", "auftraggeber/empfaenger", "name zahlungsbeteiligter", "empfaenger", "auftraggeber", "zahlungsempfaenger",
        "beguenstigter", "name", "beguenstigter / zahlungspflichtiger", "auftraggeber / beguenstigter", "zahlungspflichtiger", "empfaenger/auftraggeber",
        "partner name", "gegenkonto name",
    ),
    "iban": (
        "kontonummer/iban", "iban", "iban zahlungsbeteiligter", "iban/kontonummer", "empfaenger iban", "gegenkonto", "iban gegenkonto", "kontonummer",
        "partner iban", "iban/konto",
    ),
    "purpose": ("verwendungszweck", "zweck", "beschreibung", "mitteilung", "verwendungszweck/mitteilung", "details"),
    "text": ("buchungstext", "buchungsart", "umsatzart", "vorgang", "umsatztext"),
    "reference": ("kundenreferenz (end-to-end)", "end-to-end-referenz", "kundenreferenz", "mandatsreferenz", "referenz"),
    "own": ("auftragskonto", "eigene iban", "konto"),
    "currency": ("waehrung", "währung", "currency"),
    "indicator": ("soll/haben", "s/h", "buchungstyp"),
}
DELIMITERS = (";", "\t", ",", "|")
# Tags in the purpose of SEPA payments.
SEPA_TAGS = "EREF|KREF|MREF|CRED|DEBT|SVWZ|ABWA|ABWE|IBAN|BIC|ANAM|PURP|COAM|OAMT"


# What Windows-1252 has where Latin-1 has control characters, in the order of the bytes, and the bytes that it lacks.
CONTROLS = "".join(chr(k) for k in range(0x80, 0xA0) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
IN_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
NOT_IN_1252 = "\\x81\\x8D\\x8F\\x90\\x9D"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files below a folder, as text: UTF-8 if it is, else Windows-1252, else (for bytes that it lacks) Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    latin = F.decode("content", "ISO-8859-1")
    windows = F.when(~latin.rlike(f"[{NOT_IN_1252}]"), F.translate(latin, CONTROLS, IN_1252))
    text = F.coalesce(utf8, windows, latin)
    return raw.select("path", F.regexp_replace(text, "^﻿", "").alias("content"))


def looks_like_bank_file(path: Column, content: Column) -> Column:
    """The kind of statement (mt940, camt053, csv), or null: from the name and the first 4096 characters."""
    head, name = F.substring(content, 1, 4096), F.lower(path)
    mt = (F.contains(head, F.lit(":20:")) & F.contains(head, F.lit(":61:"))) | F.contains(head, F.lit(":60F:"))
    camt = F.contains(head, F.lit("camt.")) | F.contains(head, F.lit("BkToCstmrStmt"))
    return (
        F.when(name.rlike(r"\.(sta|mt940|940|swi)$") | (name.rlike(r"\.(csv|txt)$") & mt), "mt940")
        .when(name.rlike(r"\.(camt|xml)$") & camt, "camt053")
        .when(name.endswith(".csv"), "csv")
    )


def _plain(cell: Column) -> Column:
    out = F.lower(F.trim(cell))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")), out)


def _cells(line: Column, delimiter: Column) -> Column:
    """The cells of a CSV line; quotes protect delimiters."""
    cut = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        rx = ("\\" + d if d == "|" else d) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
        cut = F.when(delimiter == d, F.split(line, rx)).otherwise(cut)
    return F.transform(cut, lambda c: F.replace(F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")), F.lit('""'), F.lit('"')))


def parse_csv(files: DataFrame) -> DataFrame:
    """Transactions of CSV files; lines without date or amount are left out."""
    lines = F.split("content", "\r\n|\n|\r")
    head = F.array_join(F.slice(lines, 1, 30), "\n")
    counts = F.array(*[F.struct(F.regexp_count(head, F.lit("\\" + d if d == "|" else d)).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)])
    cut = files.select("path", F.array_max(counts)["d"].alias("delimiter"), F.posexplode(lines).alias("line_no", "line")).withColumn("cells", _cells(F.col("line"), F.col("delimiter")))
    plain = F.transform("cells", _plain)
    at = lambda names: F.array_min(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position(plain, n)), lambda p: p > 0)).cast("int")
    mapped = cut.where("line_no < 60").select("path", "line_no", *[at(names).alias(f"at_{k}") for k, names in HEADERS.items()])
    header = (
        mapped.where("at_booking is not null and (at_amount is not null or at_debit is not null or at_credit is not null)")
        .groupBy("path")
        .agg(F.min_by(F.struct("line_no", *[f"at_{k}" for k in HEADERS]), "line_no").alias("h"))
    )
    rows = cut.join(header, "path").where("line_no > h.line_no")
    cell = lambda k: F.coalesce(F.get("cells", F.col(f"h.at_{k}") - 1), F.lit(""))
    debit, credit = parse_cents(cell("debit")), parse_cents(cell("credit"))
    two = F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(credit, F.lit(0)) - F.abs(F.coalesce(debit, F.lit(0))))
    amount = F.coalesce(parse_cents(cell("amount")), two)
    signed = F.when(F.upper(cell("indicator")).isin("S", "SOLL", "D", "DEBIT") & (amount > 0), -amount).otherwise(amount)
    purpose = F.when(cell("purpose") != "", cell("purpose")).otherwise(F.when(F.col("h.at_purpose").isNull(), cell("text")).otherwise(""))
    return rows.select(
        "path", "line_no",
        F.coalesce(parse_day(cell("booking")), parse_day(cell("value"))).alias("booking_date"),
        parse_day(cell("value")).alias("value_date"),
        signed.alias("amount_cents"),
        F.when(cell("currency") == "", "EUR").otherwise(cell("currency")).alias("currency"),
        cell("name").alias("counterparty_name"),
        find_iban(cell("iban")).alias("counterparty_iban"),
        F.trim(F.regexp_replace(purpose, r"\s+", " ")).alias("purpose"),
        F.when(F.col("h.at_purpose").isNull(), "").otherwise(cell("text")).alias("booking_text"),
        cell("reference").alias("reference"),
    ).where("booking_date is not null and amount_cents <> 0")


_PARTY = "struct<Nm:string,Pty:struct<Nm:string>>"
_ACCOUNT = "struct<Id:struct<IBAN:string>>"
_DETAILS = (
    f"struct<Refs:struct<EndToEndId:string>,Amt:string,AmtDtls:struct<TxAmt:struct<Amt:string>>,RltdPties:struct<Cdtr:{_PARTY},CdtrAcct:{_ACCOUNT},Dbtr:{_PARTY},DbtrAcct:{_ACCOUNT}>,"
    "RmtInf:struct<Ustrd:array<string>,Strd:struct<CdtrRefInf:struct<Ref:string>>>>"
)
_ENTRY = (
    "struct<Amt:struct<_VALUE:string,_Ccy:string>,CdtDbtInd:string,BookgDt:struct<Dt:string,DtTm:string>,ValDt:struct<Dt:string>,AddtlNtryInf:string,"
    f"BkTxCd:struct<Prtry:struct<Cd:string>>,NtryDtls:struct<TxDtls:array<{_DETAILS}>>>"
)
CAMT_SCHEMA = (
    "Acct struct<Id:struct<IBAN:string>>, Bal array<struct<Tp:struct<CdOrPrtry:struct<Cd:string>>,Amt:struct<_VALUE:string>,CdtDbtInd:string>>, "
    f"Ntry array<{_ENTRY}>"
)


def read_camt053(spark: SparkSession, path: str) -> DataFrame:
    """Statements of CAMT.053 files, as nested rows."""
    return spark.read.format("xml").option("rowTag", "Stmt").option("ignoreNamespace", "true").schema(CAMT_SCHEMA).load(path).withColumn("path", F.input_file_name())


def camt_balances(statements: DataFrame) -> DataFrame:
    """(path, iban, opening_cents, closing_cents)."""
    signed = lambda b: F.when(b["CdtDbtInd"] == "DBIT", -parse_cents(b["Amt"]["_VALUE"])).otherwise(parse_cents(b["Amt"]["_VALUE"]))
    of = lambda *codes: F.filter("Bal", lambda b: b["Tp"]["CdOrPrtry"]["Cd"].isin(*codes))
    return statements.select(
        "path", normalize_iban(F.col("Acct.Id.IBAN")).alias("iban"), signed(F.get(of("OPBD", "PRCD"), F.lit(0))).alias("opening_cents"), signed(F.try_element_at(of("CLBD", "CLAV"), F.lit(-1))).alias("closing_cents")
    )


def camt_transactions(statements: DataFrame) -> DataFrame:
    """Transactions: one for each detail of an entry, or for the entry itself."""
    entries = statements.select("path", F.posexplode("Ntry").alias("line_no", "e"))
    details = entries.select("path", "line_no", "e", F.size("e.NtryDtls.TxDtls").alias("n"), F.explode_outer("e.NtryDtls.TxDtls").alias("d"))
    out = F.col("e.CdtDbtInd") == "DBIT"
    cents = lambda c: parse_cents(F.replace(c, F.lit(","), F.lit(".")))
    part = F.when(F.col("n") > 1, cents(F.coalesce("d.AmtDtls.TxAmt.Amt", "d.Amt")))
    amount = F.coalesce(F.abs(part), cents(F.col("e.Amt._VALUE")))
    side = lambda a, b: F.when(out, F.col(a)).otherwise(F.col(b))
    name = F.coalesce(side("d.RltdPties.Cdtr.Nm", "d.RltdPties.Dbtr.Nm"), side("d.RltdPties.Cdtr.Pty.Nm", "d.RltdPties.Dbtr.Pty.Nm"), F.lit(""))
    written = F.trim(F.concat_ws(" ", F.array_join(F.transform("d.RmtInf.Ustrd", lambda u: F.trim(F.regexp_replace(u, r"\s+", " "))), " "), F.col("d.RmtInf.Strd.CdtrRefInf.Ref")))
    return details.select(
        "path", "line_no",
        F.coalesce(parse_day(F.coalesce("e.BookgDt.Dt", "e.BookgDt.DtTm")), parse_day(F.col("e.ValDt.Dt"))).alias("booking_date"),
        parse_day(F.col("e.ValDt.Dt")).alias("value_date"),
        F.when(out, -amount).otherwise(amount).alias("amount_cents"),
        F.coalesce("e.Amt._Ccy", F.lit("EUR")).alias("currency"),
        name.alias("counterparty_name"),
        F.coalesce(normalize_iban(side("d.RltdPties.CdtrAcct.Id.IBAN", "d.RltdPties.DbtrAcct.Id.IBAN")), F.lit("")).alias("counterparty_iban"),
        F.when(written == "", F.coalesce("e.AddtlNtryInf", F.lit(""))).otherwise(written).alias("purpose"),
        F.coalesce("e.BkTxCd.Prtry.Cd", "e.AddtlNtryInf", F.lit("")).alias("booking_text"),
        F.coalesce(F.when(F.col("d.Refs.EndToEndId") != "NOTPROVIDED", F.col("d.Refs.EndToEndId")), F.lit("")).alias("reference"),
    ).where("booking_date is not null and amount_cents <> 0")


def sepa_tags(text: Column) -> Column:
    """Map of tag to text; of a tag that repeats the first counts."""
    parts = F.filter(F.split(text, rf"(?=(?:{SEPA_TAGS})\+)"), lambda p: p.rlike(rf"^(?:{SEPA_TAGS})\+"))
    pairs = F.transform(parts, lambda p: F.struct(F.split(p, r"\+", 2)[0].alias("tag"), F.trim(F.split(p, r"\+", 2)[1]).alias("text")))
    first = F.aggregate(pairs, F.array().cast("array<struct<tag:string,text:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["tag"] == p["tag"]), a).otherwise(F.concat(a, F.array(p))))
    return F.map_from_entries(first)


def _joined(parts: Column) -> Column:
    """Sub-fields hold 27 characters: a full one goes on in the next, after a shorter one a blank stands."""
    start = F.struct(F.lit("").alias("text"), F.lit(99).alias("last"))
    return F.aggregate(
        F.filter(parts, lambda p: p != ""), start, lambda a, p: F.struct(F.concat(a["text"], F.when((a["text"] == "") | (a["last"] >= 27), "").otherwise(" "), p).alias("text"), F.length(p).alias("last")), lambda a: a["text"]
    )


def parse_mt940(files: DataFrame) -> DataFrame:
    """Transactions of MT940 files: each ``:61:`` with the ``:86:`` that follows it."""
    text = F.regexp_replace("content", "\r\n|\r", "\n")
    pieces = files.select("path", F.posexplode(F.split(text, r"(?m)^(?=:\d{2}[A-Z]?:)")).alias("line_no", "piece"))
    tagged = pieces.select("path", "line_no", F.regexp_extract("piece", r"^:(\d{2}[A-Z]?):", 1).alias("tag"), F.trim(F.regexp_replace("piece", r"^:\d{2}[A-Z]?:", "")).alias("body"))
    follow = Window.partitionBy("path").orderBy("line_no")
    rows = tagged.where(F.col("tag").isin("61", "86")).withColumn("next_tag", F.lead("tag").over(follow)).withColumn("info", F.when(F.lead("tag").over(follow) == "86", F.lead("body").over(follow))).where("tag = '61'")
    rx = r"(?s)^(\d{6})(\d{4})?(R?[CD])[A-Z]?(\d+,\d*)([A-Z])(\w{3})?(.*)$"
    g = lambda k: F.regexp_extract("body", rx, k)
    year = full_year(F.substring(g(1), 1, 2))
    value = make_day(year, F.substring(g(1), 3, 2), F.substring(g(1), 5, 2))
    same = make_day(year, F.substring(g(2), 1, 2), F.substring(g(2), 3, 2))
    before = make_day(year - 1, F.substring(g(2), 1, 2), F.substring(g(2), 3, 2))
    booking = F.when(g(2) == "", value).when(F.datediff(same, value) > 180, before).otherwise(same)
    amount = parse_cents(F.regexp_replace(g(4), ",$", ",00"))
    negative = g(3).endswith("D") != g(3).startswith("R")
    flat = F.coalesce(F.replace("info", F.lit("\n"), F.lit("")), F.lit(""))
    structured = flat.rlike(r"\?\d{2}")
    field = lambda n: F.regexp_extract(flat, rf"(?s)\?{n}(.*?)(?=\?\d{{2}}|$)", 1)
    told = _joined(F.array(*[field(n) for n in range(20, 30)]))
    tags = sepa_tags(F.when(structured, told).otherwise(flat))
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    purpose = F.coalesce(tag("SVWZ"), F.when(structured, told).otherwise(flat))
    name = F.when(structured, _joined(F.array(field(32), field(33)))).otherwise(F.coalesce(tag("ABWA"), tag("ANAM"), F.lit("")))
    iban31, iban_told = find_iban(F.when(structured, field(31)).otherwise(F.coalesce(tag("IBAN"), F.lit("")))), find_iban(F.when(structured, told).otherwise(flat))
    own = F.regexp_extract(g(7), r"^([^\n]*?)(?://|\n|$)", 1)
    return rows.select(
        "path", "line_no", booking.alias("booking_date"), value.alias("value_date"), F.when(negative, -amount).otherwise(amount).alias("amount_cents"), F.lit("EUR").alias("currency"),
        F.trim(name).alias("counterparty_name"), F.when(iban31 != "", iban31).otherwise(iban_told).alias("counterparty_iban"),
        F.trim(F.regexp_replace(purpose, r"\s+", " ")).alias("purpose"), F.when(structured, F.trim(F.regexp_extract(flat, r"(?s)^(?:\?00)?(.*?)(?=\?\d{2}|$)", 1))).otherwise("").alias("booking_text"),
        F.coalesce(tag("EREF"), F.when(F.trim(own) != "NONREF", F.trim(own)), F.lit("")).alias("reference"),
    ).where("booking_date is not null and amount_cents <> 0")


_PDF_LINE = r"^\s*(\d{2}\.\d{2}\.(?:\d{4}|\d{2})?)\s+(?:(\d{2}\.\d{2}\.(?:\d{4}|\d{2})?)\s+)?(.+?)\s+([+-]?\d{1,3}(?:\.\d{3})*,\d{2}\s?[+\-SH]?)\s*$"


def parse_printed(files: DataFrame) -> DataFrame:
    """Transactions of the text of printed statements: date, text and amount on a line, more text on the lines below."""
    year = F.regexp_extract("content", r"\b(20\d{2})\b", 1)
    lines = files.select("path", year.alias("year"), F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line_no", "line"))
    g = lambda k: F.regexp_extract("line", _PDF_LINE, k)
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.col("line").rlike(_PDF_LINE)
    marked = lines.withColumn("hit", hit).withColumn("grp", F.sum(F.when(F.col("hit") | (F.trim("line") == ""), 1).otherwise(0)).over(upto))
    more = F.trim(F.regexp_replace("line", r"\s+", " "))
    skip = F.col("line").rlike(r"(?i)^\s*(Seite|Kontoauszug|IBAN|BIC|Alter|Neuer)")
    rows = marked.select("path", "year", "line_no", "grp", "hit", *[g(k).alias(n) for k, n in ((1, "d"), (2, "v"), (3, "rest"), (4, "amt"))], F.when(~F.col("hit") & ~skip, more).alias("more"))
    day = lambda c: parse_day(F.when(F.length(c) > 6, F.col(c)).otherwise(F.concat(F.col(c), F.col("year"))))
    grouped = rows.groupBy("path", "grp").agg(
        F.max_by(F.struct("line_no", day("d").alias("booking_date"), day("v").alias("value_date"), parse_cents(F.col("amt")).alias("amount_cents"), "rest"), "hit").alias("t"),
        F.bool_or("hit").alias("any"), F.array_sort(F.collect_list(F.when(F.col("more").isNotNull(), F.struct("line_no", "more")))).alias("more"),
    )
    purpose = F.trim(F.regexp_replace(F.concat_ws(" ", F.col("t.rest"), F.array_join(F.transform("more", lambda m: m["more"]), " ")), r"\s+", " "))
    empty = F.lit("")
    return grouped.where("any").select(
        "path", "t.line_no", "t.booking_date", "t.value_date", "t.amount_cents", F.lit("EUR").alias("currency"), empty.alias("counterparty_name"),
        find_iban(purpose).alias("counterparty_iban"), purpose.alias("purpose"), empty.alias("booking_text"), empty.alias("reference"),
    ).where("booking_date is not null and amount_cents <> 0")
