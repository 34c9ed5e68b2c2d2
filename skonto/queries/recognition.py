"""Letters with known senders and references, printed from the ledger and read again; names and the reader's own names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto.functions.text import normalize_name
from skonto.operators import labels, links, names, senders
from skonto.operators import search as S
from skonto.operators.names import GENERIC
from skonto.queries.base import INVOICES, NOTICES
from skonto.sources import children as CH
from skonto.sources.ledger_tables import LedgerTables
from skonto.sources.shared import new_folder, spread, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function of the tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _pick(key: str, *choices):
    return F.element_at(F.array(*choices), (F.col(key) % len(choices) + 1).cast("int"))


@query(f"""WITH {NOTICES}, r AS (
  SELECT notice_id AS doc_id, unnest([
    {{'ref_type': 'customer_number', 'value': 'KD-' || (10000 + invoice_id)}}, {{'ref_type': 'contract_number', 'value': 'V-' || (100000 + notice_id)}},
    {{'ref_type': 'letter_number', 'value': 'M/' || (1000 + notice_id)}}], recursive := true) FROM notices)
SELECT doc_id, ref_type, value, regexp_replace(value, '[^0-9A-Z]', '', 'g') AS normalized FROM r""")
def document_references(t: LedgerTables) -> DataFrame:
    """References of a letter about every notice, printed in one of four layouts, read by their labels."""
    told = (
        (_pick("notice_id", *map(F.lit, ("Kundennummer", "Kunden-Nr.", "Kd.-Nr.", "Kunden nummer", "Ihre Kundennummer"))), F.concat(F.lit("KD-"), (10_000 + F.col("invoice_id")).cast("string"))),
        (_pick("notice_id", *map(F.lit, ("Vertragsnummer", "Vertrags-Nr.", "Mietvertrag Nr."))), F.concat(F.lit("V-"), (100_000 + F.col("notice_id")).cast("string"))),
        (F.lit("Schreibennummer"), F.concat(F.lit("M/"), (1000 + F.col("notice_id")).cast("string"))),
    )
    behind = F.concat_ws("\n", *[F.concat(label, F.lit(": "), v) for label, v in told])
    beside = F.concat_ws("      ", *[F.concat(label, F.lit(": "), v) for label, v in told])
    below = F.concat_ws("\n", *[x for label, v in told for x in (F.concat(label, F.lit(":")), v)])
    table = F.concat_ws("\n", F.concat_ws("   ", *[label for label, _ in told]), F.concat_ws("   ", *[v for _, v in told]))
    text = F.concat(F.lit("Muster GmbH\n\nMahnung\nDatum: "), F.date_format("notice_date", "dd.MM.yyyy"), F.lit("\n"), _pick("notice_id", behind, beside, below, table), F.lit("\n\nBitte zahlen Sie 12,00 EUR bis 01.02.2000."))
    return labels.references(t.notices.select(F.col("notice_id").alias("doc_id"), text.alias("text")))


_PARTIES = "p AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 10 = 9 AS agency, count(*) OVER () AS n FROM supplier)"


@query(f"""WITH {NOTICES}, {_PARTIES},
l AS (SELECT notice_id, notice_id % n AS id, notice_id % 5 AS way, (notice_id * 7 + 3) % n AS other FROM notices, (SELECT count(*) AS n FROM supplier)),
x AS (SELECT l.*, p.agency, o.agency AS other_agency FROM l JOIN p USING (id) JOIN p o ON o.id = other)
SELECT notice_id AS doc_id, CASE WHEN way <> 4 THEN id END AS author_id,
  CASE WHEN way = 4 THEN NULL WHEN way = 3 AND other <> id AND NOT other_agency THEN other WHEN agency THEN id - 1 ELSE id END AS supplier_id,
  CASE WHEN way = 4 THEN 'NONE' WHEN way = 3 AND other <> id AND NOT other_agency THEN 'CREDITOR' WHEN agency THEN 'REPRESENTED' ELSE 'AUTHOR' END AS how,
  CASE WHEN way = 4 THEN 'Fremdwerk ' || chr(CAST(97 + notice_id % 26 AS INTEGER)) || chr(CAST(97 + notice_id // 26 % 26 AS INTEGER)) || 'heim GmbH' END AS new_name
FROM x""")
def letter_senders(t: LedgerTables) -> DataFrame:
    """Author and supplier of a letter about every notice: told by name, IBAN, VAT id or a creditor's name, or by nothing that is known."""
    parties = t.parties.select("party_id", "name", "role", "represents_id", F.concat(F.lit("DE"), (100_000_000 + F.col("party_id")).cast("string")).alias("vat_id"), F.lit("").alias("tax_number"), F.lit("").alias("email"))
    # the check digits that make bank 10000000 and the party's account an IBAN
    account = F.concat(F.lit("10000000"), F.lpad(F.col("party_id").cast("string"), 10, "0"))
    check = F.lpad((98 - F.pmod(F.concat(account, F.lit("131400")).cast("decimal(24,0)"), F.lit(97).cast("decimal(24,0)"))).cast("int").cast("string"), 2, "0")
    ibans = t.parties.select("party_id", F.concat(F.lit("DE"), check, account).alias("iban"))
    l = t.notices.crossJoin(F.broadcast(t.count("supplier"))).select("notice_id", (F.col("notice_id") % F.col("n_supplier")).alias("party_id"), ((F.col("notice_id") * 7 + 3) % F.col("n_supplier")).alias("other"))  # one row
    rows = l.join(parties.select("party_id", "name", "vat_id"), "party_id").join(ibans, "party_id").join(t.parties.select(F.col("party_id").alias("other"), F.col("name").alias("creditor")), "other")
    letter = lambda k: F.chr(97 + F.floor(F.col("notice_id") / k) % 26)
    stranger = F.concat(F.lit("Fremdwerk "), letter(1), letter(26), F.lit("heim GmbH"))
    head, to = F.concat("name", F.lit(" GmbH\nWeg 1, 12345 Ort\n\n")), F.lit("NATION_1\nSeestraße 1\n23570 Ort\n\nMahnung\n\n")
    body = F.lit("Hauptforderung: 100,00 EUR\nBitte zahlen Sie bald.\n")
    ways = (
        F.concat(head, to, body),
        F.concat(to, body, F.lit("\nIBAN "), "iban"),
        F.concat(to, body, F.lit("\nUSt-IdNr. "), "vat_id"),
        F.concat(head, to, F.lit("Gläubiger: "), "creditor", F.lit("\n"), body),
        F.concat(stranger, F.lit("\nWeg 1, 12345 Ort\n\n"), to, body),
    )
    docs = rows.select(F.col("notice_id").alias("doc_id"), _pick("notice_id", *ways).alias("text"), F.lit("first_dunning").alias("kind"))
    docs = written(spread(docs, "doc_id"), "letters")
    none = t.spark.createDataFrame([], "party_id long, alias string")
    return senders.senders(docs, parties, none, ibans, t.hotels.select("name")).select("doc_id", "author_id", "supplier_id", "how", "new_name")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH own AS (SELECT DISTINCT list_distinct(string_split({_NORM.format('n_name')}, ' ')) AS o FROM nation),
s AS (SELECT s_suppkey AS party_id, {_NORM.format("CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' Nord' WHEN 2 THEN n_name || ' Nord Haus' WHEN 3 THEN split_part(n_name, '_', 2) ELSE split_part(n_name, '_', 2) || ' ' || split_part(n_name, '_', 1) END")} AS norm
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
w AS (SELECT party_id, norm, list_distinct(string_split(norm, ' ')) AS t FROM s)
SELECT party_id, norm, EXISTS (SELECT 1 FROM own WHERE (list_has_all(t, o) AND list_has_all(o, t)) OR (len(o) >= 2 AND list_has_all(t, o) AND len(t) <= len(o) + 1) OR (len(t) >= 2 AND list_has_all(o, t))) AS own FROM w""")
def own_names(t: LedgerTables) -> DataFrame:
    """Which printed names are the reader's own: of every supplier a name made of its hotel's."""
    parts = F.split("n_name", "_")
    shown = _pick("s_suppkey", F.col("n_name"), F.concat("n_name", F.lit(" Nord")), F.concat("n_name", F.lit(" Nord Haus")), F.get(parts, F.lit(1)), F.concat(F.get(parts, F.lit(1)), F.lit(" "), F.get(parts, F.lit(0))))
    rows = t.read("supplier").join(F.broadcast(t.read("nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("party_id"), normalize_name(shown).alias("norm"))
    mine = senders.own_names(rows, t.hotels.select("name")).withColumn("own", F.lit(True))
    return rows.join(mine, "norm", "left").select("party_id", "norm", F.coalesce("own", F.lit(False)).alias("own"))


_WORDS_OF = "SELECT DISTINCT name, unnest(list_distinct(string_split(name, ' '))) AS word FROM"
_GENERIC = ", ".join(f"'{w}'" for w in sorted(GENERIC))


@query(f"""WITH known AS (SELECT DISTINCT {_NORM.format("p_name || ' ' || p_type")} AS name FROM part),
printed AS (SELECT DISTINCT trim(regexp_replace(CASE p_size % 3 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN lower(p_type[1:3] || 'x' || p_type[5:]) || ' ' || p_name ELSE replace(p_name, ' ', '') || ' ' || lower(p_type) END, ' +', ' ', 'g')) AS name FROM part),
kw AS ({_WORDS_OF} known), pw AS ({_WORDS_OF} printed), every AS (SELECT * FROM kw UNION SELECT * FROM pw),
weights AS (SELECT word, least(length(word), 12) * (1 + ln(1 + (SELECT count(DISTINCT name) FROM every) / (1.0 + count(DISTINCT name))) / 2) * CASE WHEN word IN ({_GENERIC}) THEN 0.25 ELSE 1 END AS weight FROM every GROUP BY word),
totals AS (SELECT name, sum(weight) AS total, count(*) AS n FROM every JOIN weights USING (word) GROUP BY name),
words AS (SELECT a.word AS a, b.word AS b, CASE WHEN a.word = b.word THEN 1.0 WHEN least(length(a.word), length(b.word)) < 5 THEN 0.0 ELSE greatest(
    CASE WHEN starts_with(a.word, b.word) OR starts_with(b.word, a.word) THEN 0.8 ELSE 0 END,
    CASE WHEN 1 - levenshtein(a.word, b.word) / greatest(length(a.word), length(b.word)) >= 0.75 THEN 1 - levenshtein(a.word, b.word) / greatest(length(a.word), length(b.word)) ELSE 0 END) END AS m
  FROM (SELECT DISTINCT word FROM pw) a, (SELECT DISTINCT word FROM kw) b),
each AS (SELECT p.name AS p, k.name AS k, p.word AS a, k.word AS b, m FROM pw p, kw k, words WHERE words.a = p.word AND words.b = k.word),
ca AS (SELECT p, k, sum(weight * m) AS c FROM (SELECT p, k, a, max(m) AS m FROM each GROUP BY ALL) JOIN weights ON word = a GROUP BY p, k),
cb AS (SELECT p, k, sum(weight * m) AS c FROM (SELECT p, k, b, max(m) AS m FROM each GROUP BY ALL) JOIN weights ON word = b GROUP BY p, k),
shares AS (SELECT ca.p, ca.k, ca.c / tp.total AS x, cb.c / tk.total AS y, least(tp.n, tk.n) AS n FROM ca JOIN cb ON cb.p = ca.p AND cb.k = ca.k JOIN totals tp ON tp.name = ca.p JOIN totals tk ON tk.name = ca.k),
s AS (SELECT p, k, CASE WHEN p = k THEN 1.0 ELSE greatest(CASE WHEN n = 1 THEN least(0.8, 0.7 * greatest(x, y) + 0.3 * least(x, y)) ELSE 0.7 * greatest(x, y) + 0.3 * least(x, y) END,
    CASE WHEN 1 - levenshtein(replace(p, ' ', ''), replace(k, ' ', '')) / greatest(length(replace(p, ' ', '')), length(replace(k, ' ', ''))) >= 0.88
      THEN 1 - levenshtein(replace(p, ' ', ''), replace(k, ' ', '')) / greatest(length(replace(p, ' ', '')), length(replace(k, ' ', ''))) ELSE 0 END) END AS s FROM shares)
SELECT p AS printed, k AS known, round(s, 4) AS s FROM s WHERE s >= 0.75""")
def similar_names(t: LedgerTables) -> DataFrame:
    """All pairs of names of goods, as they are and as they are misprinted, that resemble each other."""
    part, kind = t.read("part"), F.lower("p_type")
    known = part.select(normalize_name(F.concat_ws(" ", "p_name", "p_type")).alias("known")).distinct()
    misprint = F.concat(F.substring(kind, 1, 3), F.lit("x"), F.substring(kind, 5, 100))
    shown = _pick("p_size", F.concat_ws(" ", "p_name", kind), F.concat_ws(" ", misprint, "p_name"), F.concat_ws(" ", F.replace("p_name", F.lit(" "), F.lit("")), kind))
    printed = part.select(F.trim(F.regexp_replace(shown, " +", " ")).alias("printed")).distinct()
    return names.similar_names(printed, known, 0.75).select("printed", "known", F.round("s", 4).alias("s"))


@query("""WITH p AS (SELECT s_suppkey AS party_id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS norm, 'haus ' || s_suppkey % 7 AS alias, 'DE' || lpad(CAST(s_suppkey * 1000 AS VARCHAR), 20, '0') AS iban FROM supplier)
SELECT party_id FROM p WHERE contains(norm, 'haus 3') OR contains(alias, 'haus 3') OR contains(iban, 'HAUS3')
UNION ALL SELECT party_id + 1000000 FROM p WHERE contains(norm, '42000') OR contains(alias, '42000') OR contains(iban, '42000')""")
def chosen_parties(t: LedgerTables) -> DataFrame:
    """Parties that a typed word leaves in a list: by name, alias or IBAN."""
    parties = t.parties.select("party_id", "name", F.lit("").alias("address"))
    aliases = t.parties.select("party_id", F.concat(F.lit("Haus "), (F.col("party_id") % 7).cast("string")).alias("alias"))
    ibans = t.parties.select("party_id", F.concat(F.lit("DE"), F.lpad((F.col("party_id") * 1000).cast("string"), 20, "0")).alias("iban"))
    some, more = (S.chosen_parties(parties, aliases, ibans, typed) for typed in ("Haus 3", "42 000"))
    return some.select("party_id").unionByName(more.select((F.col("party_id") + 1_000_000).alias("party_id")))


@query("""WITH p AS (SELECT s_suppkey AS party_id FROM supplier),
a AS (SELECT party_id, 'Haus ' || party_id % 7 AS alias FROM p WHERE party_id % 3 <> 0 UNION SELECT party_id, 'Firma ' || party_id FROM p WHERE party_id % 3 <> 0
  UNION SELECT party_id, 'Neu ' || party_id FROM p WHERE party_id % 6 = 0)
SELECT party_id, coalesce(string_agg(alias, ',' ORDER BY alias), '') AS aliases, 'DE' || lpad(CAST(party_id AS VARCHAR), 20, '0') AS ibans FROM p LEFT JOIN a USING (party_id) GROUP BY party_id""")
def parties_with_children(t: LedgerTables) -> DataFrame:
    """Parties with their aliases and IBANs as arrays, after each third party's aliases were replaced, some by none."""
    path = new_folder(t.spark, "aliases")
    key = normalize_name(F.col("alias"))
    forms = F.array(F.concat(F.lit("Haus "), (F.col("party_id") % 7).cast("string")), F.concat(F.lit("Firma "), F.col("party_id").cast("string")), F.concat(F.lit("firma-"), F.col("party_id").cast("string")), F.lit(" "))
    CH.create_children(t.parties.select("party_id", F.explode(forms).alias("alias")), path, "party_id", "alias", key)
    third = t.parties.where("party_id % 3 = 0").select("party_id")
    CH.replace_children(path, third, third.where("party_id % 2 = 0").select("party_id", F.concat(F.lit("Neu "), F.col("party_id").cast("string")).alias("alias")), "party_id", "alias", key)
    ibans = t.parties.select("party_id", F.concat(F.lit("DE"), F.lpad(F.col("party_id").cast("string"), 20, "0")).alias("iban"))
    rows = CH.with_children(t.parties.select("party_id"), "party_id", aliases=t.spark.read.parquet(path).select("party_id", "alias"), ibans=ibans)
    return rows.select("party_id", F.array_join("aliases", ",").alias("aliases"), F.array_join("ibans", ",").alias("ibans"))


@query(f"""WITH {INVOICES},{NOTICES},
d AS (SELECT notice_id AS doc_id, n.invoice_id AS target, notice_id % 4 AS way, CASE WHEN notice_id % 5 <> 0 THEN supplier_id END AS own, CASE WHEN notice_id % 3 = 0 THEN gross_cents END AS gross,
    CASE WHEN notice_id % 2 = 0 THEN invoice_date END AS day FROM notices n JOIN invoices USING (invoice_id)),
told AS (SELECT doc_id, target AS invoice_id, [0.6, 0.45, 0.4, 0.5][way + 1] AS w, ['NUMBER', 'NUMBER', 'MISREAD', 'REFERENCE'][way + 1] AS reason FROM d),
near AS (SELECT doc_id, invoice_id FROM d JOIN invoices ON supplier_id = own AND gross_cents = gross UNION SELECT doc_id, invoice_id FROM d JOIN invoices ON supplier_id = own AND invoice_date = day),
every AS (SELECT doc_id, invoice_id, w, reason FROM told UNION ALL SELECT doc_id, invoice_id, 0, '' FROM near ANTI JOIN told USING (doc_id, invoice_id)),
s AS (SELECT doc_id, invoice_id, round(least(1, w + CASE WHEN own = supplier_id THEN 0.15 WHEN own IS NOT NULL THEN -0.3 ELSE 0 END + CASE WHEN gross = gross_cents THEN 0.2 ELSE 0 END + CASE WHEN day = invoice_date THEN 0.15 ELSE 0 END), 3) AS score,
    concat_ws(',', nullif(reason, ''), CASE WHEN own = supplier_id THEN 'SUPPLIER' WHEN own IS NOT NULL THEN 'OTHER_SUPPLIER' END, CASE WHEN gross = gross_cents THEN 'AMOUNT' END, CASE WHEN day = invoice_date THEN 'DATE' END) AS reasons
  FROM every JOIN d USING (doc_id) JOIN invoices USING (invoice_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, invoice_id) AS rank FROM s WHERE score >= 0.3)
SELECT doc_id, invoice_id, CAST(score AS DOUBLE) AS score, reasons, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def document_links(t: LedgerTables) -> DataFrame:
    """Invoices that letters are about: by a labelled number, a number in the text, one as a scanner misreads it, or a case's reference."""
    rows = t.notices.join(t.invoices, "invoice_id")
    misread = F.translate(F.replace("invoice_number", F.lit("-"), F.lit(" - ")), "0158", "OISB")
    shown = _pick("notice_id", F.lit("siehe Betreff"), F.col("invoice_number"), misread, F.lit("siehe Zeichen"))
    docs = rows.select(F.col("notice_id").alias("doc_id"), F.concat(F.lit("Wir mahnen wie folgt an: "), shown, F.lit(" - bitte zahlen.")).alias("text"))
    when = lambda cond, c: F.when(cond, c)
    n = F.col("notice_id")
    fields = rows.select(
        n.alias("doc_id"), F.lit("first_dunning").alias("kind"), when(n % 5 != 0, F.col("supplier_id")).alias("supplier_id"), when(n % 4 == 0, F.col("invoice_number")).alias("invoice_number"), F.lit(None).cast("bigint").alias("principal_cents"),
        when(n % 3 == 0, F.col("gross_cents")).alias("gross_cents"), F.lit(None).cast("bigint").alias("payment_cents"), when(n % 2 == 0, F.col("invoice_date")).alias("referenced_date"),
    )
    own_case = F.concat(F.lit("AZ"), F.lpad(F.col("invoice_id").cast("string"), 9, "0"))
    references = rows.where(n % 4 == 3).select(n.alias("doc_id"), own_case.alias("normalized"))
    cases = t.invoices.select((F.col("invoice_id") + 500).alias("case_id"), "invoice_id")
    known = t.invoices.select(F.lit("case").alias("owner_kind"), (F.col("invoice_id") + 500).alias("owner_id"), own_case.alias("normalized"))
    return links.link_documents(docs, fields, references, t.invoices, known, cases)
