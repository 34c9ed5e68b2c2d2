"""Who wrote a letter, and whose account it belongs to.

The sender's name stands in the letterhead, in the small line above the address window, or in the footer, so only the first and
last lines of a text are read for names: each gives a few pieces, and a piece that looks like a name becomes a candidate
with a plausibility made of what it looks like and where it stands. The reader's own companies and hotels are no
candidates: token sets that contain each other are found by a join on their rarest token.

Everything that ties a letter to a party is a row of evidence (IBAN, VAT id, tax number, mail, resembling name, mention),
found by equi joins; evidence is combined as independent witnesses, and the best two of each letter are compared. Names are
compared once for each two different names. The author and the supplier are two answers over the same evidence: a letter
of an agency belongs to the creditor that it names, else to the one that the agency represents.

Defined cases: a null or empty text has no sender; ``doc_id`` is unique; long texts cost no more names than short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto import domain as D
from skonto.functions.text import normalize_iban, normalize_name, registrable, valid_iban
from skonto.operators import sender_words as W
from skonto.operators.bank import noisy_or
from skonto.operators.names import GENERIC, similar_names
from skonto.sources.shared import written

HEAD_LINES, FOOT_LINES, TOP_LINES, FIRST_LINES = 25, 24, 6, 4
MOST_NAMES, MOST_CANDIDATES = 6, 6
#: Of parties with the same names so many can be among a letter's candidates by their names: one more for the best, which may lose, and one that may be the author.
NAMESAKES = MOST_CANDIDATES + 2
#: Names that resemble each other this much are evidence; below, and not the best printed name, a mention weighs little.
ALIKE, UNLIKE, SURE_NAME = 0.72, 0.6, 0.55
SUGGESTED, CLEAR, GAP = 0.4, 0.9, 0.08
CREDITOR_LEAST, CREDITOR_SURE = 0.45, 0.55
LETTERS_OF_CLAIMS = ("payment_reminder", "first_dunning", "second_dunning", "final_dunning", "collection_letter", "court_order")
PAYMENTS = "bank_statement"


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def contacts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ibans, vat_ids, tax_numbers, emails, domains, phones): arrays of what each text holds, in its order."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = lambda rx, g=0: F.array_distinct(F.regexp_extract_all(t, F.lit(rx), F.lit(g)))
    bare = lambda c: F.transform(c, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    raw = bare(every(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b"))
    # what follows an IBAN may look like a part of it: its longest valid beginning counts
    cut = F.transform(raw, lambda x: F.get(F.filter(F.transform(F.sequence(F.length(x), F.lit(15)), lambda n: F.substr(x, F.lit(1), n)), valid_iban), F.lit(0)))
    emails = F.array_distinct(F.transform(every(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"), lambda x: F.lower(x)))
    sites = F.transform(every(r"(?i)\bwww\.([A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})", 1), lambda x: F.lower(x))
    domains = F.transform(F.concat(F.transform(emails, lambda x: F.substring_index(x, "@", -1)), sites), registrable)
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        F.array_distinct(F.array_compact(cut)).alias("ibans"),
        F.array_distinct(bare(every(r"\b(?:DE ?\d{9}|ATU\d{8}|NL\d{9}B\d{2}|FR[A-Z0-9]{2} ?\d{9}|IT\d{11}|PL\d{10}|BE0?\d{9,10}|IE\d[A-Z0-9]\d{5}[A-Z]{1,2})\b"))).alias("vat_ids"),
        F.array_distinct(bare(every(r"(?iU)(?:steuer ?-? ?(?:nummer|nr\.?)|st\. ?-? ?nr\.?|tax (?:no\.?|number|id)) *:? *(\d{2,3} ?/ ?\d{3} ?/ ?\d{4,5}|\d{10,11})", 1))).alias("tax_numbers"),
        emails.alias("emails"),
        F.array_distinct(F.filter(domains, lambda x: ~x.isin(*W.FREE_MAIL))).alias("domains"),
        F.transform(every(r"(?i)\b(?:tel(?:efon)?\.?|phone|fon) *:? *(\+?[\d][\d /()\-]{6,}\d)", 1), lambda x: F.trim(x)).alias("phones"),
    )


def zones(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, zone): the first and last lines that are not blank, as structs (pos, line, norm, bank); creditors' lines are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    once = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(lines)).alias("lines")).withColumn("n", F.size("lines"))
    head = F.transform(F.slice("lines", F.lit(1), F.lit(HEAD_LINES)), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    first = F.greatest(F.lit(HEAD_LINES), F.col("n") - FOOT_LINES)
    foot = F.transform(F.slice("lines", first + 1, F.lit(FOOT_LINES)), lambda x, i: F.struct((first + i).cast("int").alias("pos"), x.alias("line")))
    kept = F.filter(F.concat(head, foot), lambda z: ~has(z["line"], W.CREDITOR))
    return once.select("doc_id", "n", F.transform(kept, lambda z: F.struct(z["pos"].alias("pos"), z["line"].alias("line"), normalize_name(z["line"]).alias("norm"), has(z["line"], f"{W.BANK}|{W.REGISTER}").alias("bank"))).alias("zone"))


def own_names(segments: DataFrame, own: DataFrame, name: str = "name") -> DataFrame:
    """(norm): of the different normalised names ``norm`` those that are the reader's own.

    A name is own if its words are those of an own name; if they hold an own name of two words or more and one word besides at
    most; or if they are two or more of an own name's.
    """
    sets = lambda df, c: df.select(F.col(c).alias(f"{c}_key"), F.array_distinct(F.filter(F.split(c, " "), lambda x: x != "")).alias(f"{c}_words")).where(F.size(f"{c}_words") > 0)
    mine = sets(own.select(normalize_name(F.col(name)).alias("own")).distinct(), "own")
    theirs = sets(segments.select("norm").distinct(), "norm")
    often = mine.select(F.explode("own_words").alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    # each set is posted under its rarest word among own names: a set that holds it all has that word too
    posted = lambda df, c: df.select("*", F.explode(f"{c}_words").alias("word")).join(often, "word", "left").groupBy(f"{c}_key", f"{c}_words").agg(F.min_by("word", F.struct(F.coalesce("k", F.lit(0)), "word")).alias("word"))
    spread = lambda df, c: df.select("*", F.explode(f"{c}_words").alias("word"))
    met = posted(mine, "own").join(spread(theirs, "norm"), "word").unionByName(posted(theirs, "norm").join(spread(mine, "own"), "word"), allowMissingColumns=True)
    n_own, n_seg = F.size("own_words"), F.size("norm_words")
    holds, within = F.size(F.array_except("own_words", "norm_words")) == 0, F.size(F.array_except("norm_words", "own_words")) == 0
    return met.where((holds & within) | ((n_own >= 2) & holds & (n_seg <= n_own + 1)) | ((n_seg >= 2) & within)).select(F.col("norm_key").alias("norm")).distinct()


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that a generator makes: filters don't reach behind it, so it is worked out once however often they use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def name_pieces(zoned: DataFrame) -> DataFrame:
    """(doc_id, n, zone, pos, first, sender_line, piece): the pieces of each line that may be names."""
    line = F.col("z")["line"]
    each = zoned.select("doc_id", "n", "zone", F.explode("zone").alias("z"))
    address = rf"(?:{W.STREET})|(?:{W.TOWN})"
    cells = F.filter(F.split(line, r" +[·|•‧] +| {3,}|\t+| [–—] | / "), lambda x: F.trim(x) != "")
    comma = F.regexp_extract(line, r"^([^,]{3,60}?), *[^,]*\d[^,]*, *(?:[A-Z]{1,2}-)?\d{4,5} +\S", 1)
    parted = (F.size(cells) >= 2) & F.exists(F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 1)), lambda x: x.rlike(f"(?U){address}"))
    pieces = F.when(comma != "", F.array(comma)).otherwise(cells)
    rows = each.select("doc_id", "n", "zone", F.col("z")["pos"].alias("pos"), ((comma != "") | parted).alias("sender"), F.posexplode(pieces).alias("k", "raw"))
    inside = f"{address}|{W.CONTACT}|{W.BANK}|{W.REGISTER}|{W.OTHER}"
    tidy = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\s+", " "), r"^[ .,;:\-–—|·•]+|[ ,;:\-–—|·•]+$", ""))
    rows = _once(rows, tidy, "tidy")
    cut = F.trim(F.regexp_replace(F.regexp_extract("tidy", rf"(?iU)^(.{{4,}}?)(?= (?:{inside})|$)", 1), r"[ ,.\-–|·•]+$", ""))
    rows = _once(rows, cut, "cut")
    # a dot at the end belongs to a legal form
    piece = F.when(F.col("tidy") == F.concat("cut", F.lit(".")), F.col("tidy")).when(F.length("tidy") < 4, F.col("tidy")).otherwise(F.col("cut"))
    first = F.col("k") == 0
    return _once(rows, piece, "piece").select("doc_id", "n", "zone", "pos", first.alias("first"), (F.col("sender") & first).alias("sender_line"), "piece")


def like_a_name(piece: Column) -> Column:
    """Whether a piece of a line can be a name at all."""
    inside = rf"(?:{W.STREET})$|{W.TOWN}|{W.CONTACT}|{W.BANK}|{W.REGISTER}|{W.OTHER}|{W.BEGINS}|{W.ENDS}"
    n_words = F.size(F.split(piece, r"\s+"))
    letters = F.length(F.regexp_replace(piece, r"[^\p{L}]", ""))
    sentence = (n_words > 4) & piece.rlike(r"[.,]$") & ~piece.rlike(W.LEGAL_FORM)
    # what costs least comes first
    return F.length(piece).between(3, 75) & ~piece.contains(":") & piece.rlike(r"^[\p{L}\p{N}(]") & (letters >= 3) & (n_words <= 9) & ~sentence & ~has(piece, inside)


def sender_names(documents: DataFrame, own: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, name, norm, plausible, sender_line, legal_form, pos, rank): the most plausible printed names of each letter."""
    known = contacts(documents, doc_id, text) if known is None else known
    pieces = name_pieces(zones(documents, doc_id, text)).where(like_a_name(F.col("piece")))
    pieces = _once(pieces, normalize_name(F.col("piece")), "norm").where("length(norm) >= 3")
    legal, slogan = F.col("piece").rlike(W.LEGAL_FORM), has(F.col("piece"), W.SLOGAN)
    able = legal | F.col("sender_line") | F.col("norm").rlike(W.BUSINESS) | ((F.col("pos") < FIRST_LINES) & (F.size(F.split("piece", " ")) <= 5) & ~slogan)
    place = F.when(F.col("pos") < TOP_LINES, W.TOP).when(F.col("pos") < HEAD_LINES, W.HEAD).otherwise(W.FOOT)
    score = W.PLAIN + F.when(legal, W.WITH_FORM).otherwise(0.0) + F.when(F.col("sender_line"), W.SENDER_LINE).otherwise(0.0) + place - F.when(slogan & ~legal, W.SLOGAN_LESS).otherwise(0.0)
    holds = lambda l: F.concat(F.lit(" "), l["norm"], F.lit(" ")).contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")))
    said = F.size(F.filter("zone", holds))
    near = F.exists("zone", lambda l: (l["pos"] >= F.col("n") - FOOT_LINES) & l["bank"] & holds(l))
    rows = pieces.where(able).select("doc_id", "norm", "piece", "pos", "sender_line", legal.alias("legal"), score.alias("score"), said.alias("said"), near.alias("near"))
    best = F.struct(F.col("legal"), F.upper("piece") != F.col("piece"), -F.col("pos"))
    names = rows.groupBy("doc_id", "norm").agg(
        F.max_by("piece", best).alias("name"), (F.max("score") + W.AGAIN * (F.count("*") - 1)).alias("score"), F.max("sender_line").alias("sender_line"), F.max("legal").alias("legal_form"),
        F.min("pos").alias("pos"), F.max("said").alias("said"), F.max("near").alias("near"),
    )
    names = written(names, "printed-names")
    names = names.join(own_names(names, own), "norm", "left_anti").join(known.select("doc_id", "domains"), "doc_id")
    compact = F.transform("domains", lambda d: F.regexp_replace(F.regexp_replace(d, r"\.[^.]*$", ""), "[^a-z0-9]", ""))
    telling = F.filter(F.array_distinct(F.split("norm", " ")), lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(GENERIC)))
    told = F.size(F.filter(telling, lambda w: F.exists(compact, lambda d: d.contains(w) | ((F.length(d) >= 5) & w.contains(d)) | ((F.length(w) >= 6) & d.contains(F.substr(w, F.lit(1), F.lit(6)))))))
    more = (
        F.when(F.col("said") >= 2, F.least(F.lit(W.MOST_REPEATED), W.REPEATED * (F.col("said") - 1))).otherwise(0.0)
        + F.when(told > 1, W.DOMAIN + W.HEAD).when(told == 1, W.DOMAIN).otherwise(0.0) + F.when(F.col("near"), W.NEAR_BANK).otherwise(0.0)
    )
    rated = names.select("doc_id", "name", "norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + more)).alias("plausible"), "sender_line", "legal_form", "pos")
    order = Window.partitionBy("doc_id").orderBy(F.desc("plausible"), "pos", "norm")
    rated = written(rated.withColumn("k", F.row_number().over(order)), "plausible-names")
    # a name that is the beginning of a better one, or begins with it, is that one
    other = rated.select("doc_id", F.col("norm").alias("better"), F.col("k").alias("b"))
    begins = lambda x, y: F.concat(F.col(x), F.lit(" ")).startswith(F.concat(F.col(y), F.lit(" ")))
    merged = rated.join(other, "doc_id").where((F.col("b") < F.col("k")) & (begins("better", "norm") | begins("norm", "better"))).select("doc_id", "k").distinct()
    left = rated.join(merged, ["doc_id", "k"], "left_anti")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_NAMES).drop("k")


def variants(parties: DataFrame, aliases: DataFrame) -> DataFrame:
    """(party_id, norm) of all names and aliases."""
    called = parties.select("party_id", "name").unionByName(aliases.select("party_id", F.col("alias").alias("name")))
    return called.select("party_id", normalize_name(F.col("name")).alias("norm")).where("norm <> ''").distinct()


def mentions(documents: DataFrame, called: DataFrame, own: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, party_id): parties that a text names word for word, but for lines that name a creditor. A name is looked up by its rarest word."""
    able = called.where(F.length("norm") >= 6).select("norm").distinct().join(own_names(called, own), "norm", "left_anti")
    words = able.select("norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("k"))
    posted = words.join(often, "word").groupBy("norm").agg(F.min_by("word", F.struct("k", "word")).alias("word"))
    body = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), rf"(?iU)(?m)^.*{W.CREDITOR}.*$", "")
    said = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(normalize_name(body))).alias("said"))
    # only words of names become rows of their own, and the text stays behind
    found = said.select("doc_id", F.explode(F.array_distinct(F.split("said", " "))).alias("word")).join(posted, "word")
    whole = F.concat(F.lit(" "), "said", F.lit(" ")).contains(F.concat(F.lit(" "), "norm", F.lit(" ")))
    named = found.select("doc_id", "norm").distinct().join(said, "doc_id").where(whole).select("doc_id", "norm")
    return named.join(called, "norm").select("doc_id", "party_id").distinct()


def namesakes(called: DataFrame) -> DataFrame:
    """(party_id, first, k): parties that have all their names (party_id, norm) in common, counted by their ids, and the first of them."""
    same = Window.partitionBy("norms").orderBy("party_id")
    sets = called.groupBy("party_id").agg(F.array_sort(F.collect_set("norm")).alias("norms"))
    return sets.select("party_id", F.first("party_id").over(same).alias("first"), F.row_number().over(same).alias("k"))


def first_namesakes(called: DataFrame, ranks: DataFrame) -> DataFrame:
    """``called`` of those parties that can be among the candidates of a letter by their names alone."""
    return called.join(ranks.where(F.col("k") <= NAMESAKES).select("party_id"), "party_id", "left_semi")


def with_namesakes(sure: DataFrame, by_names: DataFrame, ranks: DataFrame) -> DataFrame:
    """Evidence ``sure`` and ``by_names``, the latter of first namesakes; other parties that are sure of a letter get what their first namesake has."""
    told = sure.select("doc_id", "party_id").distinct().join(ranks.where(F.col("k") > NAMESAKES).select("party_id", "first"), "party_id")
    more = told.join(by_names.withColumnRenamed("party_id", "first"), ["doc_id", "first"]).select("doc_id", "party_id", "weight", "reason")
    return sure.unionByName(by_names).unionByName(more)


def name_evidence(printed: DataFrame, called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, norm, plausible) names: (doc_id, party_id, weight) of resembling parties, and (doc_id, party_id, s) of all that resemble at all."""
    pairs = written(similar_names(printed.select(F.col("norm").alias("printed")), called.select(F.col("norm").alias("known")), UNLIKE), "resembling-names")
    each = printed.join(pairs, F.col("norm") == F.col("printed")).drop("norm").join(called.withColumnRenamed("norm", "known"), "known")
    best = each.groupBy("doc_id", "party_id").agg(F.max_by(F.struct("s", "plausible", "printed"), F.struct("s", "plausible")).alias("b")).select("doc_id", "party_id", "b.*")
    return best.where(F.col("s") >= ALIKE).select("doc_id", "party_id", (F.col("s") * (W.NAME_SHARE + W.PLAUSIBLE_SHARE * F.col("plausible"))).alias("weight")), each.select("doc_id", "party_id", "printed", "s")


def ranked(evidence: DataFrame) -> DataFrame:
    """(doc_id, party_id, score, reasons, rank): evidence (doc_id, party_id, weight, reason) combined; the best loses if the second is near."""
    scored = noisy_or(evidence, "doc_id", "party_id").withColumn("score", F.round("score", 3))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "party_id")
    placed = scored.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    unclear = (F.col("k") == 1) & (F.col("score") < CLEAR) & (F.col("score") - F.col("second") < GAP)
    less = placed.select("doc_id", "party_id", F.when(unclear, F.round(F.col("score") - GAP, 3)).otherwise(F.col("score")).alias("score"), F.when(unclear, F.concat("reasons", F.lit(",AMBIGUOUS"))).otherwise(F.col("reasons")).alias("reasons"))
    return less.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_CANDIDATES)


def author_evidence(documents: DataFrame, names: DataFrame, known: DataFrame, parties: DataFrame, aliases: DataFrame, ibans: DataFrame, own: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, party_id, weight, reason): all that ties letters to parties (party_id, name, vat_id, tax_number, email)."""
    said = lambda column, key: known.select("doc_id", F.explode(column).alias(key)).distinct()
    bare = lambda c: F.nullif(F.upper(F.regexp_replace(c, r"\s+", "")), F.lit(""))
    mail = F.lower(F.trim("email"))
    of = lambda df, weight, reason: df.select("doc_id", "party_id", F.lit(weight).cast("double").alias("weight"), F.lit(reason).alias("reason"))
    every = variants(parties, aliases)
    ranks = written(namesakes(every), "namesakes")
    called = written(first_namesakes(every, ranks), "first-namesakes")
    by_name, alike = name_evidence(names, called)
    by_name = written(by_name, "parties-by-name")
    top = names.where("rank = 1").select("doc_id", F.col("norm").alias("top"), F.col("plausible").alias("sure"))
    # a mention of a party that the letterhead doesn't resemble weighs little beside a plausible letterhead
    mentioned = written(mentions(documents, called, own, doc_id, text), "mentions").join(by_name, ["doc_id", "party_id"], "left_anti").join(top, "doc_id", "left")
    near_top = alike.select("doc_id", "party_id", F.col("printed").alias("top"), F.lit(True).alias("near")).distinct()
    elsewhere = (F.coalesce("sure", F.lit(0.0)) >= SURE_NAME) & F.col("near").isNull()
    weak = mentioned.join(near_top, ["doc_id", "party_id", "top"], "left").select("doc_id", "party_id", F.when(elsewhere, W.NAMED_ELSEWHERE).otherwise(W.NAMED).alias("weight"), F.lit("MENTION").alias("reason"))
    sure = (
        of(said("ibans", "iban").join(ibans.select("party_id", normalize_iban(F.col("iban")).alias("iban")), "iban"), W.IBAN, "IBAN")
        .unionByName(of(said("vat_ids", "vat").join(parties.select("party_id", bare(F.col("vat_id")).alias("vat")), "vat"), W.VAT_ID, "VAT_ID"))
        .unionByName(of(said("tax_numbers", "tax").join(parties.select("party_id", bare(F.col("tax_number")).alias("tax")), "tax"), W.TAX_NUMBER, "TAX_NUMBER"))
        .unionByName(of(said("emails", "mail").join(parties.select("party_id", mail.alias("mail")), "mail"), W.EMAIL, "MAIL"))
        .unionByName(of(said("domains", "domain").join(parties.where(mail.contains("@")).select("party_id", registrable(F.substring_index(mail, "@", -1)).alias("domain")), "domain"), W.MAIL_DOMAIN, "MAIL"))
    )
    by_names = by_name.withColumn("reason", F.lit("NAME")).unionByName(weak)
    return with_namesakes(written(sure, "sure-evidence"), written(by_names, "evidence-by-names"), ranks)


def creditor_names(documents: DataFrame, own: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, name, norm): who letters name as creditor or payee, in the order of the text."""
    hits = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(rf"(?iU){W.CREDITOR} *:? *([^\n]*)"), F.lit(1))
    ends = rf"(?iU)(?:{W.CREDITOR_ENDS}).*$"
    # a dot ends a name unless it belongs to a legal form of letters and dots
    tidy = F.transform(hits, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.regexp_replace(x, r"(?i)\be\. ?([kv])\.", "e$1"), F.lit(" ")), ends, ""), r"^[ :;\-]+|[ :;.\-]+$", "")))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(tidy).alias("k", "name")).withColumn("norm", normalize_name(F.regexp_replace("name", r"(?i)\be[kv]$", "")))
    fit = rows.where(F.length(F.regexp_replace("name", r"[^\p{L}]", "")) >= 3)
    return fit.join(own_names(fit, own), "norm", "left_anti")


def senders(
    documents: DataFrame, parties: DataFrame, aliases: DataFrame, ibans: DataFrame, own: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str = "kind", known: DataFrame | None = None
) -> DataFrame:
    """One row per letter: author_id, score, reasons, supplier_id, how, supplier_score of a creditor or payee, creditor_name, and new_name with address and contacts if the author is unknown.

    ``documents``: doc_id, text, kind; ``parties``: party_id, name, role, represents_id, vat_id, tax_number, email; ``aliases``: party_id,
    alias; ``ibans``: party_id, iban; ``own``: name; ``known``: the ``contacts`` of the documents, if they are there already.
    """
    known = written(contacts(documents, doc_id, text), "contacts") if known is None else known
    names = written(sender_names(documents, own, known, doc_id, text), "sender-names")
    about = parties.select("party_id", "role", "represents_id")
    best = written(ranked(author_evidence(documents, names, known, parties, aliases, ibans, own, doc_id, text)), "authors")
    author = best.where((F.col("rank") == 1) & (F.col("score") >= SUGGESTED)).join(about, "party_id").select("doc_id", F.col("party_id").alias("author_id"), "score", "reasons", "role", "represents_id")
    author = written(author, "known-authors")

    kinds = documents.select(F.col(doc_id).alias("doc_id"), F.col(kind).alias("kind"))
    said = creditor_names(documents, own, doc_id, text).join(kinds, "doc_id").where(F.col("kind").isin(*LETTERS_OF_CLAIMS, PAYMENTS)).join(author.select("doc_id", "author_id"), "doc_id", "left")
    top = names.where("rank = 1").select("doc_id", F.col("norm").alias("top"))
    called = variants(parties, aliases)
    self_name = said.join(called.select(F.col("party_id").alias("author_id"), "norm", F.lit(True).alias("its")), ["author_id", "norm"], "left").join(top, "doc_id", "left")
    named = written(self_name.where(F.col("its").isNull() & (F.col("author_id").isNotNull() | (F.col("kind") == PAYMENTS) | ~F.col("norm").eqNullSafe(F.col("top")))).select("doc_id", "k", "name", "norm", "kind", "author_id"), "creditors")
    suppliers = called.join(parties.where(F.col("role") != D.AGENCY).select("party_id"), "party_id", "left_semi")
    ranks = written(namesakes(suppliers), "namesakes")
    by_name, _ = name_evidence(named.select("doc_id", "norm", F.lit(0.9).alias("plausible")).distinct(), first_namesakes(suppliers, ranks))
    by_name = written(by_name, "creditors-by-name")
    paid = known.select("doc_id", F.explode("ibans").alias("iban")).join(kinds.where(F.col("kind") == PAYMENTS), "doc_id").join(ibans.select("party_id", normalize_iban(F.col("iban")).alias("iban")), "iban").join(parties.where(F.col("role") == D.SUPPLIER).select("party_id"), "party_id", "left_semi")
    proof = with_namesakes(paid.select("doc_id", "party_id", F.lit(W.IBAN).alias("weight"), F.lit("IBAN").alias("reason")), by_name.withColumn("reason", F.lit("CREDITOR")), ranks)
    # who writes for a claim is not its creditor, but a statement may be the payee's own
    writers = author.join(kinds.where(F.col("kind") != PAYMENTS), "doc_id", "left_semi").select("doc_id", F.col("author_id").alias("party_id"))
    proof = proof.join(writers, ["doc_id", "party_id"], "left_anti")
    creditor = ranked(proof).where((F.col("rank") == 1) & (F.col("score") >= CREDITOR_LEAST)).select("doc_id", F.col("party_id").alias("creditor_id"), F.col("score").alias("creditor_score"))
    creditor = written(creditor, "known-creditors")
    first = named.groupBy("doc_id").agg(F.min_by("name", "k").alias("creditor_name"))

    # only a new party's address is told
    strangers = documents.join(author.select(F.col("doc_id").alias(doc_id)), doc_id, "left_anti")
    address = written(addresses(strangers, names.where("rank = 1"), doc_id, text), "addresses")
    rows = kinds.join(author, "doc_id", "left").join(creditor, "doc_id", "left").join(first, "doc_id", "left").join(names.where("rank = 1").select("doc_id", "name", "plausible"), "doc_id", "left").join(known, "doc_id", "left").join(address, "doc_id", "left")
    agency = F.coalesce(F.col("role") == D.AGENCY, F.lit(False))
    claims, payment = F.col("kind").isin(*LETTERS_OF_CLAIMS), F.coalesce(F.col("kind") == PAYMENTS, F.lit(False))
    through_author = F.when(agency, F.col("represents_id")).otherwise(F.col("author_id"))
    by_creditor = F.when(F.col("creditor_score") >= CREDITOR_SURE, F.col("creditor_id"))
    supplier = F.when(payment, F.col("creditor_id")).when(F.coalesce(claims, F.lit(False)), F.coalesce(by_creditor, through_author)).otherwise(through_author)
    how = F.when(supplier.isNull(), "NONE").when(payment, "PAYEE").when(F.coalesce(claims, F.lit(False)) & by_creditor.isNotNull(), "CREDITOR").when(agency, "REPRESENTED").otherwise("AUTHOR")
    unknown = F.col("author_id").isNull() & ~payment
    new = lambda c: F.when(unknown, c)
    return rows.select(
        F.col("doc_id").alias(doc_id), F.when(~payment, F.col("author_id")).alias("author_id"), F.when(payment, 0.0).otherwise(F.coalesce("score", F.round(0.2 + 0.4 * F.col("plausible"), 3), F.lit(0.0))).alias("score"), F.when(~payment, F.col("reasons")).alias("reasons"),
        supplier.alias("supplier_id"), how.alias("how"), F.when(how.isin("PAYEE", "CREDITOR"), F.col("creditor_score")).alias("supplier_score"), F.when(supplier.isNull(), F.col("creditor_name")).alias("creditor_name"), new(F.col("name")).alias("new_name"), new(F.col("address")).alias("new_address"),
        new(F.get("vat_ids", F.lit(0))).alias("new_vat_id"), new(F.get("tax_numbers", F.lit(0))).alias("new_tax_number"), new(F.get("emails", F.lit(0))).alias("new_email"), new(F.get("phones", F.lit(0))).alias("new_phone"),
        new(F.slice("ibans", F.lit(1), F.lit(2))).alias("new_ibans"),
    )


def addresses(documents: DataFrame, best: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, address): street and town on the line of the best name or the three after it."""
    near = zones(documents, doc_id, text).join(best.select("doc_id", F.col("pos").alias("at")), "doc_id")
    said = F.array_join(F.transform(F.filter("zone", lambda z: z["pos"].between(F.col("at"), F.col("at") + 3)), lambda z: z["line"]), " · ")
    street, town = F.regexp_extract(said, rf"(?U)({W.STREET} ?\p{{Ll}}?)\b", 1), F.regexp_extract(said, rf"(?U)({W.TOWN})", 1)
    return near.select("doc_id", F.when((street != "") & (town != ""), F.concat(F.trim(street), F.lit(", "), F.trim(town))).alias("address"))
