"""Values that stand below their labels, and the net, VAT and gross amount of invoices in any layout.

A text layer of a printed table comes as a row of labels above a row of values, as labels and values by turns, or as
a block of labels above a block of values. All of these stand where lines without digits end and lines with digits begin, so
a text is cut into runs of lines of one sort, and pairs are read at these places only.

A text is read where it is, by functions on arrays of its lines: nothing moves, and nothing costs more than the text is long, but for a sort.
Steps that are used more than once are made by generators, behind which no filter or projection can repeat them.

Of all labelled amounts those count that add up: net and VAT make gross. Without such a triple the text's own amounts are
tried, each against the twelve before it, and then the best of each kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.functions.dates import parse_any_date
from skonto.functions.money import VAT_RATES, cents_of_digits, plausible_rate
from skonto.functions.text import once
from skonto.operators import document_rules as R
from skonto.operators.needles import may_match

CELLS = r"\t+|\s{2,}|\s\|\s"
ANY_AMOUNT = rf"(?<![\w.,'’])({R.AMOUNT})(?!\d)(?![.,]\d)"
#: Labels of a pair have 2 to 41 characters, a value below a single label 40 at most.
LABEL = r"(?U)^\p{L}\D{1,40}$"
LONGEST_VALUE = 40
#: So many different amounts of a kind take part in sums, the best first; an amount of the text looks back so many others.
CHOICES, LOOK_BACK = 8, 12
KINDS = ("gross", "net", "vat")
UNDER_HEADER, IN_BLOCK, ON_LINE, WHOLE_ROW = 2.5, 2.0, 3.0, 3.5
#: Sorts of lines: a label, a label of several cells, a line with digits, any other.
LABEL_LINE, LABEL_CELLS, VALUES, REST = "LCVX"
#: What ``read_layouts`` adds to a row, each with a prefix.
ADDED = ("net_cents", "vat_cents", "gross_cents", "vat_rate", "consistent", "derived", "invoice_number", "document_date", "due_date")
PREFIX = "_layout_"


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that a generator makes, so that it is worked out once however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _plain(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, ":$", ""))


def _cells(line: Column) -> Column:
    return F.filter(F.split(line, CELLS), lambda x: F.trim(x) != "")


def _with_pairs(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with ``_lines``, the trimmed lines that are not blank, and ``_pairs``, structs (label, value, pos, how, low)."""
    raw = F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r"), F.lit("")), "\n")
    rows = _once(documents, F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""), "_lines")
    sort_of = lambda x: F.when(x.rlike(r"\d"), VALUES).when(x.rlike(LABEL), F.when(x.rlike(CELLS), LABEL_CELLS).otherwise(LABEL_LINE)).otherwise(REST)
    pairs = once(F.transform("_lines", sort_of), _pairs_of_sorts)
    return _once(rows, F.transform(pairs, lambda p: p.withField("low", F.lower(p["label"]))), "_pairs")


def _pairs_of_sorts(sorts: Column) -> Column:
    """Pairs of ``_lines`` as structs (label, value, pos, how); ``sorts`` are the sorts of the lines."""
    line, sort = lambda i: F.get("_lines", i), lambda i: F.get(sorts, i)
    n = F.size(sorts)
    begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (sort(i) != sort(i - 1)))
    # the first and the last line of a run that values follow, and of the values the last
    place = lambda starts: lambda start, k: F.struct(start.alias("first"), (F.get(starts, k + 1) - 1).alias("last"), (F.get(starts, k + 2) - 1).alias("end"))
    # where runs of lines of one sort begin, and twice where the last ends
    every = once(F.concat(begins, F.array(n, n)), lambda starts: F.transform(starts, place(starts)))
    places = F.filter(every, lambda p: (sort(p["last"]) != VALUES) & (sort(p["last"] + 1) == VALUES))
    pair = lambda label, value, pos, how: F.struct(_plain(label).alias("label"), F.trim(value).alias("value"), pos.alias("pos"), F.lit(how).alias("how"))
    none = F.array().cast("array<struct<label: string, value: string, pos: int, how: string>>")

    def header(p: Column) -> Column:
        both = F.struct(_cells(line(p["last"])).alias("a"), _cells(line(p["last"] + 1)).alias("b"))
        same = lambda x: F.when((F.size(x["a"]) >= 2) & (F.size(x["a"]) == F.size(x["b"])), F.zip_with(x["a"], x["b"], lambda a, b: pair(a, b, p["last"], "header"))).otherwise(none)
        return F.when(sort(p["last"]) != LABEL_LINE, once(both, same)).otherwise(none)

    labels, values = lambda p: p["last"] - p["first"] + 1, lambda p: p["end"] - p["last"]
    is_block = lambda p: (sort(p["last"]) == LABEL_LINE) & (labels(p) >= 2)

    def turn(p: Column) -> Column:
        value = line(p["last"] + 1)
        single = sort(p["last"]).isin(LABEL_LINE, LABEL_CELLS) & (F.length(value) <= LONGEST_VALUE) & ~value.rlike(CELLS)
        return F.when(single & ~(is_block(p) & (values(p) <= labels(p))), F.array(pair(line(p["last"]), value, p["last"], "row"))).otherwise(none)

    def block(p: Column) -> Column:
        # the last labels belong to the values: what stands above them is a title; if values are more, the last label has the first
        met = F.least(labels(p), values(p))
        first, last = p["last"] - met + 1, p["last"] - F.when(values(p) <= labels(p), 0).otherwise(1)
        each = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: pair(line(i), line(i + met), i, "block"))
        return F.when(is_block(p) & (first <= last), each).otherwise(none)

    return F.flatten(F.transform(places, lambda p: F.concat(header(p), turn(p), block(p))))


def layout_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, value, pos, how) of header rows, of labels and values by turns (row), and of blocks (block).

    A text that is null or empty has no pairs.
    """
    rows = _with_pairs(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    return rows.select("doc_id", F.inline("_pairs")).drop("low")


def amount_kind(low: Column) -> Column:
    """gross, net or vat: the kind of which a label stands first in a lower-cased text; null without any."""
    at = lambda k: F.when(may_match(low, R.AMOUNTS[k]), F.regexp_instr(low, F.lit(rf"(?U)(?<![a-zäöüß])(?:{R.AMOUNTS[k]})(?![a-zäöüß])")))
    places = F.array(*[F.struct(at(k).alias("at"), F.lit(n).alias("n"), F.lit(k).alias("kind")) for n, k in enumerate(KINDS)])
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["kind"]


def _cents(raw: Column) -> Column:
    return F.abs(cents_of_digits(raw))


def _by_groups(entries: Column) -> Column:
    """Of structs (kind, cents, strength, pos) one for each kind and cents, with the most strength and the last place."""
    most = lambda c: F.array_sort(F.transform(entries, lambda e: F.struct(e["kind"].alias("kind"), e["cents"].alias("cents"), (-e[c]).alias(c))))
    other = lambda a, b: (a["kind"] != b["kind"]) | (a["cents"] != b["cents"])
    firsts = lambda every: once(every, lambda s: F.filter(s, lambda e, i: (i == 0) | other(e, F.get(s, i - 1))))
    # both are in the order of kinds and cents
    return F.zip_with(firsts(most("strength")), firsts(most("pos")), lambda a, b: F.struct(a["kind"].alias("kind"), a["cents"].alias("cents"), (-a["strength"]).alias("strength"), (-b["pos"]).alias("pos")))


def _labelled(lines: Column, pairs: Column) -> Column:
    """Structs (kind, cents, strength, pos): amounts that some label calls net, VAT or gross."""
    at = lambda v, k: F.get(v, F.lit(k))
    three = lambda v: (F.size(v) == 3) & (at(v, 0) + at(v, 1) == at(v, 2)) & plausible_rate(at(v, 0), at(v, 1)).isNotNull()
    one = lambda kind, cents, strength, pos: F.struct(kind.alias("kind"), cents.alias("cents"), F.lit(strength).alias("strength"), pos.alias("pos"))
    none = F.array().cast("array<struct<kind: string, cents: bigint, strength: double, pos: int>>")

    def amounts(kind: Column, line: Column, pos: Column) -> Column:
        found = F.transform(F.regexp_extract_all(line, F.lit(ANY_AMOUNT), F.lit(1)), _cents)
        whole = lambda v: F.array(*[one(F.lit(k), at(v, n), WHOLE_ROW, pos) for n, k in enumerate(("net", "vat", "gross"))])
        single = lambda v: F.array(one(kind, F.when(kind == "gross", F.get(v, F.size(v) - 1)).otherwise(at(v, 0)), ON_LINE, pos))
        return once(found, lambda v: F.when(three(v), whole(v)).otherwise(single(v)))

    def on_line(line: Column, pos: Column) -> Column:
        kind = once(F.lower(F.regexp_extract(line, rf"^(.*?){ANY_AMOUNT}", 1)), amount_kind)
        return F.when(line.rlike(r"\d[.,]\d\d"), once(kind, lambda k: F.when(k.isNotNull(), amounts(k, line, pos)).otherwise(none))).otherwise(none)

    def below(p: Column) -> Column:
        raw = F.regexp_extract(p["value"], ANY_AMOUNT, 1)
        strength = F.when(p["how"] == "header", UNDER_HEADER).otherwise(IN_BLOCK)
        return once(raw, lambda r: F.when(r != "", one(amount_kind(p["low"]), _cents(r), 0.0, p["pos"]).withField("strength", strength)))

    every = F.concat(F.flatten(F.transform(lines, on_line)), F.transform(pairs, below))
    return once(F.filter(every, lambda e: e["kind"].isNotNull() & e["cents"].isNotNull()), _by_groups)


def _choices(amounts: Column, kind: str) -> Column:
    """Structs (weak, pos, cents) of the best amounts of a kind, the best first; several of net or VAT count also by their sum. Strengths and places are negative."""
    own = F.filter(amounts, lambda e: e["kind"] == kind)
    one = lambda weak, pos, cents: F.struct(weak.alias("weak"), pos.alias("pos"), cents.alias("cents"))
    each = lambda every: F.transform(every, lambda e: one(-e["strength"], -e["pos"], e["cents"]))
    if kind != "gross":
        total = lambda x: one(F.array_max(F.transform(x, lambda e: e["weak"])) + 1, F.array_min(F.transform(x, lambda e: e["pos"])), F.aggregate(x, F.lit(0).cast("bigint"), lambda a, e: a + e["cents"]))
        return F.slice(F.array_sort(once(each(own), lambda x: F.when(F.size(x) > 1, F.concat(x, F.array(total(x)))).otherwise(x))), 1, CHOICES)
    return F.slice(F.array_sort(each(own)), 1, CHOICES)


def _triple(net: Column, vat: Column, gross: Column) -> Column:
    return F.struct(net.alias("net_cents"), vat.alias("vat_cents"), gross.alias("gross_cents"))


def _adding_up(net: Column, vat: Column, gross: Column) -> Column:
    """Of choices the strongest that add up to a cent, as a struct (net_cents, vat_cents, gross_cents)."""
    diff = lambda n, v, g: F.abs(n["cents"] + v["cents"] - g["cents"])
    rank = lambda n, v, g: F.struct(-(n["weak"] + v["weak"] + g["weak"]), -diff(n, v, g), -g["pos"], g["cents"], n["cents"], v["cents"], _triple(n["cents"], v["cents"], g["cents"]).alias("t"))
    good = lambda n, v: F.transform(F.filter(gross, lambda g: diff(n, v, g) <= 1), lambda g: rank(n, v, g))
    return F.array_max(F.flatten(F.transform(net, lambda n: F.flatten(F.transform(vat, lambda v: good(n, v))))))["t"]


def _unlabelled(text: Column) -> Column:
    """The last amount of a text that is the sum of two before it, one being a usual VAT of the other."""
    amounts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(ANY_AMOUNT), F.lit(1)), _cents), lambda c: c > 0)

    def sums(every: Column, c: Column, k: Column) -> Column:
        before = F.array_distinct(F.slice(every, F.greatest(k - LOOK_BACK, F.lit(0)) + 1, F.least(k, F.lit(LOOK_BACK))))
        # a net amount and what is missing to the sum; the VAT is there itself, give or take a cent
        missing = lambda seen, net: F.filter(F.array_intersect(seen, F.array(*[c - net + d for d in (-1, 0, 1)])), lambda vat: (vat > 0) & (plausible_rate(net, vat) != "0"))
        fit = lambda seen, net: F.transform(missing(seen, net), lambda vat: F.struct(k.alias("k"), net.alias("net"), vat.alias("vat"), _triple(net, vat, c).alias("t")))
        return once(before, lambda seen: F.array_max(F.flatten(F.transform(F.filter(seen, lambda net: net < c), lambda net: fit(seen, net)))))

    return F.array_max(once(amounts, lambda every: F.transform(every, lambda c, k: sums(every, c, k))))["t"]


def _first(pairs: Column, labels: str, value: Callable[[Column], Column]) -> Column:
    """The first value of a label that ``value`` reads."""
    named = F.filter(pairs, lambda p: may_match(p["low"], labels) & p["low"].rlike(rf"(?U)(?<![a-zäöüß])(?:{labels})(?![a-zäöüß])"))
    read = F.transform(named, lambda p: F.struct(p["pos"], p["value"], value(p["value"]).alias("read")))
    return F.array_min(F.filter(read, lambda x: x["read"].isNotNull()))["read"]


def read_layouts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with columns ``_layout_net_cents``, vat_cents, gross_cents, vat_rate, consistent, derived, invoice_number, document_date and due_date.

    Several rates: the amounts of net and of VAT count also by their sum. One missing amount is derived from the other
    two, two from gross and a printed rate; ``derived`` names them. Number and dates are those that stand below their labels.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = _once(_with_pairs(documents, text), _labelled(F.col("_lines"), F.col("_pairs")), "_amounts")
    rows = _once(rows, F.struct(*[_choices(F.col("_amounts"), k).alias(k) for k in KINDS]), "_best")
    top = {k: F.get(f"_best.{k}", F.lit(0))["cents"] for k in KINDS}
    rate_text = r"(?iU)(\d{1,2}(?:[.,]\d+)?)\s*%\s*(?:mwst|ust|mehrwertsteuer|umsatzsteuer|vat|tva|iva|btw)"
    rate = F.when(F.contains(t, F.lit("%")), F.replace(F.nullif(F.regexp_extract(t, rate_text, 1), F.lit("")), F.lit(","), F.lit(".")))
    sure = F.array(*[F.col(f"_best.{k}") for k in ("net", "vat", "gross")])
    sure = once(sure, lambda best: _adding_up(*[F.get(best, F.lit(k)) for k in range(3)]))
    g, n, v = (top[k] for k in KINDS)
    may = lambda own: g.isNull() | (F.abs(g - own["gross_cents"]) <= 1) | n.isNull() | v.isNull()
    own = once(_unlabelled(t), lambda x: F.when(may(x), x))
    rows = _once(rows, F.struct(F.coalesce(sure, own).alias("t"), rate.alias("printed")), "_sums")
    g, n, v = (F.coalesce(F.col("_sums.t")[f"{k}_cents"], top[k]) for k in KINDS)
    usual = F.when(F.col("_sums.printed").try_cast("double").isin(*map(float, VAT_RATES)), F.col("_sums.printed").try_cast("double"))
    rated = F.when(n.isNull() & v.isNull(), F.round(g / (1 + usual / 100), 0).cast("bigint"))
    new_n = F.coalesce(n, F.when(g >= v, g - v), rated)
    new_g = F.coalesce(g, n + v)
    new_v = F.coalesce(v, F.when(new_g >= new_n, new_g - new_n))
    told = F.array_join(F.array_compact(F.array(*[F.when(a.isNull() & b.isNotNull(), k) for a, b, k in ((n, new_n, "net"), (v, new_v, "vat"), (g, new_g, "gross"))])), ",")
    out = rows.withColumns({f"{PREFIX}net_cents": new_n, f"{PREFIX}vat_cents": new_v, f"{PREFIX}gross_cents": new_g, f"{PREFIX}derived": told})
    net, vat, gross = (F.col(f"{PREFIX}{k}_cents") for k in ("net", "vat", "gross"))
    number = lambda x: F.nullif(F.regexp_extract(x, r"^((?=[\w\-/.]*\d)[\w\-/.]{2,32})$", 1), F.lit(""))
    more = {
        "consistent": F.coalesce(F.abs(net + vat - gross) <= 1, F.lit(False)), "vat_rate": F.coalesce("_sums.printed", F.when(net > 0, plausible_rate(net, vat))),
        "invoice_number": _first(F.col("_pairs"), R.INVOICE_NUMBER, number), "document_date": _first(F.col("_pairs"), R.DATES["document"], parse_any_date), "due_date": _first(F.col("_pairs"), R.DATES["due"], parse_any_date),
    }
    return out.withColumns({f"{PREFIX}{k}": c for k, c in more.items()}).select(*documents.columns, *[f"{PREFIX}{k}" for k in ADDED])


def invoice_amounts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, net_cents, vat_cents, gross_cents, vat_rate, consistent, derived) of every text, as of ``read_layouts``."""
    rows = read_layouts(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return rows.select("doc_id", *[F.col(f"{PREFIX}{k}").alias(k) for k in ADDED[:6]])


def complete_fields(fields: DataFrame) -> DataFrame:
    """``fields`` of labelled lines with what ``read_layouts`` added to their rows: amounts that add up replace others, empty fields are filled.

    ``amounts_agree`` says whether net and VAT make gross.
    """
    agree, added = F.col(f"{PREFIX}consistent"), lambda c: F.col(f"{PREFIX}{c}")
    fills = {c: F.coalesce(F.when(agree, added(c)), F.col(c), added(c)) for c in ("net_cents", "vat_cents", "gross_cents")}
    fills |= {c: F.coalesce(F.col(c), added(c)) for c in ("invoice_number", "document_date", "due_date")}
    kept = [fills[c].alias(c) if c in fills else F.col(c) for c in fields.columns if not c.startswith(PREFIX)]
    return fields.select(*kept, agree.alias("amounts_agree"))
