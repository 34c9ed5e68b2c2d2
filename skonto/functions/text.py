"""Names, references and bank details as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How German letters are written in ASCII, and accents that are dropped.
DIGRAPHS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))
ACCENTED = "àáâãåçèéêëìíîïñòóôõùúûýÿÀÁÂÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÙÚÛÝŸ"
PLAIN = "aaaaaceeeeiiiinoooouuuyyAAAAACEEEEIIIINOOOOUUUYY"
LEGAL_FORMS = r"(?i)\b(gmbh|ug|ag|kg|ohg|gbr|e\.?\s?k\.?|mbh|co|und|u|&|inc|ltd|llc|se|kgaa|e\.?\s?v\.?)\b"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time, however often it is used: within a condition Spark repeats it for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_ascii(value: Column) -> Column:
    """Whether a text has as many bytes as characters: most have, and need none of the steps for other letters."""
    return F.octet_length(value) == F.length(value)


def _plain(value: Column) -> Column:
    for letter, digraph in DIGRAPHS:
        value = F.replace(value, F.lit(letter), F.lit(digraph))
    return F.regexp_replace(F.translate(value, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def to_ascii(value: Column) -> Column:
    """German letters as digraphs, other accents dropped, whatever else is not ASCII removed."""
    return F.when(_is_ascii(value), value).otherwise(_plain(value))


def normalize_reference(value: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(to_ascii(value)), "[^0-9A-Z]", "")


def spaced_reference(value: Column) -> Column:
    """As ``normalize_reference``, with a blank wherever something else stood: without blanks both are equal."""
    marks = F.regexp_replace(value, rf"[^\x00-\x7FäöüÄÖÜß{ACCENTED}]", " ")
    return F.regexp_replace(F.upper(F.when(_is_ascii(value), value).otherwise(_plain(marks))), "[^0-9A-Z]+", " ")


def inside_runs(spaced: Column) -> Column:
    """For each character of a spaced reference that is no blank a ``+`` if the next one continues its run of digits, else a point."""
    return F.replace(F.regexp_replace(F.regexp_replace(spaced, "[0-9](?=[0-9])", "+"), "[0-9A-Z]", "."), F.lit(" "), F.lit(""))


def normalize_iban(value: Column) -> Column:
    """Without white space, upper-case."""
    return F.upper(F.regexp_replace(value, r"\s+", ""))


def normalize_name(value: Column) -> Column:
    """Lower-case words without legal forms and punctuation."""
    plain = F.replace(F.lower(to_ascii(value)), F.lit("&"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, LEGAL_FORMS, " "), "[^a-z0-9]+", " "))


def valid_iban(value: Column) -> Column:
    """Shape and checksum modulo 97; null stays null."""
    iban = normalize_iban(value)
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    digit = lambda c: F.conv(c, 36, 10).cast("int")
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97))
    return F.when(iban.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"), rest == 1).otherwise(F.when(value.isNotNull(), F.lit(False)))


def valid_vat_id(value: Column) -> Column:
    """German numbers have nine digits, others two to twelve letters or digits."""
    vat = F.upper(F.regexp_replace(value, r"\s+", ""))
    return F.when(vat.startswith("DE"), vat.rlike(r"^DE\d{9}$")).otherwise(vat.rlike(r"^[A-Z]{2}[A-Z0-9]{2,12}$"))


def find_iban(value: Column) -> Column:
    """The first valid IBAN in a text: of each candidate its longest prefix with a right checksum; else an empty string."""
    upper = F.upper(value)
    found = F.transform(F.regexp_extract_all(upper, F.lit(r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}"), F.lit(0)), lambda x: F.substr(F.regexp_replace(x, r"\s+", ""), F.lit(1), F.lit(34)))
    prefixes = F.flatten(F.transform(found, lambda x: F.when(F.length(x) >= 15, F.transform(F.sequence(F.length(x), F.lit(15)), lambda n: F.substr(x, F.lit(1), n))).otherwise(F.array().cast("array<string>"))))
    return F.coalesce(F.get(F.filter(prefixes, valid_iban), F.lit(0)), F.lit(""))


def fold(value: Column) -> Column:
    """For full-text search: lower-case letters and digits without accents (ü becomes u), blanks between."""
    lower = F.translate(F.lower(value), "äöü" + ACCENTED, "aou" + PLAIN)
    return F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " "))


def registrable(domain: Column) -> Column:
    """The last two labels of a domain; three for the like of ``co.uk``."""
    labels = F.split(F.lower(domain), r"\.")
    many = F.element_at(labels, -2).isin("co", "com", "org", "net", "gov", "ac")
    short = F.length(F.element_at(labels, -1)) == 2
    keep = F.when((F.size(labels) >= 3) & many & short, 3).otherwise(2)
    return F.when(F.size(labels) < 2, F.lower(domain)).otherwise(F.array_join(F.slice(labels, -F.least(keep, F.size(labels)), F.least(keep, F.size(labels))), "."))


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of parts joined by bars; null counts as empty."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def lower_ascii(value: Column) -> Column:
    """A to Z written small, all else as it is."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def safe_name(value: Column) -> Column:
    """A text as a file's name: letters, digits and ``_.-()`` and blanks, 120 characters at most; ``dokument`` if nothing is left, and for null."""
    kept = F.regexp_replace(F.regexp_replace(value, r"(?U)[^\w.\- ()]", "_"), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 120), F.lit("")), F.lit("dokument"))


def sheet_title(value: Column) -> Column:
    """A text as a sheet's title: 28 characters at most, none that spreadsheets forbid; ``Bericht`` if nothing is left, and for null."""
    kept = F.regexp_replace(F.regexp_replace(value, r"[\[\]:*?/\\]", "-"), r"^[' ]+|[' ]+$", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 28), F.lit("")), F.lit("Bericht"))
