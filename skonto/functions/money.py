"""Money is a signed integer number of cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# VAT rates in per cent that are looked for, in this order.
VAT_RATES = ("19", "7", "20", "10", "13", "21", "22", "9", "5.5", "8.1", "7.7", "2.6", "16", "5", "23", "25", "24", "12", "6", "4", "17", "18", "27", "3.7", "2.5", "0")


def decimal_text(digits: Column) -> Column:
    """A number with any grouping as a decimal text: the last of comma and point is the decimal mark."""
    comma, point = F.regexp_count(digits, F.lit(",")), F.regexp_count(digits, F.lit(r"\."))
    last = F.regexp_extract(digits, r"([.,])[^.,]*$", 1)
    after = F.length(F.regexp_extract(digits, r"[.,]([^.,]*)$", 1))
    marked = F.when((comma > 0) & (point > 0), True).when(comma > 0, comma == 1).otherwise((point == 1) & after.isin(1, 2))
    whole = F.regexp_replace(F.regexp_replace(digits, r"[.,][^.,]*$", ""), "[.,]", "")
    split = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.lit("."), F.regexp_extract(digits, r"[.,]([^.,]*)$", 1), F.lit("0"))
    return F.when(marked & (last != ""), split).otherwise(F.regexp_replace(digits, "[.,]", ""))


def parse_amount(value: Column) -> Column:
    """Cents of a German or English amount, rounded half up; null if the text is not a number."""
    raw = F.trim(F.regexp_replace(value, "€|EUR| ", ""))
    trailing = raw.endswith("-")
    raw = F.trim(F.regexp_replace(raw, "-$", ""))
    leading = raw.startswith("-")
    raw = F.regexp_replace(F.trim(F.regexp_replace(raw, r"^[+-]", "")), "[ ']", "")
    number = F.when(raw.rlike(r"^\d[\d.,]*$"), decimal_text(raw))
    cents = F.round(number.try_cast("decimal(30,6)") * 100, 0).cast("bigint")
    return F.when(trailing | leading, -cents).otherwise(cents)


def cents_of_digits(value: Column) -> Column:
    """Cents of a number whose last mark stands before two digits, however the others are grouped: its digits are the cents. Null beyond 64 bits, and for an empty text."""
    return F.translate(value, "., '’", "").try_cast("bigint")


def parse_cents(value: Column) -> Column:
    """Cents of an amount in a bank file: trailing S or - and leading - are negative; digits after the second are refused."""
    raw = F.regexp_replace(F.trim(value), "€|EUR|[  ]", "")
    negative_end, raw1 = raw.rlike("[-Ss]$"), F.regexp_replace(raw, "[-+SsHh]$", "")
    negative_start, digits = raw1.startswith("-"), F.regexp_replace(raw1, r"^[+-]", "")
    comma, point = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    comma_last = F.regexp_extract(digits, r"([.,])[^.,]*$", 1) == ","
    plain = (
        F.when(comma & point, F.when(comma_last, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit(""))))
        .when(comma, F.replace(digits, F.lit(","), F.lit(".")))
        .when(F.regexp_count(digits, F.lit(r"\.")) > 1, F.replace(digits, F.lit("."), F.lit("")))
        .otherwise(digits)
    )
    cents = F.when(plain.rlike(r"^\d+(\.\d{1,2})?$"), (plain.try_cast("decimal(30,2)") * 100).cast("bigint"))
    return F.when(negative_end != negative_start, -cents).otherwise(cents)


def format_cents(cents: Column, symbol: bool = True, plus: bool = False) -> Column:
    """``1.234,56 €``."""
    size = F.abs(cents)
    euros = F.translate(F.format_number((size - size % 100) / 100, 0), ",", ".")
    sign = F.when(cents < 0, "-").when(F.lit(plus) & (cents > 0), "+").otherwise("")
    return F.concat(sign, euros, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"), F.lit(" €" if symbol else ""))


def percent_of(cents: Column, rate: Column) -> Column:
    """A percentage, rounded half up."""
    return F.round(cents.cast("decimal(24,0)") * rate.cast("decimal(9,4)") / 100, 0).cast("bigint")


def compute_amounts(net: Column, vat_rate: Column, gross: Column) -> Column:
    """Struct of net, vat, gross: what is missing is derived by the rate; ``error`` says why that failed."""
    rate = vat_rate.cast("decimal(9,4)")
    derived_net = F.round(gross.cast("decimal(24,4)") * 100 / (rate + 100), 0).cast("bigint")
    full_net = F.coalesce(net, derived_net)
    full_gross = F.coalesce(gross, net + percent_of(net, vat_rate))
    error = F.when(full_net.isNull() | full_gross.isNull(), "MISSING_AMOUNT").when(full_gross <= 0, "NOT_POSITIVE").when(
        F.abs(full_net + percent_of(full_net, vat_rate) - full_gross) > 1, "NET_VAT_GROSS"
    )
    return F.struct(full_net.alias("net"), (full_gross - full_net).alias("vat"), full_gross.alias("gross"), error.alias("error"))


def plausible_rate(net: Column, vat: Column) -> Column:
    """The first usual VAT rate that fits, as text; half cents round to the even cent."""
    fits = [F.when(F.abs(F.rint(net * float(r) / 100) - vat) <= F.greatest(F.lit(2.0), F.rint(net * 0.0005)), F.lit(r)) for r in VAT_RATES]
    return F.coalesce(*fits)
