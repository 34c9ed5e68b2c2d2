"""Due dates, aging buckets, months and printed dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the months in the languages of the documents.
MONTHS = {
    1: "januar january janvier gennaio enero januari jan",
    2: "februar february février fevrier febbraio febrero februari feb",
    3: "märz maerz march mars marzo maart mar mär",
    4: "april avril aprile abril apr",
    5: "mai may maggio mayo mei",
    6: "juni june juin giugno junio jun",
    7: "juli july juillet luglio julio jul",
    8: "august août aout agosto augustus aug",
    9: "september septembre settembre septiembre sep sept",
    10: "oktober october octobre ottobre octubre okt oct",
    11: "november novembre noviembre nov",
    12: "dezember december décembre decembre dicembre diciembre dez dec",
}
MONTH_NUMBER = {name: n for n, names in MONTHS.items() for name in names.split()}
MONTH_NAMES = "|".join(sorted(MONTH_NUMBER, key=lambda x: (-len(x), x)))


def overdue_days(due: Column, as_of: Column) -> Column:
    """Days after the due date, none before it or without one."""
    return F.greatest(F.lit(0), F.coalesce(F.datediff(as_of, due), F.lit(0)))


def aging_bucket(due: Column, as_of: Column) -> Column:
    """The bucket of an open item; what is due today, or has no due date, is not due."""
    late = F.datediff(as_of, due)
    return (
        F.when(late.isNull() | (late <= 0), "not_due").when(late <= 30, "1-30").when(late <= 60, "31-60").when(late <= 90, "61-90").otherwise("90+")
    )


def add_months(start: Column, months: Column, day: Column) -> Column:
    """The given day in the month so many months after that of ``start``; days beyond its end are its last day."""
    month = F.add_months(F.trunc(start, "MM"), months.cast("int"))
    return F.least(F.last_day(month), F.date_add(month, (day - 1).cast("int")))


def period_start(day: Column, period: str) -> Column:
    """First day of the month, quarter or year."""
    return F.trunc(day, {"month": "MM", "quarter": "QUARTER", "year": "YEAR"}[period])


def make_day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none."""
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
    return text.try_cast("date")


def full_year(year: Column) -> Column:
    """Two digits mean this century."""
    number = year.try_cast("int")
    return F.when(number < 100, number + 2000).otherwise(number)


def parse_day(value: Column) -> Column:
    """The first ``d.m.yyyy``, ``d.m.yy`` or ``yyyy-mm-dd`` in a text; null if that is no date."""
    first = F.regexp_extract(value, r"(\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2})", 1)
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$"
    part = lambda k: F.regexp_extract(first, dotted, k)
    return F.when(first.rlike(dotted), make_day(full_year(part(3)), part(2), part(1))).otherwise(first.try_cast("date"))


def parse_any_date(value: Column) -> Column:
    """A printed date: day month year (month first only if the second number can't be a month), year first, or with a name."""
    text = F.lower(F.trim(value))
    dmy, ymd = r"^(\d{1,2})\s?[./-]\s?(\d{1,2})\s?[./-]\s?(\d{4}|\d{2})$", r"^(\d{4})\s?[./-]\s?(\d{1,2})\s?[./-]\s?(\d{1,2})$"
    named, first = rf"^(\d{{1,2}})(?:st|nd|rd|th|\.|er)?\s+(?:de\s+)?({MONTH_NAMES})\.?,?\s+(?:de\s+)?(\d{{4}})$", rf"^({MONTH_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})$"
    g = lambda rx, k: F.regexp_extract(text, rx, k)
    number = F.create_map(*[F.lit(x) for pair in MONTH_NUMBER.items() for x in pair])
    a, b = g(dmy, 1).try_cast("int"), g(dmy, 2).try_cast("int")
    american = (b > 12) & (a <= 12)
    return (
        F.when(text.rlike(dmy), make_day(full_year(g(dmy, 3)), F.when(american, a).otherwise(b), F.when(american, b).otherwise(a)))
        .when(text.rlike(ymd), make_day(g(ymd, 1), g(ymd, 2), g(ymd, 3)))
        .when(text.rlike(named), make_day(g(named, 3), F.try_element_at(number, g(named, 2)), g(named, 1)))
        .when(text.rlike(first), make_day(g(first, 3), F.try_element_at(number, g(first, 1)), g(first, 2)))
    )


def format_day(value: Column) -> Column:
    """``dd.mm.yyyy``; an empty string for null."""
    return F.coalesce(F.date_format(value, "dd.MM.yyyy"), F.lit(""))
