"""Validity intervals and dates. Every function takes its day as a parameter; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_on(start: Column, end: Column, day: Column) -> Column:
    """Half-open interval [start, end); an open side is unbounded."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (end > day))


def decided_by(decided: Column, day: Column, unknown: bool) -> Column:
    """Decided on the day or before; `unknown` says whether a missing date passes."""
    return F.coalesce(decided <= day, F.lit(unknown))


def typed_validity(kind: Column, start: Column, end: Column, decided: Column, day: Column) -> Column:
    """Statutes by their interval (a missing start gives null), judgments by their date, the rest always."""
    return F.when(kind == "statute", (start <= day) & (end.isNull() | (end > day))).when(kind == "judgment", decided <= day).otherwise(F.lit(True))


def query_date(text: Column) -> Column:
    """dd/mm/yyyy, then `d Month yyyy`, then a bare year's last day; null if none is found."""
    slash = F.regexp_extract(text, r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1)
    long_ = F.regexp_extract(text, r"([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})", 1)
    year = F.regexp_extract(text, r"\b(1[89][0-9]{2}|2[0-4][0-9]{2})\b", 1)
    return F.coalesce(F.try_to_date(slash, "d/M/yyyy"), F.try_to_date(long_, "d MMMM yyyy"), F.try_to_date(F.concat(year, F.lit("-12-31")), "yyyy-MM-dd"))


#: Months by the first letters that name them, each with the rest of its name.
MONTHS = {"jan": "uary", "feb": "ruary", "mar": "ch", "apr": "il", "may": "", "jun": "e", "jul": "y", "aug": "ust", "sep": "tember", "oct": "ober", "nov": "ember", "dec": "ember"}
SLASHED = r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b"
NAMED = r"(?i)\b([0-9]{1,2})\s+(" + "|".join(f"{a}(?:{b})?" if b else a for a, b in MONTHS.items()) + r")\s+([0-9]{4})\b"
YEAR = r"\b([0-9]{4})\b"


def build_date(year: Column, month: Column, day: Column) -> Column:
    """A year below 100 is of this century up to 69, else of the last; a day that the month doesn't have is the 28th at most. Null if there is no such month."""
    y = F.when(year < 100, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    made = lambda d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, d), "yyyy-MM-dd")
    return F.coalesce(made(day), made(F.least(day, F.lit(28))))


def query_context(text: Column, today: Column) -> Column:
    """day, source and confidence of the date that a question is about: a date in figures, one with a named month, a year's last day (2023 with the new code's name: its first day), else today."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    number = lambda pattern, i: F.when(part(pattern, i) != "", part(pattern, i)).cast("int")
    month = sum((F.when(F.lower(F.left(part(NAMED, 2), F.lit(3))) == m, k).otherwise(0) for k, m in enumerate(MONTHS, 1)), F.lit(0))
    year, code = number(YEAR, 1), F.lower(text).rlike("bharatiya nyaya sanhita|bns")
    told = lambda day, source, confidence: F.struct(day.alias("day"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    return (
        F.when(text.rlike(SLASHED), told(build_date(number(SLASHED, 3), number(SLASHED, 2), number(SLASHED, 1)), "explicit", 0.9))
        .when(text.rlike(NAMED), told(build_date(number(NAMED, 3), month, number(NAMED, 1)), "explicit", 0.9))
        .when((year == 2023) & code, told(F.lit("2024-07-01").cast("date"), "acts_inference", 0.7))
        .when(year.between(1800, 2500), told(F.try_to_date(F.concat(part(YEAR, 1), F.lit("-12-31")), "yyyy-MM-dd"), "inferred_year", 0.5))
        .otherwise(told(today, "default", 0.2))
    )


def applicable_code(day: Column, change: str = "2024-07-01") -> Column:
    return F.when(day >= F.lit(change).cast("date"), "new").otherwise("old")


def recency(day: Column, today: Column) -> Column:
    """1 / (1 + years), years of 365 days."""
    return 1 / (1 + F.datediff(today, day) / 365.0)
