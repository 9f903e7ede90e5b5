"""Date expressions."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern of the text, format after its separators became slashes.
FORMATS = (
    (r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}", "d/M/yyyy"),
    (r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2}$", "d/M/yy"),
    (r"^\d{1,2}[/\-.\s][A-Za-z]{3}[/\-.\s]\d{4}", "d/MMM/yyyy"),
    (r"^\d{1,2}[/\-.\s][A-Za-z]{3}[/\-.\s]\d{2}$", "d/MMM/yy"),
)


def _read(bare: Column) -> Column:
    """The date that a trimmed text is or begins with, in whatever year."""
    found = []
    for pattern, form in FORMATS:
        part = F.regexp_replace(F.regexp_extract(bare, pattern, 0), r"[\-.\s]", "/")
        if "MMM" in form:
            part = F.initcap(F.lower(F.regexp_replace(part, "/", " ")))
            form = form.replace("/", " ")
        found.append(F.when(bare.rlike(pattern), F.try_to_timestamp(part, F.lit(form)).cast("date")))
    return F.coalesce(*found)


def _within(parsed: Column, as_of: date, least_year: int) -> Column:
    return F.when((F.year(parsed) >= least_year) & (F.year(parsed) <= min(as_of.year + 2, 2099)), parsed)


def parse_date(text: Column, as_of: date, least_year: int = 2010) -> Column:
    """Day-first dates of statements; null if unreadable, before ``least_year`` or after the second year from ``as_of``."""
    return _within(_read(F.trim(text)), as_of, least_year)


def dated(rows: DataFrame, name: str, text: Column, as_of: date, least_year: int = 2010) -> DataFrame:
    """``rows`` with ``parse_date`` of a text as a column. In steps: ``parse_date`` names its text and what it read many times over, and works them out as often."""
    steps = rows.withColumn("_bare", F.trim(text)).withColumn("_read", _read(F.col("_bare")))
    return steps.withColumn(name, _within(F.col("_read"), as_of, least_year)).drop("_bare", "_read")


def fy_start(day: Column) -> Column:
    """The calendar year in which the financial year of a date (April to March) starts."""
    return F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)


def fy_label(day: Column) -> Column:
    start = fy_start(day)
    return F.format_string("%04d-%02d", start, (start + 1) % 100)


def fy_bounds(text: str) -> tuple[date, date]:
    """First and last day of ``FY24-25``, ``24-25``, ``2024-25`` or ``2024-2025``."""
    m = re.fullmatch(r"\s*(?:FY)?\s*(\d{4}|\d{2})\s*[-/]\s*(\d{4}|\d{2})\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a financial year: {text!r}")
    first, second = (int(x) if len(x) == 4 else 2000 + int(x) for x in m.groups())
    if second < first:
        second += 100
    return date(first, 4, 1), date(second, 3, 31)


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def plus_months(day: Column, months: Column | int, target_day: Column) -> Column:
    """The target day of the month so many months on, or that month's last day."""
    first = F.add_months(F.trunc(day, "MM"), months)
    return F.make_date(F.year(first), F.month(first), F.least(target_day.cast("int"), F.dayofmonth(F.last_day(first))))


def subscription_status(active: Column, next_date: Column, as_of: Column) -> Column:
    left = F.datediff(next_date, as_of)
    return F.when(~active, "inactive").when(left < 0, "overdue").when(left <= 7, "upcoming").otherwise("scheduled")


def annual_multiplier(frequency: Column) -> Column:
    return F.when(frequency == "quarterly", 4).when(frequency == "yearly", 1).otherwise(12)
