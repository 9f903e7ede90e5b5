"""Money expressions. Amounts are decimals; rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCY = r"(?i)(?:rs\.?|inr|₹)"
NUMBER = r"(-?\d+(?:\.\d+)?)"


def paise(amount: Column) -> Column:
    return (F.round(F.abs(amount.cast("decimal(20,6)")), 2) * 100).cast("long")


def as_double(amount: Column, places: int = 2) -> Column:
    """For results only."""
    return F.round(amount, places).cast("double")


def parse_inr(text: Column) -> Column:
    """Statement amounts such as ``Rs. 1,23,456.78`` or ``(500)``; parentheses mean less than zero. Null without a number."""
    bare = F.regexp_replace(F.trim(text), r"(?i)(?:Rs\.?|INR|₹)\s*", "")
    bare = F.regexp_replace(bare, r"^C\s*", "")
    negative = bare.startswith("(") & bare.endswith(")")
    number = F.nullif(F.regexp_extract(F.regexp_replace(bare, "[,()]", ""), r"(\d+\.?\d*)", 1), F.lit(""))
    value = number.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, CURRENCY, ""), ",", ""))


def parse_decimal(text: Column, signed: bool = False) -> Column:
    """decimal(14,2), half up; without a sign unless ``signed``."""
    bare = _bare(text)
    value = F.round(F.nullif(F.regexp_extract(bare, NUMBER, 1), F.lit("")).try_cast("decimal(20,6)"), 2).cast("decimal(14,2)")
    if not signed:
        return F.abs(value)
    return F.when(bare.startswith("(") & bare.endswith(")"), -value).otherwise(value)


def at_most_two_decimals(text: Column) -> Column:
    number = F.regexp_extract(_bare(text), NUMBER, 1)
    return F.coalesce((number != "") & ~number.rlike(r"\.\d{3,}$"), F.lit(False))


def credit_flag(kind: Column) -> Column:
    """True for credit, false for debit, null if it can't be told."""
    value = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(kind, F.lit(""))), r"\.", " "), r"\s+", " "))
    return (
        F.when(value.isin("CR", "C", "CREDIT", "DEPOSIT") | value.endswith(" CR"), True)
        .when(value.isin("DR", "D", "DEBIT", "WITHDRAWAL") | value.endswith(" DR"), False)
    )


def total(amount: Column, condition: Column) -> Column:
    """Sum of the amounts where the condition holds, 0 where none does."""
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0).cast("decimal(24,2)"))
