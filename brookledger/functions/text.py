"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

OR = lambda a, b: a | b


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the text holds one of the words; one pattern, so that generated code stays small."""
    words = list(words)
    return text.contains(words[0]) if len(words) == 1 else text.rlike("|".join(map(re.escape, words)))


def says(text: Column, words: Iterable[str]) -> Column:
    """Whether the text holds one of the words, without regard to case and to how its words are spaced."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    return reduce(OR, (text.rlike(p) for p in patterns))


def first_group(text: Column, patterns: Iterable[str], group: int = 1) -> Column:
    """What the first matching pattern captures, else null."""
    return F.coalesce(*(F.when(text.rlike(p), F.nullif(F.regexp_extract(text, p, group), F.lit(""))) for p in patterns))


def first_rule(text: Column, ordered: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The value of the first rule one of whose words the text says."""
    return F.coalesce(*(F.when(says(text, words), F.lit(value)) for words, value in ordered))


def choose(*rules_: tuple[Column, str], default: str) -> Column:
    """The value of the first rule that holds. Not a CASE: the optimizer would push comparisons with its
    value into every branch, and long chains of conditions would multiply."""
    return F.coalesce(*(F.when(c, F.lit(v)) for c, v in rules_), F.lit(default))


def collapse(text: Column) -> Column:
    """White space collapsed and trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def upper(text: Column) -> Column:
    return F.upper(collapse(text))


def plain_words(text: Column) -> Column:
    """Upper case; anything but A-Z, 0-9 and space is a space; collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9 ]", " "), " +", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters and digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]{2,})"), 1), F.lower)


def statement_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s_\-/\\]+", " "))


def keyword_tokens(text: Column, limit: int | None = 80) -> Column:
    """The distinct among the first ``limit`` telling words of a statement, or among all if None."""
    found = F.regexp_extract_all(statement_words(text), F.lit("([a-z0-9]{3,})"), 1)
    told = F.filter(found, lambda w: ~w.isin(*rules.STATEMENT_STOPWORDS) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(told if limit is None else F.slice(told, 1, limit))


def merchant_hint(text: Column) -> Column:
    """Up to four words of more than two letters that aren't generic."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^A-Z\s]", " "), r"\s+", " ")), " ")
    return F.array_join(F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*rules.GENERIC_WORDS)), 1, 4), " ")


def slug(*parts: Column, default: str = "position") -> Column:
    """Parts in lower case, joined by ``-``; other characters give way to it."""
    joined = F.concat_ws("-", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))
    made = F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def mask_tail(text: Column, shown: int = 4) -> Column:
    """All but the last characters as X."""
    n = F.length(text)
    return F.when(n <= shown, text).otherwise(F.concat(F.repeat(F.lit("X"), n - shown), F.right(text, F.lit(shown))))


def append_note(note: Column, message: str) -> Column:
    """The note with the message on a new line, unless it is there already."""
    return (
        F.when(F.coalesce(note, F.lit("")) == "", F.lit(message))
        .when(note.contains(message), note)
        .otherwise(F.concat(note, F.lit("\n"), F.lit(message)))
    )


def low_signal(page: Column, least_chars: int = 60, least_alpha: float = 0.15) -> Column:
    """Whether a page has too little text to parse."""
    text = F.trim(F.coalesce(page, F.lit("")))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.length(text) < least_chars) | (letters / F.greatest(F.length(text), F.lit(1)) < least_alpha)


def difficulty(pages: Column, chars: Column, lines: Column, noise_percent: Column) -> Column:
    return (
        F.least(F.lit(4.0), pages / 4.0) + F.least(F.lit(3.0), chars / 14000.0)
        + F.least(F.lit(2.0), lines / 1200.0) + F.least(F.lit(1.5), noise_percent / 3.0)
    )


def difficulty_band(score: Column) -> Column:
    return F.when(score < 3.5, "low").when(score < 6.5, "medium").otherwise("high")


def looks_like_row(line: Column) -> Column:
    """Whether a line of a statement looks like an entry."""
    low = F.lower(F.trim(line))
    dated = low.rlike(r"\b\d{1,2}[/\-. ](\d{1,2}|[a-z]{3})[/\-. ]\d{2,4}\b")
    total = contains_any(low, ("opening balance", "closing balance", "total amount due"))
    return (F.length(low) >= 8) & dated & ~total & low.rlike(r"\d[\d,]*\.\d{2}\b") & low.rlike("[a-z]")


def expected_rows(page_text: Column, table_rows: Column) -> Column:
    """How many entries a statement should give: its table rows or lines that look like one, whichever are more."""
    n = lambda lines: F.size(F.filter(lines, looks_like_row))
    return F.greatest(n(F.coalesce(table_rows, F.array().cast("array<string>"))), n(F.split(F.coalesce(page_text, F.lit("")), "\n")))


def label(bank: Column, account_type: Column) -> Column:
    """Display label such as ``Kotak Saving``."""
    def table(values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    raw = F.nullif(F.trim(bank), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(raw, "_", " "), r"\s+"), lambda w: w != "")
    shown = F.transform(words, lambda w: F.when((F.length(w) <= 4) & (w == F.upper(w)) & (w != F.lower(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))))
    bank_name = F.coalesce(table(rules.BANK_LABEL)[F.upper(raw)], F.array_join(shown, " "))
    kind = F.nullif(F.trim(account_type), F.lit(""))
    suffix = F.coalesce(table(rules.ACCOUNT_SUFFIX)[F.lower(kind)], F.initcap(F.regexp_replace(kind, "_", " ")))
    return F.nullif(F.concat_ws(" ", bank_name, suffix), F.lit(""))
