"""Rows out of the text of statements and tax documents.

Everything is regular expressions inside the JVM: what stands around a match is read
by lookarounds, and rows that repeat are met by grouping slim rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, dates, money
from ..functions import text as texts

DAY = r"(\d{1,2}[/\-. ](?:\d{1,2}|[A-Za-z]{3})[/\-. ]\d{2,4})"
AMOUNT = r"([\d,]+\.\d{2})"
#: Row shapes of statements, tried in order: name, pattern, groups of (date, description, amount, kind, balance); 0 where there is none.
SHAPES = (
    ("two_dates", rf"(?i)^\s*{DAY}\s+{DAY}\s+(.+?)\s+{AMOUNT}\s+{AMOUNT}\s*$", (1, 3, 4, 0, 5)),
    ("with_mark", rf"(?i)^\s*{DAY}\s+(.+?)\s+{AMOUNT}\s*(CR|DR)\.?(?:\s+{AMOUNT})?\s*$", (1, 2, 3, 4, 5)),
    ("card_credit", rf"(?i)^\s*{DAY}\s+(.+?)\s+(\+)\s*(?:C\s*)?{AMOUNT}\s*$", (1, 2, 4, 3, 0)),
    ("with_balance", rf"(?i)^\s*{DAY}\s+(.+?)\s+{AMOUNT}\s+{AMOUNT}\s*$", (1, 2, 3, 0, 4)),
    ("plain", rf"(?i)^\s*{DAY}\s+(.+?)\s+(?:C\s*)?{AMOUNT}\s*$", (1, 2, 3, 0, 0)),
)


def statement_lines(lines: DataFrame, shapes: Sequence[tuple] = SHAPES) -> DataFrame:
    """Raw rows (date_raw, description_raw, amount_raw, txn_type_raw, balance_raw) of the lines (doc_id, line_no, text) that a shape fits.

    Lines that continue an entry are joined by balance.joined_lines first;
    directions that no mark tells follow from balances by balance.directions.
    """
    def field(k: int) -> Column:
        none = F.lit(None).cast("string")
        return F.coalesce(*(F.when(F.col("text").rlike(p), F.nullif(F.regexp_extract("text", p, g[k]), F.lit("")) if g[k] else F.lit("")) for _, p, g in shapes), none)

    fits = F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p, _ in shapes))
    kind = field(3)
    return lines.withColumn("shape", fits).where("shape IS NOT NULL").select(
        "doc_id", "line_no", "shape", field(0).alias("date_raw"), field(1).alias("description_raw"), field(2).alias("amount_raw"),
        F.when(kind == "+", "CR").otherwise(F.upper(kind)).alias("txn_type_raw"), F.nullif(field(4), F.lit("")).alias("balance_raw"),
    )


def form16_lines(documents: DataFrame) -> DataFrame:
    """The first amount of each head of a salary form (doc_id, text), a row each."""
    amount = lambda p: F.regexp_replace(F.regexp_extract("text", p, 1), ",", "").try_cast("decimal(14,2)")
    heads = F.array(*(F.struct(F.lit(h).alias("head"), amount(p).alias("amount")) for h, p in rules.FORM16_HEADS.items()))
    return documents.select("doc_id", F.explode(heads).alias("s")).select("doc_id", "s.*").where("amount > 0")


def _around(pattern: str, before: int, behind: int) -> str:
    """``pattern`` as group 2, between what stands before it (group 1) and behind it (the last group)."""
    return rf"(?is)(?={pattern})(?<=(\A.{{0,{before - 1}}}|.{{{before}}}))({pattern})(?=(.{{0,{behind}}}))"


def _amounts(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.round(F.replace(x, F.lit(","), F.lit("")).cast("double"), 2))


def ais_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, category, word, amount, info_source) for each amount that follows a category's word closely; one for each category, amount and surroundings."""
    words = [(c, w) for c, some in rules.AIS_WORDS.items() for w in some]

    def found(k: int, category: str, word: str) -> Column:
        p = _around(rf"{re.escape(word)}[^0-9]{{0,{rules.AIS_REACH}}}(?:{rules.PLAIN_AMOUNT})", rules.AIS_BEFORE, rules.AIS_BEHIND)
        group = lambda g: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(g))
        rows = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"))
        return F.transform(rows, lambda r, i: F.struct(
            F.lit(category).alias("category"), F.lit(k).alias("k"), i.alias("at"), F.lit(word).alias("word"),
            F.regexp_extract(r["b"], rf"({rules.PLAIN_AMOUNT})$", 1).alias("raw"), F.regexp_replace(F.concat(r["a"], r["b"], r["c"]), r"^\s+|\s+$", "").alias("around"),
        ))

    rows = documents.select("doc_id", F.explode(F.flatten(F.array(*(found(k, *x) for k, x in enumerate(words))))).alias("s")).select("doc_id", "s.*")
    rows = rows.withColumn("amount", _amounts(F.array("raw"))[0]).where("amount > 0")
    source = F.coalesce(*(F.nullif(F.trim(F.regexp_extract("around", f"(?i){p}", 0)), F.lit("")) for p in rules.AIS_SOURCES))
    first = F.min_by(F.struct("word", source.alias("info_source")), F.struct("k", "at")).alias("m")
    return rows.groupBy("doc_id", "category", "amount", F.left("around", F.lit(rules.AIS_SAME)).alias("_same")).agg(first).select("doc_id", "category", "m.word", "amount", "m.info_source")


def form26as_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, part, deductor_tan, section, amount_credit, amount_tds): the largest amount around each deductor's number and the next one; then challans."""
    text = F.coalesce("text", F.lit(""))
    number = rf"\b({rules.PLAIN_AMOUNT})\b"

    def most(window: Column, digits: int) -> Column:
        texts = F.filter(F.regexp_extract_all(window, F.lit(number), F.lit(1)), lambda x: x.contains(".") | (F.length(F.replace(x, F.lit(","), F.lit(""))) >= digits))
        return _amounts(texts)

    p = rf"(?s)(?<=(\A.{{0,{rules.TAN_BEFORE - 1}}}|.{{{rules.TAN_BEFORE}}})){rules.TAN}(?=(.{{0,{rules.TAN_BEHIND}}}))"
    group = lambda g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    rows = documents.select("doc_id", F.posexplode(F.arrays_zip(group(1).alias("a"), group(2).alias("tan"), group(3).alias("c"))).alias("at", "r"))
    window = F.concat("r.a", "r.tan", "r.c")
    rows = rows.select("doc_id", "at", F.col("r.tan").alias("deductor_tan"), F.nullif(F.regexp_extract(window, rules.SECTION, 1), F.lit("")).alias("section"), F.filter(most(window, rules.TAN_DIGITS), lambda x: x > 0).alias("amounts"))
    credit = F.array_max("amounts")
    rows = rows.withColumn("amount_credit", credit).withColumn("amount_tds", F.array_max(F.filter("amounts", lambda x: x < credit))).where("amount_credit IS NOT NULL")
    rows = rows.groupBy("doc_id", "deductor_tan", "section", "amount_credit").agg(F.min_by(F.struct("amount_tds"), "at").alias("m"))
    rows = rows.select("doc_id", F.when(F.col("section").isNotNull(), "A").otherwise("B").alias("part"), "deductor_tan", "section", "amount_credit", "m.amount_tds")
    q = rf"(?s)(?=(.{{0,{rules.CHALLAN_ROW}}})){rules.CHALLAN}"
    paid = documents.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(q), F.lit(1))).alias("row"))
    paid = paid.select("doc_id", F.array_max(F.filter(most(F.col("row"), rules.CHALLAN_DIGITS), lambda x: x > rules.CHALLAN_LEAST)).alias("amount_credit")).where("amount_credit IS NOT NULL")
    none = F.lit(None)
    return rows.unionByName(paid.select("doc_id", F.lit("C").alias("part"), none.cast("string").alias("deductor_tan"), F.lit("self_paid_challan").alias("section"), "amount_credit", none.cast("double").alias("amount_tds")))


def amounts_after(documents: DataFrame, words: Sequence[str]) -> DataFrame:
    """Sum of all amounts that follow one of the words, by document; overlapping words count again."""
    sums = [F.aggregate(F.transform(F.regexp_extract_all("text", F.lit(rf"(?i){re.escape(w)}[^0-9]{{0,40}}([0-9][0-9,]*(?:\.\d{{1,2}})?)"), 1), money.parse_inr), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) for w in words]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return documents.select("doc_id", F.round(F.coalesce(total, F.lit(0.0)), 2).alias("amount"))


def tax_document_fields(documents: DataFrame, as_of: date) -> DataFrame:
    """(doc_id, field, amount, value): what a tax document (doc_id, doc_type, text) of a known type tells; amounts are 0 where it doesn't.

    Amounts and texts are those of the first pattern that fits, sums are over all matches of all words, and a
    document of any type has its financial year where it names one.
    """
    kind, text = F.lower(F.trim(F.coalesce("doc_type", F.lit("")))), F.coalesce("text", F.lit(""))
    capture = f"({rules.PLAIN_AMOUNT})"
    number = lambda p: F.abs(money.parse_inr(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit(""))))
    group = lambda p: F.nullif(F.trim(F.regexp_extract(text, "(?i)" + p, 1)), F.lit(""))
    total = lambda words: sum((F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){re.escape(w)}[^0-9]{{0,25}}{capture}"), F.lit(1)), lambda x: money.parse_inr(x)), F.lit(0.0), lambda a, x: a + F.coalesce(F.abs(x), F.lit(0.0))) for w in words), F.lit(0.0))
    none, zero = F.lit(None), F.lit(0.0)
    found = []

    def add(doc_type: str, name: str, amount: Column | None = None, value: Column | None = None) -> None:
        row = F.struct(F.lit(name).alias("field"), (F.round(F.coalesce(amount, zero), 2) if amount is not None else none.cast("double")).alias("amount"), (value if value is not None else none).cast("string").alias("value"))
        found.append(F.when(kind == doc_type, row) if doc_type else F.when(value.isNotNull(), row))

    for doc_type, fields in rules.AMOUNT_FIELDS.items():
        for name, patterns in fields.items():
            add(doc_type, name, F.coalesce(*map(number, patterns)))
    for doc_type, fields in rules.SUM_FIELDS.items():
        for name, words in fields.items():
            add(doc_type, name, total(words))
    for doc_type, fields in rules.COUNT_FIELDS.items():
        for name, patterns in fields.items():
            add(doc_type, name, F.greatest(*(F.regexp_count(text, F.lit("(?i)" + p)) for p in patterns)).cast("double"))
    for doc_type, fields in rules.TEXT_FIELDS.items():
        for name, patterns in fields.items():
            value = F.coalesce(*map(group, patterns))
            add(doc_type, name, value=texts.mask_tail(F.replace(value, F.lit(" "), F.lit(""))) if name.endswith("_masked") else value)
    day = F.coalesce(*(dates.parse_date(group(re.escape(w) + rules.NEAR_DATE), as_of, 1990) for w in rules.CHALLAN_DATES))
    add("tax_challan", "challan_date", value=F.date_format(day, "yyyy-MM-dd"))
    add("", "financial_year", value=F.replace(F.replace(group(rules.FINANCIAL_YEAR), F.lit(" "), F.lit("")), F.lit("/"), F.lit("-")))
    rows = F.filter(F.array(*found), lambda x: x.isNotNull())
    return documents.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")


def sms_classes(messages: DataFrame) -> DataFrame:
    """Messages (address, body) with spam_score and sms_class.

    Each step is a projection of its own: as one expression the sender and the score would be worked out wherever they are named, in more code than the JVM compiles.
    """
    address, body = F.col("address"), F.col("body")
    rows = messages.withColumn("_sender", classify.sender_id(address)).withColumn("spam_score", classify.spam_score(address, body, F.col("_sender")))
    return rows.withColumn("sms_class", classify.sms_class(address, body, F.col("spam_score"))).drop("_sender")
