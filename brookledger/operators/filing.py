"""What kind of document an upload is: hints first, then its heading, then scores of its whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from . import intake

#: Where lines end.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def plain_words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[_\-/\\]", " ")


def heading(text: Column) -> Column:
    """The lines before the first that heads a table, forty and 2500 characters at most."""
    lines = F.split(text, LINE_END)
    table = F.transform(lines, lambda s: _has(F.trim(F.regexp_replace(s, r"\s+", " ")), rules.HEADING_ENDS))
    first = F.array_position(table, True)
    kept = F.when(first > 0, F.least(first - 1, F.lit(rules.HEADING_LINES))).otherwise(rules.HEADING_LINES)
    return F.substring(F.array_join(F.slice(lines, F.lit(1), kept.cast("int")), "\n"), 1, rules.HEADING_CHARS)


def _has(text: Column, phrases: Sequence[str]) -> Column:
    out = text.contains(phrases[0])
    for p in phrases[1:]:
        out = out | text.contains(p)
    return out


def _score(text: Column, phrases: Sequence[str]) -> Column:
    """Three for a phrase of three words or more, else two."""
    return sum((F.when(text.contains(p), 3 if len(p.split()) >= 3 else 2).otherwise(0) for p in phrases), F.lit(0))


def classified(uploads: DataFrame) -> DataFrame:
    """Uploads (file_name, text, bank_hint, document_type_hint, account_type_hint, further columns) with doc_type, doc_bank, doc_account, confidence and
    hinted (whether a hint told the type).

    The file's suffix tells whether it is a document (pdf), a sheet (xlsx, xls, csv) or unsupported. A document's heading is read first; scores of its whole
    text follow, a lower one enough where the bank is known. Null names, texts and hints are empty; whole texts count.
    """
    name, body = F.coalesce("file_name", F.lit("")), F.coalesce("text", F.lit(""))
    # Text expressions are computed once: rules below read columns.
    out = uploads.withColumns({"_t": plain_words(F.concat_ws(" ", name, body)), "_suffix": F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)), "_bank": F.nullif(F.trim("bank_hint"), F.lit(""))})
    out = out.withColumn("_h", heading(F.col("_t"))).withColumns({"_card": _score(F.col("_t"), rules.CARD_PHRASES), "_acct": _score(F.col("_t"), rules.BANK_PHRASES) + F.when(F.col("_t").contains("statement"), 1).otherwise(0)})
    t, h, bank, card, acct = (F.col(c) for c in ("_t", "_h", "_bank", "_card", "_acct"))
    none = F.lit(None).cast("string")
    CARD, BANK = ("credit_card_statement", "credit_card"), ("bank_statement", "bank_account")

    def verdict(kind: str | Column, confidence: float | Column, of: Column = none, account: str | Column = none, hinted: bool = False) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(kind).alias("doc_type"), of.alias("doc_bank"), lit(account).cast("string").alias("doc_account"), lit(confidence).cast("double").alias("confidence"), F.lit(hinted).alias("hinted"))

    def first(*ordered: tuple[Column, Column]) -> Column:
        return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), v) for c, v in ordered))

    sure = lambda score, base: F.least(F.lit(0.97), F.lit(base) + F.least(score, F.lit(18)) / 40)
    told = intake.document_type(F.col("document_type_hint"))
    by_type = first((told.isNotNull() & (told != "auto"), verdict(told, 1.0, bank, F.when(told == CARD[0], CARD[1]).when(told == BANK[0], BANK[1]), True)))
    hint = F.lower(F.trim("account_type_hint"))
    by_account = first((hint == "credit_card", verdict(CARD[0], 0.96, bank, CARD[1], True)), (hint.isin("bank_account", "savings", "current"), verdict(BANK[0], 0.96, bank, BANK[1], True)))
    invests = _has(h, rules.INVESTMENT_PHRASES) | h.rlike(rules.INVESTMENT_WORDS)
    by_heading = first(
        (_has(h, rules.PPF_PHRASES), verdict("ppf_statement", 0.95, bank)), (_has(h, rules.CHALLAN_PHRASES), verdict("tax_challan", 0.95)),
        (_has(h, rules.FORM16_PHRASES), verdict("tax_form", 0.9, F.lit("form16"))), (_has(h, rules.FORM12BB_PHRASES), verdict("tax_form", 0.9, F.lit("form12bb"))),
        (h.contains("fixed deposit") | h.rlike(r"\bfd\b"), verdict("fd_report", 0.84, bank)),
        (_has(h, rules.CERTIFICATE_PHRASES) | (h.contains("certificate") & _has(h, rules.CERTIFICATE_WORDS)), verdict("interest_certificate", 0.88, bank)),
        (invests & _has(h, rules.HOLDING_PHRASES), verdict("demat_holdings", 0.9)), (invests & _has(h, rules.GAIN_PHRASES), verdict("demat_tax_report", 0.93)),
        (invests & _has(h, rules.TRADE_PHRASES), verdict("demat_trade_report", 0.93)), (invests & h.contains("dividend"), verdict("dividend_report", 0.88)), (invests, verdict("demat_holdings", 0.86)),
        (_has(h, rules.BARE_GAIN_PHRASES), verdict("demat_tax_report", 0.86)), (_has(h, rules.BARE_HOLDING_PHRASES), verdict("demat_holdings", 0.82)),
    )
    by_score = first(
        ((card >= 8) & (card >= acct + 2), verdict(CARD[0], sure(card, 0.58), bank, CARD[1])), ((acct >= 8) & (acct >= card + 2), verdict(BANK[0], sure(acct, 0.58), bank, BANK[1])),
        (bank.isNotNull() & (F.greatest(card, acct) >= 6) & (card > acct), verdict(CARD[0], sure(card, 0.62), bank, CARD[1])), (bank.isNotNull() & (F.greatest(card, acct) >= 6), verdict(BANK[0], sure(acct, 0.62), bank, BANK[1])),
        (bank.isNotNull() & _has(h, rules.CARD_NAMES), verdict(CARD[0], 0.76, bank, CARD[1])), (bank.isNotNull() & _has(h, rules.BANK_NAMES), verdict(BANK[0], 0.74, bank, BANK[1])),
    )
    sheet = first((_has(t, rules.SHEET_TRADES), verdict("demat_trade_report", 0.94, bank)), (_has(t, rules.SHEET_GAINS), verdict("demat_tax_report", 0.9, bank)), (_has(t, rules.SHEET_HOLDINGS), verdict("demat_holdings", 0.88, bank)))
    found = (
        F.when(F.col("_suffix") == "pdf", F.coalesce(by_type, by_account, by_heading, by_score, verdict("unknown_pdf", 0.2, bank)))
        .when(F.col("_suffix").isin("xlsx", "xls", "csv"), F.coalesce(by_type, sheet, verdict("spreadsheet", 0.6, bank))).otherwise(verdict("unsupported", 1.0))
    )
    return out.withColumn("_found", found).select(*uploads.columns, "_found.*")
