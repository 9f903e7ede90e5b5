"""Keys, duplicate elimination and idempotent inserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text


def _sha(*parts: Column) -> Column:
    """Of the parts joined by a bar; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def fingerprint() -> Column:
    """Of an entry: user, account, date, paise and the first 30 plain characters of its text; not its direction."""
    return _sha(F.col("user_id"), F.upper(F.trim("account_masked")), F.date_format("transaction_date", "yyyy-MM-dd"), money.paise(F.col("amount")), F.substring(text.plain_words(F.col("merchant_raw")), 1, 30))


def statement_fingerprint() -> Column:
    """Of a statement; null without a bank and both dates."""
    known = F.col("bank_name").isNotNull() & F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    return F.when(known, _sha(F.col("user_id"), F.upper(F.trim("bank_name")), F.upper(F.trim("account_masked")), F.col("period_start"), F.col("period_end"), money.paise(F.col("opening_balance"))))


def dedup_key() -> Column:
    """Of a validated row: account, date, paise, 40 characters of its text and its side."""
    side = F.when(F.col("direction") == "credit", "cr").otherwise("dr")
    return _sha(F.col("account_masked"), F.date_format("transaction_date", "yyyy-MM-dd"), money.paise(F.col("amount")), F.substring(F.lower(text.collapse(F.col("merchant_raw"))), 1, 40), side)


def reimport_signature() -> Column:
    return F.concat_ws("|", F.date_format("transaction_date", "yyyy-MM-dd"), money.paise(F.col("amount")).cast("string"), F.substring(text.plain_words(F.col("merchant_raw")), 1, 30))


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key, the first in order, found by a grouped minimum of whole rows that combines before the shuffle."""
    whole = F.struct(*order, F.struct(*rows.columns).alias("_row"))
    return rows.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.min(whole).alias("_m")).select("_m._row.*")


def new_rows(rows: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key (null equals null) neither exists nor came before in the batch."""
    return without(first_of(rows, keys, order), existing, keys)


def without(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = None
    seen = existing.select(*(F.col(k).alias(f"_e_{k}") for k in keys)).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        on = c if on is None else on & c
    return rows.join(seen, on, "left_anti")


def insert_counts(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: how many came, went in and were duplicates."""
    return rows.agg(F.count("*").alias("rows")).crossJoin(inserted.agg(F.count("*").alias("inserted"))).withColumn("duplicates", F.col("rows") - F.col("inserted"))


def line_counts(lines: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """The lines that go in, and one row: how many did, repeat an earlier or existing line, or aren't valid (null counts as not)."""
    good = F.coalesce(valid, F.lit(False))
    fresh = new_rows(lines.where(good), existing, keys, order)
    counts = lines.agg(F.count_if(good).alias("_good"), F.count_if(~good).alias("skipped_invalid")).crossJoin(fresh.agg(F.count("*").alias("inserted")))  # a row each
    return fresh, counts.select("inserted", (F.col("_good") - F.col("inserted")).alias("skipped_duplicate"), "skipped_invalid")


def reimported(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose weak signature stands in an earlier statement of the same file or the same fingerprint."""
    a = rows.withColumn("_sig", reimport_signature())
    b = existing.withColumn("_sig", reimport_signature())
    by_file = a.join(b.select("file_hash", "_sig").distinct(), ["file_hash", "_sig"], "left_semi")
    by_statement = a.join(b.select("statement_fp", "_sig").distinct(), ["statement_fp", "_sig"], "left_semi")
    return by_file.unionByName(by_statement).drop("_sig").dropDuplicates(["txn_id"])


def orphans(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries that no source backs."""
    return entries.join(sources.select("txn_id").distinct(), "txn_id", "left_anti")


def superseded(statements: DataFrame) -> DataFrame:
    """Versions of each statement by fingerprint; the last one is active."""
    w = W.partitionBy("user_id", "fingerprint").orderBy("created_at", "statement_id")
    return statements.withColumn("version_no", F.row_number().over(w)).withColumn("is_active", F.lead("statement_id").over(w).isNull())
