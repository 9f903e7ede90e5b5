"""Making and changing ledger entries. Tables are immutable: each operator returns the new version or the rows to add."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, dates
from ..tables import written
from . import balance, dedup

SOURCES = ("template", "llm_text", "llm_vision", "ocr_llm", "manual", "sms", "split")


class Promotion(NamedTuple):
    entries: DataFrame
    reviews: DataFrame
    walks: DataFrame
    counts: DataFrame


def validate(raw: DataFrame, as_of: date, least_year: int = 2010) -> DataFrame:
    """Raw rows with typed columns, errors and a status; none is dropped."""
    rows = dates.dated(raw, "txn_date", F.col("date_raw"), as_of, least_year)
    # Each step names what the one before worked out.
    for columns in classify.validated(as_of):
        rows = rows.withColumns(columns)
    return rows.drop("_amount", "_hard", "_soft")


def raw_rows(extracted: DataFrame, source: str, page_number: int = 1) -> DataFrame:
    """Extracted rows (statement_id, line_number, transaction_date, description, amount, direction, confidence) as the texts that ``validate`` reads.

    Confidences are clamped to 0 and 1, null counts as 0, and so does a null line; other nulls are empty texts.
    """
    told = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return extracted.select(
        "statement_id", told(F.date_format("transaction_date", "dd/MM/yyyy")).alias("date_raw"), told(F.col("description")).alias("description_raw"), told(F.col("amount")).alias("amount_raw"), F.lit(None).cast("string").alias("balance_raw"),
        told(F.col("direction")).alias("txn_type_raw"), F.lit(page_number).alias("page_number"), F.coalesce("line_number", F.lit(0)).cast("int").alias("char_offset"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))).alias("confidence"), F.lit(source).alias("source"),
    )


def promote(validated: DataFrame, existing: DataFrame, statements: DataFrame) -> Promotion:
    """Validated rows (statement_id, seq, user_id, account_masked, account_type, source, confidence, ...) become entries.

    Invalid rows go to review; of equal keys, also with ``existing`` (user_id, dedup_key), one is kept; so is
    none that an earlier statement of the same file or fingerprint has under its weak signature (file_hash,
    statement_fp in both frames, where they are known); each statement's new rows are walked; the rest of the
    reasons for a review follow from the row and its walk.
    """
    side = F.when(F.coalesce("is_credit", F.lit(False)), "credit").otherwise("debit")
    rows = validated.withColumn("direction", side).withColumn("transaction_date", F.col("txn_date")).withColumn("merchant_raw", F.col("description")).withColumn("dedup_key", dedup.dedup_key())
    good = rows.where("validation_status <> 'invalid'")
    new = dedup.new_rows(good, existing, ["user_id", "dedup_key"], ["statement_id", "seq"])
    if {"file_hash", "statement_fp"} <= set(new.columns) & set(existing.columns):
        marked = new.withColumn("_signed", dedup.reimport_signature())
        for key in ("file_hash", "statement_fp"):
            # Known at another statement: a null of either side meets nothing.
            old = existing.select(F.col("user_id").alias("_u"), F.col(key).alias("_k"), dedup.reimport_signature().alias("_s"), F.col("statement_id").alias("_of"))
            marked = marked.join(old, (F.col("user_id") == F.col("_u")) & (F.col(key) == F.col("_k")) & (F.col("_signed") == F.col("_s")) & (F.col("statement_id") != F.col("_of")), "left_anti")
        new = marked.drop("_signed")
    new = written(new, "promotion-new")  # the walks and the entries both read it
    walks = balance.balance_walk(new.select("statement_id", "seq", "transaction_date", "amount", "is_credit", "balance_after"), statements.where("opening_balance IS NOT NULL AND closing_balance IS NOT NULL"))
    # Statements of several accounts may share an id and its rows: these pass if all of them do, and none comes twice.
    walked = walks.groupBy("statement_id").agg(F.min("passed").alias("walk_passed"), F.flatten(F.collect_list("problem_seqs")).alias("_problems"))
    entries = new.join(walked, "statement_id", "left").withColumn("nature", classify.nature(F.col("merchant_raw"), F.col("direction"), F.col("account_type")))
    reasons = classify.review_reasons(F.col("confidence"), F.col("source"), F.col("amount"), F.col("walk_passed"), F.col("validation_status"))
    outlier = F.coalesce(F.array_contains("_problems", F.col("seq").cast("long")), F.lit(False))
    entries = entries.withColumn("review_reasons", F.when(outlier, F.array_append(reasons, "balance_walk_outlier")).otherwise(reasons)).drop("_problems")
    invalid = rows.where("validation_status = 'invalid'").select("statement_id", "seq", F.explode("validation_errors").alias("reason"))
    reviews = invalid.unionByName(entries.select("statement_id", "seq", F.explode("review_reasons").alias("reason")))
    by_row = rows.groupBy("statement_id").agg(F.count("*").alias("rows"), F.count_if(F.col("validation_status") == "invalid").alias("invalid"))
    counts = by_row.join(entries.groupBy("statement_id").agg(F.count("*").alias("created")), "statement_id", "left").withColumn("created", F.coalesce("created", F.lit(0))).withColumn("duplicates", F.col("rows") - F.col("invalid") - F.col("created"))
    return Promotion(entries, reviews, walks, counts)


def gates(statements: DataFrame) -> DataFrame:
    """Whether a parsed statement may go on (quarantined, extracted_rows, expected_rows, walk_passed, card_status): else ``review_required``."""


    share = F.col("extracted_rows") / F.nullif(F.col("expected_rows"), F.lit(0))
    enough = ~F.coalesce((F.col("expected_rows") >= rules.YIELD_ROWS) & (share < rules.LEAST_YIELD), F.lit(False))
    ok = (F.coalesce("quarantined", F.lit(0)) == 0) & enough & F.coalesce("walk_passed", F.lit(True)) & (F.coalesce("card_status", F.lit("ok")) == "ok")
    return statements.withColumn("yield_rate", F.round(share, 4)).withColumn("parse_status", F.when(ok, "parsed").otherwise("review_required"))


def split(ledger: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits entries into parts (txn_id, split_index, amount): at least two, positive, adding up to the paisa; others are refused.

    Returns the ledger with children added and split entries excluded, and for
    each entry whether its split was taken.
    """
    sums = parts.groupBy("txn_id").agg(F.count("*").alias("_n"), F.sum("amount").alias("_sum"), F.min("amount").alias("_least"))
    asked = sums.join(ledger.select("txn_id", F.col("amount").alias("_whole"), F.col("is_excluded").alias("_gone")), "txn_id", "left")
    ok = (F.col("_n") >= 2) & (F.col("_least") > 0) & (F.col("_sum") == F.col("_whole")) & ~F.col("_gone")
    verdict = asked.select("txn_id", F.coalesce(ok, F.lit(False)).alias("accepted"))
    taken = verdict.where("accepted").select("txn_id")
    whole = ledger.join(taken, "txn_id", "left_semi")
    kids = whole.drop("amount").join(parts.select("txn_id", "split_index", "amount"), "txn_id").withColumn("parent_id", F.col("txn_id"))
    kids = kids.withColumn("txn_id", F.xxhash64("parent_id", "split_index"))
    flagged = ledger.join(taken.withColumn("_hit", F.lit(True)), "txn_id", "left").withColumn("is_excluded", F.col("is_excluded") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    none = F.lit(None)
    flagged = flagged.withColumn("parent_id", none.cast("long")).withColumn("split_index", none.cast("int"))
    return flagged.unionByName(kids.withColumn("split_index", F.col("split_index").cast("int")).select(flagged.columns)), verdict


def updated(ledger: DataFrame, ids: DataFrame, changes: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """The ledger with ``changes`` made to the rows in ``ids``, and an audit row for each field that changed. A row whose category is set has it from the
    user: its category_source, where the ledger has one, says so without an audit row."""
    hit = F.coalesce("_hit", F.lit(False))
    marked = ledger.join(ids.select("txn_id").distinct().withColumn("_hit", F.lit(True)), "txn_id", "left")
    new: dict[str, Column] = {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
    audit = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value"), F.lit(v).cast("string").alias("new_value")) for c, v in changes.items()))
    log = marked.where("_hit").select("txn_id", F.explode(audit).alias("a")).select("txn_id", "a.*").where("NOT (old_value <=> new_value)")
    if "category_source" in ledger.columns and {"category_id", "category_name"} & set(changes):
        new["category_source"] = F.when(hit, F.lit("user")).otherwise(F.col("category_source"))
    return marked.withColumns(new).select(ledger.columns), log


def merged(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``updates`` take the place of those with equal keys."""
    return current.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def without_user(table: DataFrame, user_id) -> DataFrame:
    """All rows but a user's."""
    return table.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def source_files(sources: DataFrame, parsed: DataFrame, statements: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct names of the files behind each entry, sorted."""
    j = sources.join(parsed, "parsed_id").join(statements, "statement_id", "left").join(files, "file_id", "left")
    return j.where("file_name IS NOT NULL").select("txn_id", "file_name").distinct().groupBy("txn_id").agg(F.array_sort(F.collect_list("file_name")).alias("files"))


def accounts_tree(statements: DataFrame) -> DataFrame:
    """By account: statements, rows, and the latest balance (a card's total due, else closing)."""
    last = F.max(F.struct("period_end", "statement_id", F.when(F.col("account_type") == "credit_card", F.coalesce("total_due", F.lit(0))).otherwise(F.col("closing_balance")).alias("balance"))).alias("m")
    return statements.groupBy("user_id", "bank_name", "account_type", "account_masked").agg(F.count("*").alias("statements"), F.sum("row_count").alias("rows"), F.min("period_start").alias("first_start"), last).select("user_id", "bank_name", "account_type", "account_masked", "statements", "rows", "first_start", F.col("m.period_end").alias("last_end"), F.col("m.balance").alias("balance"))


def card_totals(rows: DataFrame) -> DataFrame:
    """Debits and credits of each card statement, without quarantined rows."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0).cast("decimal(24,2)"))
    return rows.where("account_type = 'credit_card' AND NOT coalesce(is_quarantined, false)").groupBy("statement_id").agg(side("debit").alias("debits"), side("credit").alias("credits"))


def pending_reviews(tasks: DataFrame) -> DataFrame:
    """How many open reviews a user has."""
    return tasks.groupBy("user_id").agg(F.count_if(F.col("status") == "open").alias("pending"))


def pending_messages(threads: DataFrame, path: str = "$.pending") -> DataFrame:
    """Sum of an integer inside the threads' JSON (user_id, is_active, context), of active ones; 0 where there is none or it can't be read."""
    number = F.get_json_object("context", path).try_cast("int")
    return threads.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("is_active"), number)), F.lit(0)).cast("long").alias("pending"))


def savings_accounts(statements: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accounts that statements or the ledger know, with how many of each."""
    kinds = ("savings", "current", "salary")
    a = statements.where(F.col("account_type").isin(*kinds)).groupBy("user_id", "bank_name", "account_masked").agg(F.count("*").alias("statements"))
    b = ledger.where(F.col("account_type").isin(*kinds)).groupBy("user_id", "bank_name", "account_masked").agg(F.count("*").alias("entries"))
    return a.join(b, ["user_id", "bank_name", "account_masked"], "full_outer").fillna(0, ["statements", "entries"])
