"""Balances: statement walks, snapshots, net worth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text

MONEY = "decimal(16,2)"


def balance_walk(rows: DataFrame, statements: DataFrame, tolerance=rules.WALK_TOLERANCE) -> DataFrame:
    """Walks each statement from its opening to its closing balance.

    ``rows`` has statement_id, seq, transaction_date, amount, is_credit (null:
    skipped and flagged) and balance_after (or null); a printed balance more than
    the tolerance off flags its row and the walk goes on from what is printed. A
    statement is one document, so its rows fit one fold.
    """
    step = F.struct("transaction_date", "seq", F.col("amount").cast(MONEY).alias("amount"), "is_credit", F.col("balance_after").cast(MONEY).alias("balance_after"))
    grouped = rows.groupBy("statement_id").agg(F.array_sort(F.collect_list(step)).alias("_rows"))
    tol = F.lit(tolerance).cast(MONEY)

    def walk(state: Column, r: Column) -> Column:
        moved = (state["running"] + F.when(r["is_credit"].isNull(), F.lit(0)).when(r["is_credit"], r["amount"]).otherwise(-r["amount"]).cast(MONEY)).cast(MONEY)
        off = r["balance_after"].isNotNull() & r["is_credit"].isNotNull() & (F.abs(moved - r["balance_after"]) > tol)
        return F.struct(
            F.when(off, r["balance_after"]).otherwise(moved).cast(MONEY).alias("running"),
            (state["flagged"] + F.when(off | r["is_credit"].isNull(), 1).otherwise(0)).cast("int").alias("flagged"),
            F.coalesce(state["first"], F.when(off, r["seq"].cast("long"))).alias("first"),
            F.when(off | r["is_credit"].isNull(), F.array_append(state["problems"], r["seq"].cast("long"))).otherwise(state["problems"]).alias("problems"),
        )

    start = F.struct(F.col("opening_balance").cast(MONEY).alias("running"), F.lit(0).alias("flagged"), F.lit(None).cast("long").alias("first"), F.array().cast("array<bigint>").alias("problems"))
    done = statements.join(grouped, "statement_id", "left").withColumn("_w", F.aggregate(F.coalesce("_rows", F.array().cast("array<struct<transaction_date:date,seq:bigint,amount:decimal(16,2),is_credit:boolean,balance_after:decimal(16,2)>>")), start, walk))
    return done.select(
        "statement_id", F.col("_w.running").alias("computed_closing"), F.col("_w.flagged").alias("flagged_rows"), F.col("_w.first").alias("first_flagged_seq"), F.col("_w.problems").alias("problem_seqs"),
        (F.abs(F.col("_w.running") - F.col("closing_balance")) <= tol).alias("passed"),
    )


def simple_walk(rows: DataFrame, statements: DataFrame, tolerance=rules.WALK_TOLERANCE) -> DataFrame:
    """Whether closing is opening plus credits less debits."""
    zero = F.lit(0).cast(MONEY)
    sums = rows.groupBy("statement_id").agg(F.sum(F.when(F.col("is_credit"), F.col("amount"))).alias("credits"), F.sum(F.when(~F.col("is_credit"), F.col("amount"))).alias("debits"), F.count("*").alias("rows"))
    gap = F.abs(F.col("opening_balance") + F.coalesce("credits", zero) - F.coalesce("debits", zero) - F.col("closing_balance"))
    return statements.join(sums, "statement_id", "left").select("statement_id", F.coalesce("credits", zero).alias("credits"), F.coalesce("debits", zero).alias("debits"), F.coalesce("rows", F.lit(0)).alias("rows"), gap.alias("gap"), (gap <= F.lit(tolerance)).alias("passed"))


def directions(rows: DataFrame, tolerance: float = rules.DELTA_TOLERANCE) -> DataFrame:
    """Direction of each row from the change of its balance, where that agrees with the amount; else from its narration, else debit.

    A statement whose first date is later than its last one is newest first, and its rows are turned round.
    """
    whole = W.partitionBy("statement_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    newest_first = F.coalesce(F.first("transaction_date").over(whole) > F.last("transaction_date").over(whole), F.lit(False))
    placed = rows.withColumn("_at", F.when(newest_first, -F.col("seq")).otherwise(F.col("seq")))
    change = F.col("balance_after") - F.lag("balance_after").over(W.partitionBy("statement_id").orderBy("_at"))
    agrees = F.abs(F.abs(change) - F.col("amount")) <= F.lit(tolerance)
    by_text = F.when(text.contains_any(F.upper(F.coalesce("description", F.lit(""))), rules.CREDIT_NARRATIONS), "credit").otherwise("debit")
    return placed.withColumn("direction", F.when(agrees, F.when(change > 0, "credit").otherwise("debit")).otherwise(by_text)).drop("_at")


def carried_dates(rows: DataFrame) -> DataFrame:
    """Rows without a date take the last one before them."""
    w = W.partitionBy("statement_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("transaction_date", F.last("transaction_date", ignorenulls=True).over(w))


def expanded_periods(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Statement periods widened to their rows' dates."""
    span = rows.groupBy("statement_id").agg(F.min("transaction_date").alias("_first"), F.max("transaction_date").alias("_last"))
    return statements.join(span, "statement_id", "left").withColumn("period_start", F.least("period_start", "_first")).withColumn("period_end", F.greatest("period_end", "_last")).drop("_first", "_last")


def joined_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, text) of entries: a line that doesn't start with a digit goes on with the one before; what comes before the first is dropped."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    entry = F.sum(F.when(F.col("text").rlike("^[0-9]"), 1).otherwise(0)).over(w)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.withColumn("entry", entry).where("entry > 0").groupBy("doc_id", "entry").agg(F.array_join(F.transform(ordered, lambda x: F.trim(x["text"])), " ").alias("text"))


def snapshots_from(statements: DataFrame) -> DataFrame:
    """A bank statement gives an asset of its closing balance, a card's a liability of its total due."""
    card = F.col("account_type") == "credit_card"
    balance = F.when(card, F.abs("total_due")).otherwise(F.col("closing_balance"))
    key = F.regexp_replace(F.lower(F.concat_ws("-", "bank_name", "account_type", "account_masked")), "[^a-z0-9]+", "-")
    return statements.where(card | F.col("account_type").isin("savings", "current")).select(
        "statement_id", "user_id", key.alias("position_key"), F.col("period_end").alias("as_of_date"), balance.alias("balance"), F.when(card, "liability").otherwise("asset").alias("entry_kind")
    ).where("balance IS NOT NULL")


def latest_positions(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each position."""
    last = F.max(F.struct("as_of_date", "statement_id", "balance", "entry_kind")).alias("m")
    return snapshots.groupBy("user_id", "position_key").agg(last).select("user_id", "position_key", "m.as_of_date", "m.balance", "m.entry_kind")


def net_worth_history(snapshots: DataFrame, months: int = 12) -> DataFrame:
    """Assets, liabilities and net at each date, positions carried forward.

    Each snapshot changes its position by its balance less the one before; changes
    add up by date, and running sums over a user's dates give the totals. Dates
    from 31 * (months - 1) days before the user's last one on are kept.
    """
    daily = snapshots.groupBy("user_id", "position_key", "as_of_date").agg(F.max(F.struct("statement_id", "balance", "entry_kind")).alias("m")).select("user_id", "position_key", "as_of_date", F.col("m.balance").cast(MONEY).alias("balance"), "m.entry_kind")
    w = W.partitionBy("user_id", "position_key").orderBy("as_of_date")
    zero = F.lit(0).cast(MONEY)
    of = lambda kind, c, k: F.when(k == kind, c).otherwise(zero)
    before, kind_before = F.lag("balance").over(w), F.lag("entry_kind").over(w)
    change = daily.select("user_id", "as_of_date", *((of(kind, F.col("balance"), F.col("entry_kind")) - F.coalesce(of(kind, before, kind_before), zero)).alias(kind) for kind in ("asset", "liability")))
    sums = change.groupBy("user_id", "as_of_date").agg(F.sum("asset").alias("_a"), F.sum("liability").alias("_l"))
    run = W.partitionBy("user_id").orderBy("as_of_date").rowsBetween(W.unboundedPreceding, 0)
    end = F.max("as_of_date").over(W.partitionBy("user_id"))
    out = sums.select("user_id", "as_of_date", F.sum("_a").over(run).alias("assets"), F.sum("_l").over(run).alias("liabilities"), end.alias("_end"))
    return out.where(F.datediff("_end", "as_of_date") <= 31 * (months - 1)).select("user_id", "as_of_date", "assets", "liabilities", (F.col("assets") - F.col("liabilities")).alias("net"))


def bills(statements: DataFrame) -> DataFrame:
    """A bill for each card statement with a due date and a total due; one for each bank, account and due date."""
    due = statements.where("due_date IS NOT NULL AND total_due IS NOT NULL")
    return due.groupBy("user_id", "bank_name", "account_masked", "due_date").agg(F.min(F.struct("statement_id", "total_due")).alias("m")).select("user_id", "bank_name", "account_masked", "due_date", "m.statement_id", "m.total_due")


def days_until_due(bills_: DataFrame, as_of: date) -> DataFrame:
    return bills_.withColumn("days_until_due", F.when(~F.coalesce("paid", F.lit(False)), F.datediff("due_date", F.lit(as_of))))
