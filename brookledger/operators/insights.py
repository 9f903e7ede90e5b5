"""Analytics over the ledger, for all users at once.

The ledger has txn_id, user_id, transaction_date, amount (decimal), direction,
nature, category_name, merchant_raw, merchant_normalized, bank_name,
account_type, account_masked, notes and is_excluded. Aggregates combine on the
map side, so a user with a third of all rows costs no more than any other; ranks
run over aggregated rows only, except where an operator says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, money, text
from ..functions.money import total


def active(ledger: DataFrame) -> DataFrame:
    """What analytics see: rows that aren't excluded."""
    return ledger.where(~F.col("is_excluded"))


def of_user(table: DataFrame, user_id) -> DataFrame:
    """The mandatory tenant predicate; reaches the scan."""
    return table.where(F.col("user_id") == F.lit(user_id))


def with_category_names(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Entries (category_id) with the name of their category (category_id, name); Uncategorized where there is none."""
    names = categories.select("category_id", F.col("name").alias("category"))
    return ledger.join(names, "category_id", "left").withColumn("category", F.coalesce("category", F.lit("Uncategorized")))


def filtered(ledger: DataFrame, *, since: date | None = None, until: date | None = None, category: str | None = None, bank: str | None = None, direction: str | None = None, nature: str | None = None, least: float | None = None, most: float | None = None, contains: str | None = None, ids: Sequence | None = None) -> DataFrame:
    """Rows that meet every condition given; dates and amounts are inclusive, ``contains`` looks at merchants and notes without regard to case."""
    given: list[Column] = []
    if since is not None:
        given.append(F.col("transaction_date") >= F.lit(since))
    if until is not None:
        given.append(F.col("transaction_date") <= F.lit(until))
    for column, value in (("category_name", category), ("bank_name", bank.upper() if bank else None), ("direction", direction), ("nature", nature)):
        if value is not None:
            given.append(F.col(column) == value)
    if least is not None:
        given.append(F.col("amount") >= F.lit(least))
    if most is not None:
        given.append(F.col("amount") <= F.lit(most))
    if contains:
        part = F.lower(F.lit(contains))
        given.append(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(part), F.lit(False)) for c in ("merchant_raw", "merchant_normalized", "notes"))))
    if ids is not None:
        given.append(F.col("txn_id").isin(list(ids)))
    return reduce(lambda df, c: df.where(c), given, ledger)


def page(ledger: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first."""
    return ledger.orderBy(F.desc("transaction_date"), "txn_id").offset(offset).limit(limit)


def merchant() -> Column:
    return F.coalesce(F.nullif(F.col("merchant_normalized"), F.lit("")), F.col("merchant_raw"))


def monthly_summary(ledger: DataFrame) -> DataFrame:
    """Income, expense, net and the number of all entries by user and month."""
    return (
        active(ledger)
        .groupBy("user_id", dates.month(F.col("transaction_date")).alias("year_month"))
        .agg(total(F.col("amount"), F.col("nature") == "income").alias("income"), total(F.col("amount"), F.col("nature") == "expense").alias("expense"), F.count("*").alias("txn_count"))
        .withColumn("net", F.col("income") - F.col("expense"))
    )


def monthly_categories(ledger: DataFrame) -> DataFrame:
    return (
        active(ledger).where("nature = 'expense'")
        .groupBy("user_id", dates.month(F.col("transaction_date")).alias("year_month"), F.coalesce("category_name", F.lit("Uncategorized")).alias("category_name"))
        .agg(F.sum("amount").alias("amount"))
    )


def monthly_merchants(ledger: DataFrame, top: int = 10) -> DataFrame:
    """The merchants with the largest expense of each month."""
    sums = (
        active(ledger).where("nature = 'expense'")
        .groupBy("user_id", dates.month(F.col("transaction_date")).alias("year_month"), merchant().alias("merchant"))
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("txn_count"))
    )
    place = F.row_number().over(W.partitionBy("user_id", "year_month").orderBy(F.desc("amount"), "merchant"))
    return sums.withColumn("place", place).where(F.col("place") <= top)


def month_change(summary: DataFrame) -> DataFrame:
    """Per cent change of expense against the calendar month before; null without one or where it was 0."""
    before = summary.select("user_id", dates.month(F.add_months(F.to_date(F.concat("year_month", F.lit("-01"))), 1)).alias("year_month"), F.col("expense").alias("before"))
    change = (F.col("expense") - F.col("before")).cast("double") / F.nullif(F.col("before"), F.lit(0)).cast("double") * 100
    return summary.join(before, ["user_id", "year_month"], "left").withColumn("change_percent", F.round(change, 2))


def spending_trend(summary: DataFrame, as_of: date, months: int) -> DataFrame:
    """The last months of every user up to that of ``as_of``; months without entries are zero."""
    spine = summary.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.add_months(F.trunc(F.lit(as_of), "MM"), 1 - months), F.trunc(F.lit(as_of), "MM"), F.expr("interval 1 month"))).alias("_m")).select("user_id", dates.month(F.col("_m")).alias("year_month"))
    zero = F.lit(0).cast("decimal(24,2)")
    return spine.join(summary, ["user_id", "year_month"], "left").select("user_id", "year_month", *(F.coalesce(c, zero).alias(c) for c in ("income", "expense", "net")), F.coalesce("txn_count", F.lit(0)).alias("txn_count"))


def budget_usage(ledger: DataFrame, budgets: DataFrame, as_of: date) -> DataFrame:
    """Budgets (budget_id, user_id, category_name or null for all, period, amount_limit) with what was spent in the current period.

    Expense is summed by user, category and month before anything is joined.
    """
    sums = (
        active(ledger).where("nature = 'expense'").where(F.year("transaction_date") == as_of.year)
        .groupBy("user_id", F.col("category_name").alias("_category"), F.month("transaction_date").alias("_month")).agg(F.sum("amount").alias("_spent"))
    )
    b = budgets.alias("b")
    hit = (F.col("b.user_id") == F.col("s.user_id")) & (F.col("b.category_name").isNull() | (F.col("b.category_name") == F.col("s._category"))) & ((F.col("b.period") == "yearly") | (F.col("s._month") == as_of.month))
    spent = b.join(sums.alias("s"), hit, "left").groupBy("b.budget_id").agg(F.coalesce(F.sum("s._spent"), F.lit(0).cast("decimal(24,2)")).alias("spent"))
    limit = F.col("amount_limit")
    return budgets.join(spent, "budget_id").select(
        "budget_id", "user_id", "category_name", "period", limit, "spent", F.greatest(limit - F.col("spent"), F.lit(0).cast("decimal(24,2)")).alias("remaining"),
        F.round(F.when(limit > 0, F.col("spent").cast("double") / limit.cast("double") * 100).otherwise(0.0), 2).alias("used_percent"),
    )


def recurring(ledger: DataFrame) -> DataFrame:
    """Merchants that a user pays alike amounts at regular gaps.

    The mean gap telescopes to (last - first) / (n - 1), so no row meets its neighbour.
    """
    rows = active(ledger).where("nature = 'expense'").withColumn("merchant", merchant()).where("merchant IS NOT NULL")
    latest = F.struct("transaction_date", "txn_id", "category_name")
    g = rows.groupBy("user_id", "merchant").agg(
        F.count("*").alias("n"), F.avg(F.col("amount").cast("double")).alias("mean"), F.stddev_samp(F.col("amount").cast("double")).alias("sd"),
        F.max(F.col("amount").cast("double")).alias("most"), F.min(F.col("amount").cast("double")).alias("least"),
        F.min("transaction_date").alias("first_seen"), F.max("transaction_date").alias("last_seen"), F.avg(F.dayofmonth("transaction_date")).alias("day"),
        F.max(latest).alias("latest"),
    )
    gap = F.datediff("last_seen", "first_seen") / (F.col("n") - 1)
    frequency = F.coalesce(*(F.when(gap.between(a, b), F.lit(name)) for name, a, b, _ in rules.RECURRING_GAPS))
    months = F.coalesce(*(F.when(F.col("frequency") == name, F.lit(m)) for name, _, _, m in rules.RECURRING_GAPS))
    spread = F.greatest(F.col("most") - F.col("mean"), F.col("mean") - F.col("least")) / F.col("mean")
    return (
        g.where("n >= 2 AND mean > 0").where(spread <= rules.RECURRING_SPREAD).withColumn("frequency", frequency).where("frequency IS NOT NULL")
        .withColumn("expected_day", F.bround("day", 0).cast("int"))
        .select("user_id", "merchant", F.col("n").alias("occurrences"), F.round("mean", 2).alias("typical_amount"), F.round(F.col("sd") / F.col("mean"), 4).alias("amount_variance"), "frequency", "expected_day", "last_seen", dates.plus_months(F.col("last_seen"), months, F.col("expected_day")).alias("next_expected"), F.col("latest.category_name").alias("category_name"))
    )


def subscriptions(patterns: DataFrame, as_of: date) -> DataFrame:
    """Recurring payments with yearly and monthly cost and status; overdue ones come first where ordered by (overdue desc, days_left, merchant)."""
    yearly = F.col("typical_amount") * dates.annual_multiplier(F.col("frequency"))
    return patterns.select(
        "user_id", "merchant", "frequency", "typical_amount", F.round(yearly, 2).alias("annual_cost"), F.round(yearly / 12, 2).alias("monthly_cost"), "next_expected",
        F.datediff("next_expected", F.lit(as_of)).alias("days_left"), dates.subscription_status(F.lit(True), F.col("next_expected"), F.lit(as_of)).alias("status"),
    )


def subscription_order(overview: DataFrame) -> DataFrame:
    """The overview with each subscription's ``place`` among its user's: overdue ones first, then by days left and name."""
    order = [F.when(F.col("status") == "overdue", 0).otherwise(1), F.col("days_left").asc_nulls_last(), F.col("merchant")]
    return overview.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*order)))


def subscription_totals(overview: DataFrame) -> DataFrame:
    return overview.groupBy("user_id").agg(F.count("*").alias("subscriptions"), F.round(F.sum("annual_cost"), 2).alias("annual_cost"), F.count_if(F.col("status") == "overdue").alias("overdue"), F.count_if(F.col("status") == "upcoming").alias("upcoming"))


def anomalies(ledger: DataFrame, as_of: date, window_days: int = 30, history_days: int = 90, sigma: float = 2.0, floor=rules.NEW_MERCHANT_AMOUNT) -> DataFrame:
    """Category spikes, else first large payments to a merchant, among the last ``window_days``.

    A spike's baseline is the category's amounts without those equal to its own:
    (n, sum, sum of squares) of the category less those of the equal amounts, so
    no row is joined to its history.
    """
    start, since = as_of - timedelta(days=window_days), as_of - timedelta(days=history_days)
    rows = active(ledger).where("direction = 'debit' AND nature = 'expense'").where(F.col("transaction_date") >= F.lit(since)).withColumn("_p", money.paise(F.col("amount")))
    category = F.coalesce("category_name", F.lit("\0"))
    rows = rows.withColumn("_category", category)
    square = lambda c: (c.cast("decimal(19,0)") * c.cast("decimal(19,0)"))
    same = rows.groupBy("user_id", "_category", "_p").agg(F.count("*").alias("_k"))
    whole = same.groupBy("user_id", "_category").agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col("_p")).alias("_s"), F.sum(F.col("_k") * square(F.col("_p"))).alias("_q"), F.count("*").alias("_distinct"))
    new = rows.where("merchant_normalized <> ''").groupBy("user_id", F.upper("merchant_normalized").alias("_merchant")).agg(F.min("transaction_date").alias("_first"))
    n = (F.col("_n") - F.col("_k")).cast("double")
    s = (F.col("_s") - F.col("_k") * F.col("_p")).cast("double")
    q = (F.col("_q") - F.col("_k") * square(F.col("_p"))).cast("double")
    mean, sd = s / n, F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    spike = (F.col("_n") - F.col("_k") >= rules.SPIKE_LEAST) & (F.col("_distinct") >= 3) & (F.col("_p") > mean + sigma * sd)
    large = (F.col("amount") >= F.lit(floor)) & (F.col("_first") >= F.lit(start))
    return (
        rows.where(F.col("transaction_date") >= F.lit(start)).withColumn("_merchant", F.upper("merchant_normalized"))
        .join(same, ["user_id", "_category", "_p"]).join(whole, ["user_id", "_category"]).join(new, ["user_id", "_merchant"], "left")
        .withColumn("reason", F.when(spike, "category_spike").when(F.coalesce(large, F.lit(False)), "new_large_merchant")).where("reason IS NOT NULL")
        .select("txn_id", "user_id", "transaction_date", "amount", "reason", F.round(F.when(F.col("reason") == "category_spike", mean / 100), 2).alias("expected_mean"), F.round(F.when(F.col("reason") == "category_spike", (F.col("_p") - mean) / sd), 2).alias("deviation"))
    )


def search(ledger: DataFrame, query: str, newest: int = 500, top: int = 25) -> DataFrame:
    """The best matches of each user among their ``newest`` entries that hold a word of the query.

    Scores: 3 for a word in the normalised merchant, 2 in the raw one, 1 in notes
    or bank; 5 once for the whole phrase; 1.5 for a word in the category.
    """
    words = sorted({w.lower() for w in re.findall("[A-Za-z0-9]{2,}", query)}, key=query.lower().index)
    fields = {"merchant_normalized": 3.0, "merchant_raw": 2.0, "notes": 1.0, "bank_name": 1.0}
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields}
    phrase = query.strip().lower()
    if not words:
        return active(ledger).where("false").select("txn_id", "user_id", "transaction_date", F.lit(0.0).alias("score"))
    score = sum((F.when(low[c].contains(w), weight).otherwise(0.0) for w in words for c, weight in fields.items()), F.lit(0.0))
    score += F.when(reduce(lambda a, b: a | b, (c.contains(phrase) for c in low.values())), 5.0).otherwise(0.0)
    score += F.when(text.contains_any(F.lower(F.coalesce(F.col("category_name"), F.lit(""))), words), 1.5).otherwise(0.0)
    hit = reduce(lambda a, b: a | b, (low[c].contains(w) for c in fields for w in words))
    recent = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("transaction_date"), "txn_id"))
    best = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), F.desc("transaction_date"), "txn_id"))
    return (
        active(ledger).where(hit).withColumn("_r", recent).where(F.col("_r") <= newest).withColumn("score", score).where("score > 0")
        .withColumn("place", best).where(F.col("place") <= top).select("txn_id", "user_id", "transaction_date", "score", "place")
    )


def tax_planning(ledger: DataFrame, first: date, last: date) -> DataFrame:
    """What counts towards each deduction section in a financial year; an entry may count in several."""
    rows = active(ledger).where(F.col("transaction_date").between(F.lit(first), F.lit(last)))
    told = F.concat_ws(" ", F.nullif(F.col("category_name"), F.lit("")), F.nullif(F.col("merchant_normalized"), F.lit("")), F.nullif(F.col("merchant_raw"), F.lit("")))
    sums = [total(F.col("amount"), told.rlike("(?i)" + p) & (F.col("direction") == ("credit" if credits else "debit"))).alias(f"_{k}") for k, (_, p, _, credits) in enumerate(rules.SECTION_RULES)]
    flat = rows.groupBy("user_id").agg(*sums).select("user_id", F.explode(F.array(*(F.struct(F.lit(name).alias("section"), F.col(f"_{k}").alias("amount"), F.lit(cap).cast("decimal(24,2)").alias("cap")) for k, (name, _, cap, _) in enumerate(rules.SECTION_RULES)))).alias("s")).select("user_id", "s.*")
    capped = F.col("cap") > 0
    return flat.select(
        "user_id", "section", "amount", F.when(capped, F.greatest(F.col("cap") - F.col("amount"), F.lit(0).cast("decimal(24,2)"))).alias("remaining"),
        F.when(capped, F.round(F.least(F.lit(1.0), F.col("amount").cast("double") / F.col("cap").cast("double")) * 100, 2)).alias("percent"),
    )


def tax_totals(ledger: DataFrame, first: date, last: date) -> DataFrame:
    """Income by kind and tax paid, by user."""
    rows = active(ledger).where(F.col("transaction_date").between(F.lit(first), F.lit(last)))
    amount, nature = F.col("amount"), F.col("nature")
    salary = text.says(F.col("merchant_raw"), rules.SALARY)
    return rows.groupBy("user_id").agg(
        total(amount, (nature == "income") & salary).alias("salary_income"), total(amount, (nature == "income") & ~salary).alias("other_income"),
        total(amount, nature == "interest_income").alias("interest_income"), total(amount, nature == "dividend_income").alias("dividend_income"),
        total(amount, nature == "tax").alias("tax_payments"), total(amount, nature == "investment").alias("investments"), total(amount, nature == "expense").alias("expenses"),
    ).withColumn("total_income", F.col("salary_income") + F.col("other_income") + F.col("interest_income") + F.col("dividend_income"))


def interest_by_account(ledger: DataFrame) -> DataFrame:
    return active(ledger).where("nature = 'interest_income'").where(F.col("account_type").isin("savings", "current", "bank_account")).groupBy("user_id", "bank_name", "account_masked").agg(F.sum("amount").alias("interest"), F.count("*").alias("entries"))


def large_cash(ledger: DataFrame, least: float, top: int = 20) -> DataFrame:
    """Each user's largest cash-like expenses."""
    cash = text.says(F.col("merchant_raw"), ("ATM", "CASH"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("amount"), "txn_id"))
    return active(ledger).where("nature = 'expense'").where(cash & (F.col("amount") >= F.lit(least))).withColumn("place", place).where(F.col("place") <= top).select("user_id", "txn_id", "amount", "place")


def anomaly_list(found: DataFrame, ledger: DataFrame, most: int = 50) -> DataFrame:
    """Each user's anomalies (txn_id, user_id, reason), newest and then largest first, ``most`` of them."""
    rows = found.select("txn_id", "user_id", "reason").join(ledger.select("txn_id", "transaction_date", "amount"), "txn_id")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("transaction_date"), F.desc("amount"), "txn_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def cashflow_categories(ledger: DataFrame) -> DataFrame:
    """Each user's debits by category, the largest first."""
    sums = active(ledger).where("direction = 'debit'").groupBy("user_id", F.coalesce("category_name", F.lit("Uncategorized")).alias("category_name")).agg(F.sum("amount").alias("amount"))
    return sums.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("amount"), "category_name")))


def cashflow(ledger: DataFrame) -> DataFrame:
    return active(ledger).groupBy("user_id").agg(total(F.col("amount"), F.col("direction") == "debit").alias("debits"), total(F.col("amount"), F.col("direction") == "credit").alias("credits"))
