"""Registered queries: operators applied to the projected tables, flat results with plain types."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, money, text
from ..operators import balance, dedup, documents, extract, insights, jobs, matching, reconcile, tax
from ..operators import ledger as entries
from ..sources import files
from ..tables import written
from .ledger import AS_OF, ledger, sms_feed, statement_rows, statements, table, taxpayers, transfer_feed

FIRST, LAST = date(1999, 4, 1), date(2000, 3, 31)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers ``f``; its dates come out as text, which both engines write alike."""

    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    QUERIES[f.__name__] = plain
    return f


def doubles(df: DataFrame, *columns: str, places: int = 2) -> DataFrame:
    return df.withColumns({c: money.as_double(F.col(c), places) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query
def d1_monthly_summary(spark, sf_dir):
    return longs(doubles(insights.monthly_summary(ledger(spark, sf_dir)), "income", "expense", "net"), "txn_count")


@query
def d1_monthly_categories(spark, sf_dir):
    return doubles(insights.monthly_categories(ledger(spark, sf_dir)), "amount")


@query
def d1_top_merchants(spark, sf_dir):
    return longs(doubles(insights.monthly_merchants(ledger(spark, sf_dir)), "amount"), "txn_count", "place")


@query
def d2_month_change(spark, sf_dir):
    return insights.month_change(insights.monthly_summary(ledger(spark, sf_dir))).select("user_id", "year_month", "change_percent")


@query
def d3_spending_trend(spark, sf_dir):
    return longs(doubles(insights.spending_trend(insights.monthly_summary(ledger(spark, sf_dir)), AS_OF, 12), "income", "expense", "net"), "txn_count")


def budgets(entries_: DataFrame) -> DataFrame:
    """A yearly budget for everything and a monthly one for urgent things, for each user."""
    users = entries_.select("user_id").distinct()
    cap = lambda base: (F.lit(base) + F.col("user_id") * 1000).cast("decimal(24,2)")
    every = users.select((F.col("user_id") * 2).alias("budget_id"), "user_id", F.lit(None).cast("string").alias("category_name"), F.lit("yearly").alias("period"), cap(3000000).alias("amount_limit"))
    one = users.select((F.col("user_id") * 2 + 1).alias("budget_id"), "user_id", F.lit("1-URGENT").alias("category_name"), F.lit("monthly").alias("period"), cap(50000).alias("amount_limit"))
    return every.unionByName(one)


@query
def d4_budget_usage(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return doubles(insights.budget_usage(rows, budgets(rows), date(2001, 7, 1)), "amount_limit", "spent", "remaining")


@query
def d5_tax_totals(spark, sf_dir):
    out = insights.tax_totals(ledger(spark, sf_dir), FIRST, LAST)
    return doubles(out, *[c for c in out.columns if c != "user_id"])


@query
def d5_interest_by_account(spark, sf_dir):
    return longs(doubles(insights.interest_by_account(ledger(spark, sf_dir)), "interest"), "entries")


@query
def d7_savings_accounts(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return longs(entries.savings_accounts(statements(statement_rows(rows)), rows), "statements", "entries")


@query
def d8_tax_planning(spark, sf_dir):
    return doubles(insights.tax_planning(ledger(spark, sf_dir), FIRST, LAST), "amount", "remaining")


@query
def d12_sender_discovery(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("Sender"), (F.col("user_id") % 97).cast("string"), F.lit("@Bank"), (F.col("user_id") % 7).cast("string"), F.lit(".example")).alias("from_address"), F.concat(F.col("event_type"), F.lit(" statement "), F.col("event_id").cast("string")).alias("subject"), (F.col("value") > 50).alias("has_attachment"), F.col("event_id").alias("message_id"))
    return longs(jobs.sender_discovery(e, ["bank1.example", "bank3.example"], ["click", "purchase"]).drop("subjects"), "messages", "attachments", "keyword_subjects", "place")


@query
def d13_domain_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u@Bank"), (F.col("user_id") % 7).cast("string"), F.lit(".example")).alias("from_address"))
    return longs(jobs.domain_histogram(e), "messages")


@query
def d14_accounts_tree(spark, sf_dir):
    return longs(doubles(entries.accounts_tree(statements(statement_rows(ledger(spark, sf_dir)))), "balance"), "statements", "rows")


@query
def d16_card_totals(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir)).where("account_type = 'credit_card'")
    return doubles(rows.groupBy("statement_id").agg(money.total(F.col("amount"), F.col("direction") == "debit").alias("debits"), money.total(F.col("amount"), F.col("direction") == "credit").alias("credits")), "debits", "credits")


@query
def d20_cashflow(spark, sf_dir):
    return doubles(insights.cashflow(ledger(spark, sf_dir)), "debits", "credits")


@query
def d21_pending_count(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").try_cast("int")), F.lit(0)).cast("long").alias("pending"))


@query
def e1_balance_walk(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir))
    out = balance.balance_walk(rows, statements(rows)).select("statement_id", "computed_closing", "flagged_rows", "passed")
    return longs(doubles(out, "computed_closing"), "flagged_rows")


@query
def e2_simple_walk(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir))
    rows = rows.withColumn("is_credit", F.col("direction") == "credit")
    return longs(doubles(balance.simple_walk(rows, statements(rows)), "credits", "debits", "gap"), "rows")


@query
def e3_directions(spark, sf_dir):
    """Odd users' statements list their rows the other way round."""
    rows = statement_rows(ledger(spark, sf_dir)).withColumn("description", F.col("merchant_raw")).withColumn("seq", F.when(F.col("user_id") % 2 == 1, -F.col("seq")).otherwise(F.col("seq")))
    return balance.directions(rows).select("txn_id", "direction")


@query
def e4_recurring(spark, sf_dir):
    """Entries of one narration and user, thinned to one merchant for each sixteenth of the customers, recur about as payments do."""
    rows = ledger(spark, sf_dir).withColumn("merchant_normalized", F.concat("bank_name", F.lit(" "), (F.col("txn_id") % 16).cast("string"), F.lit(" "), (F.col("txn_id") % 40 / 8).cast("int").cast("string"))).withColumn("amount", (F.col("amount") * 0 + 1000 + F.col("txn_id") % 90).cast("decimal(14,2)"))
    out = insights.recurring(rows)
    return longs(out.select("user_id", "merchant", "occurrences", "frequency", "expected_day", "last_seen", "next_expected", "amount_variance", "category_name"), "occurrences", "expected_day")


@query
def e5_net_worth(spark, sf_dir):
    snaps = balance.snapshots_from(statements(statement_rows(ledger(spark, sf_dir))))
    return doubles(balance.net_worth_history(snaps, 12), "assets", "liabilities", "net")


@query
def e6_latest_positions(spark, sf_dir):
    return doubles(balance.latest_positions(balance.snapshots_from(statements(statement_rows(ledger(spark, sf_dir))))), "balance")


@query
def e7_anomalies(spark, sf_dir):
    """Thirty days before the last date, against the four years before; every merchant name covers some customers, so that some are new."""
    return insights.anomalies(ledger(spark, sf_dir), AS_OF, 60, 1500, 1.6).select("txn_id", "user_id", "reason", "expected_mean")


@query
def e9_carried_dates(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir)).withColumn("transaction_date", F.when(F.col("txn_id") % 4 != 0, F.col("transaction_date")))
    return balance.carried_dates(rows).select("txn_id", "transaction_date")


@query
def e10_superseded(spark, sf_dir):
    s = ledger(spark, sf_dir).select(F.col("txn_id").alias("statement_id"), "user_id", F.col("account_masked").alias("fingerprint"), F.col("transaction_date").alias("created_at"))
    return longs(dedup.superseded(s).select("statement_id", "version_no", "is_active"), "version_no")


@query
def e13_expanded_periods(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir))
    s = statements(rows).withColumn("period_start", F.date_add("period_start", 9)).withColumn("period_end", F.date_add("period_end", -9))
    return balance.expanded_periods(s, rows).select("statement_id", "period_start", "period_end")


@query
def e14_recent_history(spark, sf_dir):
    return documents.recent_history(table(spark, sf_dir, "conversations"), 6)


@query
def e15_latest_per_key(spark, sf_dir):
    return matching.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query
def b1_filtered(spark, sf_dir):
    return insights.filtered(ledger(spark, sf_dir), since=date(1998, 1, 1), until=date(1999, 12, 31), bank="building", direction="debit", least=1000, most=200000, contains="upi").select("txn_id")


@query
def b3_month_of_user(spark, sf_dir):
    rows = insights.of_user(ledger(spark, sf_dir), 7)
    return rows.where((F.col("transaction_date") >= F.lit(date(1999, 1, 1))) & (F.col("transaction_date") < F.lit(date(2000, 1, 1)))).select("txn_id", "nature")


@query
def b11_labels(spark, sf_dir):
    return ledger(spark, sf_dir).select("bank_name", "account_type").distinct().withColumn("label", text.label(F.col("bank_name"), F.col("account_type")))


@query
def f1_page(spark, sf_dir):
    return insights.page(ledger(spark, sf_dir), 40, 20).select("txn_id", "transaction_date")


@query
def f5_large_cash(spark, sf_dir):
    return longs(doubles(insights.large_cash(ledger(spark, sf_dir), 10000), "amount"), "place")


@query
def h13_search(spark, sf_dir):
    return longs(insights.search(ledger(spark, sf_dir), "upi swiggy order", 500, 25), "place")


@query
def g1_fingerprints(spark, sf_dir):
    return ledger(spark, sf_dir).select("txn_id", dedup.fingerprint().alias("fingerprint"), dedup.dedup_key().alias("dedup_key"))


@query
def g2_statement_fingerprints(spark, sf_dir):
    return statements(statement_rows(ledger(spark, sf_dir))).select("statement_id", dedup.statement_fingerprint().alias("fingerprint"))


@query
def g4_batch_dedup(spark, sf_dir):
    """All rows as a batch against all rows as they would be 400 days later."""
    key = lambda day: F.concat_ws("|", "user_id", dates.month(day), (F.col("txn_id") % 5).cast("string"))
    rows, day = ledger(spark, sf_dir), F.col("transaction_date")
    return dedup.new_rows(rows.withColumn("key", key(day)), rows.withColumn("key", key(F.date_add(day, 400))), ["key"], ["transaction_date", "txn_id"]).select("txn_id")


@query
def g7_insert_counts(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("txn_id", "user_id", "category_name", F.year("transaction_date").alias("year"))
    old = rows.where("year < 1998").select("user_id", "category_name")
    return dedup.insert_counts(rows.where("year >= 1998"), dedup.new_rows(rows.where("year >= 1998"), old.where("user_id % 2 = 0"), ["user_id", "category_name"], ["txn_id"]))


@query
def g11_orphans(spark, sf_dir):
    return dedup.orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id")))


@query
def h_scalars(spark, sf_dir):
    """Text, money and date functions on statement-like texts made from the ledger."""
    k = F.col("txn_id")
    rows = ledger(spark, sf_dir).select(
        k, "merchant_raw", "transaction_date", "account_masked",
        F.concat(F.lit("Rs. "), F.format_number(F.col("amount"), 2), F.when(k % 2 == 0, " CR").otherwise(" DR")).alias("amount_raw"),
        F.date_format("transaction_date", "dd/MM/yyyy").alias("date_raw"),
    )
    c = F.col
    return rows.select(
        "txn_id", text.plain_words(c("merchant_raw")).alias("plain"), text.merchant_hint(c("merchant_raw")).alias("hint"), F.array_join(text.tokens(c("merchant_raw")), " ").alias("tokens"),
        text.mask_tail(c("merchant_raw")).alias("masked"), text.slug(c("merchant_raw"), c("account_masked")).alias("slug"),
        money.parse_inr(c("amount_raw")).alias("inr"), money.as_double(money.parse_decimal(c("amount_raw"))).alias("parsed"), money.at_most_two_decimals(c("amount_raw")).alias("two_decimals"), money.credit_flag(c("amount_raw")).alias("credit"),
        dates.parse_date(c("date_raw"), AS_OF, 1990).alias("day"), dates.fy_label(c("transaction_date")).alias("fy"), dates.plus_months(c("transaction_date"), 1, F.lit(31)).alias("next_month"),
    )


@query
def h23_text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.low_signal(F.col("text")).alias("low_signal"), F.size(text.keyword_tokens(F.col("text"))).cast("long").alias("keywords"))


@query
def h24_difficulty(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n, lines = F.length("text"), F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    noise = F.length(F.regexp_replace("text", r"[^|~`\f]", "")) / F.greatest(n, F.lit(1)) * 100
    score = text.difficulty(F.lit(3), n, lines, noise)
    return d.select("doc_id", F.round(score, 4).alias("score"), text.difficulty_band(score).alias("band"))


@query
def i1_nature_counts(spark, sf_dir):
    return longs(ledger(spark, sf_dir).groupBy("direction", "account_type", "nature").agg(F.count("*").alias("n")), "n")


@query
def i3_merchants(spark, sf_dir):
    p = spark.createDataFrame([(1, "contains", "swiggy", 5, "Swiggy", "Food Delivery"), (2, "contains", "upi", 1, "UPI payment", "Transfer"), (3, "regex", "netflix|rent", 9, "Home", "Home"), (4, "contains", "mutual fund", 3, "Fund", "Investment"), (5, "exact", "no such text", 99, "None", "None")], "pattern_id int, kind string, pattern string, priority int, merchant string, category string")
    return matching.merchants(ledger(spark, sf_dir), p)


@query
def i4_categories(spark, sf_dir):
    return ledger(spark, sf_dir).select("txn_id", classify.category(F.col("merchant_raw")).alias("guess"))


@query
def i7_recurring_buckets(spark, sf_dir):
    return longs(ledger(spark, sf_dir).groupBy(classify.recurring_bucket(F.col("merchant_raw"), F.col("category_name")).alias("bucket")).agg(F.count("*").alias("n")), "n")


def raw_rows(rows: DataFrame) -> DataFrame:
    """Statement rows as an extractor would give them, some of them broken."""
    k = F.col("txn_id")
    return statement_rows(rows).select(
        "statement_id", "seq", "user_id", "account_masked", "account_type", "txn_id",
        F.when(k % 41 == 0, "no date").otherwise(F.date_format("transaction_date", "dd/MM/yyyy")).alias("date_raw"),
        F.when(k % 43 == 0, "n/a").when(k % 47 == 0, F.concat(F.format_number(F.col("amount"), 2), F.lit("5"))).otherwise(F.format_number(F.col("amount"), 2)).alias("amount_raw"),
        F.col("balance_after").cast("string").alias("balance_raw"), F.when(k % 31 == 0, "?").when(F.col("direction") == "credit", "CR").otherwise("DR").alias("txn_type_raw"),
        F.when(k % 53 == 0, "  ").otherwise(F.col("merchant_raw")).alias("description_raw"), (F.lit(0.70) + (k % 5) / 20).alias("confidence"),
        F.when(k % 6 == 0, "llm_text").otherwise("template").alias("source"), F.trunc("transaction_date", "MM").alias("period_start"), F.date_add(F.trunc("transaction_date", "MM"), 27).alias("period_end"),
    )


@query
def i8_validated(spark, sf_dir):
    v = entries.validate(raw_rows(ledger(spark, sf_dir)), AS_OF, 1990)
    return v.select("txn_id", "validation_status", F.array_join("validation_errors", ",").alias("errors"))


@query
def i11_card_integrity(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir)).where("account_type = 'credit_card'")
    s = statements(rows).select("statement_id", F.col("total_due").cast("double").alias("due"), F.col("opening_balance").cast("double").alias("previous"), F.col("closing_balance").cast("double").alias("closing"), "row_count")
    sums = rows.groupBy("statement_id").agg(money.as_double(money.total(F.col("amount"), F.col("direction") == "debit")).alias("debits"), money.as_double(money.total(F.col("amount"), F.col("direction") == "credit")).alias("credits"))
    c = F.col
    return s.join(sums, "statement_id").withColumns(classify.card_integrity(c("debits"), c("credits"), c("due"), c("previous"), c("closing"), c("row_count"))).select("statement_id", "net_activity", "due_gap", "closing_gap", "status")


@query
def i13_hints(spark, sf_dir):
    t = F.concat("merchant_raw", F.lit(" "), F.lower("bank_name"), F.when(F.col("txn_id") % 3 == 0, " savings account statement").when(F.col("txn_id") % 3 == 1, " credit card").otherwise(""))
    return ledger(spark, sf_dir).select("txn_id", classify.bank_hint(t).alias("bank"), classify.account_type_hint(t).alias("account_type_hint"))


def sms_messages(rows: DataFrame) -> DataFrame:
    k = F.col("txn_id")
    amount = F.format_number(F.col("amount"), 2)
    body = (
        F.when(k % 6 == 0, F.concat(F.lit("Rs."), amount, F.lit(" debited from a/c XX1234 on UPI Ref No 123456789012 to shop@okbank. Avl bal Rs."), amount))
        .when(k % 6 == 1, F.concat(F.lit("INR "), amount, F.lit(" credited to account XX"), F.lpad((k % 10000).cast("string"), 4, "0")))
        .when(k % 6 == 2, F.lit("482913 is your OTP. Do not share your OTP with anyone")).when(k % 6 == 3, F.lit("Exclusive offer: cashback up to Rs.500, apply now"))
        .when(k % 6 == 4, F.lit("Your KYC expired, click http://bit.ly/x to verify")).otherwise(F.concat(F.lit("Balance in your account is Rs."), amount))
    )
    address = F.element_at(F.array(*map(F.lit, ("AD-HDFCBK", "VM-ICICIT-S", "BZ-AXISBK", "+919876543210", "XX-UNKNWN"))), (k % 5).cast("int") + 1)
    return rows.select(k.alias("sms_id"), "user_id", address.alias("address"), body.alias("body"), k.alias("sent"))


@query
def i18_sms_classes(spark, sf_dir):
    return extract.sms_classes(sms_messages(ledger(spark, sf_dir))).select("sms_id", F.col("spam_score").cast("long"), "sms_class")


@query
def i19_sms_parsed(spark, sf_dir):
    m = sms_messages(ledger(spark, sf_dir))
    got = m.where(classify.sms_class(F.col("address"), F.col("body")).startswith("transaction")).withColumns(classify.sms_parsed(F.col("address"), F.col("body"), F.col("sent")))
    return doubles(got.select("sms_id", "bank_name", "account_masked", "amount", "balance_after", "reference_number", "upi_id", F.round("confidence", 2).alias("confidence")), "amount", "balance_after")


@query
def c1_category_join(spark, sf_dir):
    names = ledger(spark, sf_dir).select("category_name").where("category_name <> '5-LOW'").distinct().withColumn("category_id", F.xxhash64("category_name"))
    return longs(ledger(spark, sf_dir).join(names, "category_name", "left").groupBy(F.col("category_id").isNotNull().alias("known")).agg(F.count("*").alias("n")), "n")


@query
def c10_duplicates(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    keyed = lambda df: df.withColumn("fingerprint", dedup.fingerprint()).withColumn("reference_number", F.when(F.col("txn_id") % 13 == 0, F.concat(F.lit("REF"), (F.col("txn_id") % 1000000000).cast("string"))))
    return matching.duplicates(keyed(sms_feed(rows)), keyed(rows), similar=False)


@query
def c10_duplicates_similar(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    keyed = lambda df: df.withColumn("fingerprint", dedup.fingerprint()).withColumn("reference_number", F.lit(None).cast("string"))
    return matching.duplicates(keyed(sms_feed(rows)), keyed(rows), similar=True)


@query
def c11_transfer_pairs(spark, sf_dir):
    return longs(doubles(matching.transfer_pairs(insights.active(transfer_feed(ledger(spark, sf_dir))), 7), "amount", "confidence"), "day_gap")


@query
def c12_upi_reversals(spark, sf_dir):
    rows = transfer_feed(ledger(spark, sf_dir)).withColumn("merchant_raw", F.when(F.col("txn_id") > 2000000000, F.concat(F.lit("UPI REVERSAL "), "merchant_raw")).otherwise(F.concat(F.lit("UPI "), "merchant_raw"))).withColumn("amount", F.floor("amount").cast("decimal(14,2)"))
    return longs(matching.upi_reversals(rows), "day_gap")


@query
def c13_sms_statement_match(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return longs(matching.sms_statement_match(sms_feed(rows), rows), "day_gap")


@query
def c14_card_payment_pairs(spark, sf_dir):
    return longs(doubles(matching.card_payment_pairs(transfer_feed(ledger(spark, sf_dir))), "amount", "confidence"), "day_gap")


def portal_lines(rows: DataFrame) -> DataFrame:
    """The income entries as portal lines, every second of them up to 6 % off and the others twice as large."""
    k = F.col("txn_id")
    percent = F.when(k % 2 == 0, 100 + k % 7).otherwise(200)
    return rows.where("bucket IS NOT NULL").select(k.alias("line_id"), "user_id", "fy", "bucket", (F.col("amount") * percent / 100).cast("decimal(14,2)").alias("amount"))


def income_rows(rows: DataFrame) -> DataFrame:
    buckets = classify.codes(((F.col("nature") == "income") & F.col("merchant_raw").contains("SALARY"), "salary"), (F.col("nature") == "interest_income", "interest"), (F.col("nature") == "dividend_income", "dividend"))
    return insights.active(rows).withColumn("fy", dates.fy_label(F.col("transaction_date"))).withColumn("bucket", F.explode(buckets))


@query
def c15_portal_matches(spark, sf_dir):
    rows = written(income_rows(ledger(spark, sf_dir)).select("txn_id", "user_id", "fy", "bucket", "amount"), "income-rows")
    return doubles(matching.portal_matches(portal_lines(rows), rows), "portal_amount", "ledger_amount")


@query
def c16_reimported(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("file_hash", F.concat(F.lit("f"), (F.col("txn_id") % 900).cast("string"))).withColumn("statement_fp", F.concat_ws("|", "user_id", dates.month(F.col("transaction_date"))))
    again = rows.where("txn_id % 3 = 0").withColumn("file_hash", F.when(F.col("txn_id") % 2 == 0, F.col("file_hash")).otherwise("new")).withColumn("statement_fp", F.when(F.col("txn_id") % 9 == 0, F.col("statement_fp")).otherwise("other"))
    return dedup.reimported(again, rows).select("txn_id")


@query
def c17_knowledge_rank(spark, sf_dir):
    """Every document looks at every other one: all have one owner. Their language stands for the bank, how they begin for the account type, and long ones for statements."""
    kind = F.when(F.col("n_chars") >= 1000, "bank_statement").when(F.col("n_chars") >= 300, "letter")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("all").alias("owner"), F.col("lang").alias("bank_hint"), F.lower(F.substring("text", 1, 1)).alias("account_type_hint"), kind.alias("doc_type"))
    return longs(documents.knowledge_rank(d, d, newest=None), "score", "place")


@query
def j16_transfer_report(spark, sf_dir):
    rows = transfer_feed(ledger(spark, sf_dir)).withColumn("nature", F.lit("transfer_internal"))
    return longs(matching.transfer_report(rows, 7), "transfers", "matched_pairs", "unmatched")


@query
def j2_promotion_counts(spark, sf_dir):
    return longs(_promotion(spark, sf_dir).counts, "rows", "invalid", "created", "duplicates")


@query
def j2_promotion_reviews(spark, sf_dir):
    return longs(_promotion(spark, sf_dir).reviews.groupBy("reason").agg(F.count("*").alias("n")), "n")


def _promotion(spark: SparkSession, sf_dir: str) -> entries.Promotion:
    """Every tenth row is in the ledger already; every seventeenth is too, the other way round, from another statement of the same file."""
    rows = ledger(spark, sf_dir)
    v = entries.validate(raw_rows(rows), AS_OF, 1990).withColumn("file_hash", F.concat(F.lit("f"), F.col("user_id").cast("string"))).withColumn("statement_fp", F.lit(None).cast("string"))
    v = written(v, "validated")  # the ledger that was and what joins it both read it, several times
    good = v.where("validation_status <> 'invalid'").withColumn("transaction_date", F.col("txn_date")).withColumn("merchant_raw", F.col("description"))
    credit = F.coalesce("is_credit", F.lit(False))
    side = lambda c: F.when(c, "credit").otherwise("debit")
    none = F.lit(None).cast("string")
    was = good.where("txn_id % 10 = 3").withColumn("direction", side(credit)).withColumn("dedup_key", dedup.dedup_key()).withColumn("file_hash", none)
    again = good.where("txn_id % 17 = 4").withColumn("direction", side(~credit)).withColumn("dedup_key", F.lit("from another statement"))
    existing = was.unionByName(again).select("user_id", "dedup_key", "file_hash", "statement_fp", "transaction_date", "amount", "merchant_raw", F.concat(F.lit("old-"), "statement_id").alias("statement_id"))
    return entries.promote(v, existing, statements(statement_rows(rows)))


@query
def j5_splits(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    half = (F.col("amount") / 2).cast("decimal(14,2)")
    parts = rows.where("txn_id % 50 = 0").select("txn_id", F.lit(1).alias("split_index"), half.alias("amount")).unionByName(rows.where("txn_id % 50 = 0").select("txn_id", F.lit(2).alias("split_index"), (F.col("amount") - half + F.when(F.col("txn_id") % 100 == 0, 1).otherwise(0)).cast("decimal(14,2)").alias("amount")))
    after, _ = entries.split(rows, parts)
    return longs(doubles(after.groupBy("is_excluded", F.col("parent_id").isNotNull().alias("is_part")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount"), "n")


@query
def j6_audit(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return entries.updated(rows, rows.where("txn_id % 20 = 0"), {"nature": "expense", "category_name": "5-LOW", "notes": "set by rule"})[1]


@query
def j9_bills(spark, sf_dir):
    return doubles(balance.bills(statements(statement_rows(ledger(spark, sf_dir)))), "total_due")


@query
def j15_subscriptions(spark, sf_dir):
    """Overview of the recurring payments of e4_recurring."""
    return insights.subscriptions(e4_patterns(spark, sf_dir), AS_OF).select("user_id", "merchant", "annual_cost", "monthly_cost", F.col("days_left").cast("long").alias("days_left"), "status")


def e4_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e4_recurring(spark, sf_dir).withColumn("typical_amount", F.lit(1000.0) + F.col("occurrences"))


@query
def l7_compare_regimes(spark, sf_dir):
    out = tax.compare(taxpayers(spark, sf_dir), "2024-25")
    keep = ["old_taxable", "old_slab_tax", "old_rebate", "old_surcharge", "old_cess", "old_total", "new_taxable", "new_slab_tax", "new_rebate", "new_surcharge", "new_total", "delta"]
    return doubles(out.select("user_id", *keep, "recommendation"), *keep)


@query
def l9_capital_gains(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("user_id"), F.date_add(F.lit(date(2024, 4, 1)), (k % 365).cast("int")).alias("realised_on"), F.when(k % 2 == 0, "stcg").otherwise("ltcg").alias("kind"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"))
    out = tax.capital_gains(lines, "2024-25")
    return doubles(out, *[c for c in out.columns if c != "user_id"])


@query
def l10_hra(spark, sf_dir):
    t = taxpayers(spark, sf_dir)
    city = F.element_at(F.array(*map(F.lit, ("Mumbai", "Pune", " delhi ", "Jaipur"))), (F.col("user_id") % 4).cast("int") + 1)
    return doubles(t.select("user_id", tax.hra_exemption(F.col("gross_salary") / 5, F.col("user_id") % 50 * 9000, F.col("gross_salary") / 2, city).alias("exemption")), "exemption")


@query
def l11_utilisation(spark, sf_dir):
    return doubles(tax.utilisation(taxpayers(spark, sf_dir)), "cap", "claimed", "remaining")


@query
def l12_what_if(spark, sf_dir):
    return doubles(tax.what_if(taxpayers(spark, sf_dir), "2025-26", {"full_80c": {"deduction_80c": 150000}, "no_house": {"home_loan_interest_self": 0, "home_loan_interest_letout": 0}}), "tax", "saving")


@query
def l13_itr_form(spark, sf_dir):
    k = F.col("user_id")
    p = taxpayers(spark, sf_dir).select(k, F.col("gross_salary").alias("total_income"), (k % 5 == 0).alias("has_business_income"), (k % 10 == 0).alias("is_presumptive"), (k % 7 == 0).alias("has_capital_gains"), (k % 17 == 0).alias("has_foreign_assets"), (k % 19 != 0).alias("is_resident"), (k % 6 * 1500).alias("agricultural_income"))
    return tax.itr_form(p).select("user_id", "form", F.array_join("blockers", ",").alias("blockers"))


@query
def l14_simple_regime(spark, sf_dir):
    t = taxpayers(spark, sf_dir).withColumns(tax.simple_new_regime(F.col("gross_salary") / 3, 2023))
    return doubles(t.select("user_id", "tax_before_rebate", "rebate", "total_tax"), "tax_before_rebate", "rebate", "total_tax")


def portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a portal says of each user: the ledger's figures, off or absent by remainder."""
    t = insights.tax_totals(ledger(spark, sf_dir), FIRST, LAST)
    u = F.col("user_id")
    return t.select(
        u, F.when(u % 5 != 0, F.col("salary_income") + u % 4 * 60).alias("gross_salary"), F.when(u % 6 != 0, F.col("interest_income") + u % 3 * 80).alias("interest_income"),
        F.when(u % 7 != 0, F.col("dividend_income")).alias("dividend_income"), F.when(u % 3 != 0, F.col("tax_payments") + u % 2 * 3).alias("self_paid_tax"), (u % 4 * 1000).cast("decimal(24,2)").alias("securities_sold"),
    )


def _outcomes(df: DataFrame, *keys: str) -> DataFrame:
    return doubles(df.select("user_id", *keys, "portal_amount", "ledger_amount", "kind"), "portal_amount", "ledger_amount")


@query
def m1_form16(spark, sf_dir):
    return _outcomes(reconcile.form16(portal(spark, sf_dir), reconcile.ledger_buckets(ledger(spark, sf_dir), FIRST, LAST)))


@query
def m3_self_paid(spark, sf_dir):
    return _outcomes(reconcile.self_paid(portal(spark, sf_dir), reconcile.ledger_buckets(ledger(spark, sf_dir), FIRST, LAST)))


@query
def m4_ais_buckets(spark, sf_dir):
    return _outcomes(reconcile.ais_buckets(portal(spark, sf_dir), reconcile.ledger_buckets(ledger(spark, sf_dir), FIRST, LAST)), "bucket")


@query
def m5_line_sums(spark, sf_dir):
    rows = income_rows(ledger(spark, sf_dir))
    return _outcomes(reconcile.line_sums(portal_lines(rows), rows, ["user_id", "fy", "bucket"]), "fy", "bucket")


@query
def m8_reports(spark, sf_dir):
    p, b = portal(spark, sf_dir), reconcile.ledger_buckets(ledger(spark, sf_dir), FIRST, LAST)
    out = reconcile.all_reports(reconcile.report(reconcile.form16(p, b), "form16"), reconcile.report(reconcile.self_paid(p, b), "self_paid"))
    return longs(doubles(out, "portal_total", "ledger_total"), "matched", "missing_in_ledger", "missing_in_portal", "amount_mismatch")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, u = ledger(spark, sf_dir), F.col("user_id")
    n = rows.groupBy("user_id").agg(F.count("*").alias("ledger_rows"))
    return insights.tax_totals(rows, FIRST, LAST).join(n, "user_id").withColumns({
        "tax_form": u % 2, "interest_certificate": u % 3, "dividend_report": u % 4, "tax_challan": u % 5, "large_cash": u % 6, "savings_accounts": u % 7,
        "documented_interest": F.col("interest_income") - u % 3 * 4000, "documented_tax": F.col("tax_payments") - u % 4 * 600, "unresolved_documents": F.greatest(u % 9 - 7, F.lit(0)),
    })


@query
def m10_action_items(spark, sf_dir):
    return reconcile.action_items(facts(spark, sf_dir))


@query
def m11_cross_verify(spark, sf_dir):
    app = insights.tax_totals(ledger(spark, sf_dir), FIRST, LAST).select("user_id", "total_income", "salary_income", "interest_income", F.lit(0).cast("decimal(18,2)").alias("tds_deducted"), F.col("tax_payments").alias("advance_tax_paid"))
    p = app.where("user_id % 4 <> 0").withColumn("salary_income", F.col("salary_income") + F.col("user_id") % 3 * 300).withColumn("advance_tax_paid", F.col("advance_tax_paid") + F.col("user_id") % 2)
    return longs(doubles(reconcile.cross_verify(app, p), "app_amount", "portal_amount"), "tolerance")


@query
def m12_checklist(spark, sf_dir):
    """Portal lines of the year, and documents and coverage by remainder."""
    rows, u = ledger(spark, sf_dir), F.col("user_id")
    n = insights.active(rows).groupBy("user_id").agg(F.count_if(F.col("transaction_date").between(F.lit(FIRST), F.lit(LAST))).alias("n"))
    lines = portal_lines(income_rows(rows)).where("fy = '1999-00'").groupBy("user_id").agg(F.count_if(F.col("bucket") == "salary").alias("salary"), F.count_if(F.col("bucket") == "interest").alias("interest"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = n.join(lines, "user_id", "left").select(
        u, (u % 9 != 0).alias("has_ais"), (u % 4 != 0).alias("has_26as"), (u % 3 != 0).alias("has_form16"), (zero("salary") > 0).alias("ais_salary"), (u % 5 == 0).alias("ais_securities"), zero("interest").alias("ais_interest_lines"),
        (u % 4).alias("form16a_sections"), (u % 6).alias("coverage_rows"), F.floor(F.col("n") / 30).alias("ledger_rows"),
    )
    return longs(reconcile.checklist(told), "evidence")


@query
def e12_chunks(spark, sf_dir):
    return longs(documents.fixed_chunks(table(spark, sf_dir, "documents"), 1800, 240).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256")), "chunk_no")


@query
def h17_masked(spark, sf_dir):
    return documents.masked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("masked_sha256"))


@query
def o2_claim_order(spark, sf_dir):
    return longs(jobs.claim_order(job_table(spark, sf_dir)), "place")


@query
def o3_retries(spark, sf_dir):
    return longs(jobs.retried(job_table(spark, sf_dir).withColumn("attempts", (F.col("job_id") % 5).cast("int"))).select("job_id", "next_status", "wait_seconds"), "wait_seconds")


def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), "user_id", F.when(F.col("event_type") == "click", "running").otherwise("queued").alias("status"), (F.col("event_id") % 3).cast("int").alias("priority"), F.col("ts").alias("created_at"))


@query
def o6_event_windows(spark, sf_dir):
    """Extension: counts of events in five-minute windows, as the stream keeps them."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return longs(doubles(e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "value"), "value"), "n")


@query
def a10_export(spark, sf_dir):
    return files.exported(ledger(spark, sf_dir))


@query
def j10_snapshots(spark, sf_dir):
    return doubles(balance.snapshots_from(statements(statement_rows(ledger(spark, sf_dir)))), "balance")


@query
def i10_gates(spark, sf_dir):
    n = F.col("row_count")
    s = statements(statement_rows(ledger(spark, sf_dir))).select(
        "statement_id", (F.col("user_id") % 13 == 0).cast("int").alias("quarantined"), n.alias("extracted_rows"), F.when(F.col("user_id") % 3 != 0, n * (1 + F.col("user_id") % 4) + 4).alias("expected_rows"),
        F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 7 != 0).alias("walk_passed"), F.when(F.col("user_id") % 11 == 0, "review").otherwise("ok").alias("card_status"),
    )
    return entries.gates(s).select("statement_id", "yield_rate", "parse_status")


@query
def d10_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 20).alias("successes"), F.count_if(F.col("value") > 50).alias("extracted_rows"), F.count_if((F.col("value") > 10) & (F.col("event_type") != "click")).alias("expected_rows"))
    return jobs.health(e).select("event_type", "success_rate", "yield_rate")


@query
def d11_parser_support_queue(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("bank_name"), (F.col("user_id") % 2).cast("string").alias("account_type"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("reason"), F.concat(F.lit("f"), (i % 11).cast("string")).alias("file_name"), F.concat(F.lit("m"), i.cast("string")).alias("message"), i.alias("seen_at"))
    out = jobs.parser_support_queue(e).withColumn("files", F.array_join("files", ","))
    return longs(out, "failures").select("bank_name", "account_type", "reason", "failures", "files", "last_seen", "message")


@query
def m2_tds(spark, sf_dir):
    u = F.col("user_id")
    t = insights.tax_totals(ledger(spark, sf_dir), FIRST, LAST)
    p = t.select(u, F.when(u % 4 != 0, F.col("interest_income") / 10).cast("decimal(24,2)").alias("tds_total"))
    d = t.where(u % 5 != 0).select(u, ((F.col("interest_income") / 10).cast("decimal(24,2)") + u % 3).alias("amount"))
    return _outcomes(reconcile.tds(p, d))


@query
def b8_anti_exists(spark, sf_dir):
    """Accounts with entries that aren't among those with a balance."""
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
