"""Ledger tables projected from the driver's tables, deterministically.

``orders`` and ``customer`` stand in for a ledger: an order is an entry, its
status the direction, its customer the account and, by remainder, the user.
Feeds (SMS, statements, snapshots, portal lines, taxpayers) follow from it by
arithmetic on its keys.
"""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, dates

#: Narrations that reach every rule of the nature and category chains. Fixed values, by remainder of the key.
NARRATIONS = (
    "UPI SWIGGY ORDER", "NEFT SALARY PAYROLL", "CREDIT CARD PAYMENT HDFC", "MUTUAL FUND ZERODHA", "ADVANCE TAX CHALLAN", "IMPS SELF TRANSFER TO A/C",
    "UPI REFUND FAILED", "SAVINGS INTEREST CREDIT", "DIVIDEND PAYOUT", "NETFLIX MONTHLY", "HOUSE RENT LANDLORD", "ATM WDL CASH",
    "AUTOPAY BILLDESK", "UPI OLA RIDE", "ELECTRICITY BESCOM BILL", "POS STORE MEDICLAIM",
)
AS_OF = date(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order. Customers are joined as Spark sees fit: broadcast while small, else shuffled by key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return (
        orders.join(customers, cust == F.col("c_custkey"))
        .select(
            key.alias("txn_id"), (cust % 50).alias("user_id"), F.concat(F.lit("XX"), F.lpad((cust % 10000).cast("string"), 4, "0")).alias("account_masked"),
            F.col("o_orderdate").cast("date").alias("transaction_date"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "credit").otherwise("debit").alias("direction"),
            F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), "credit_card").otherwise("savings").alias("account_type"), F.col("c_mktsegment").alias("bank_name"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("category_name"),
            F.concat(_pick(NARRATIONS, key), F.lit(" "), "c_name").alias("merchant_raw"), F.when(key % 5 != 0, F.col("c_name")).alias("merchant_normalized"),
            F.when(key % 11 == 0, F.lit("checked by hand")).alias("notes"), (key % 37 == 0).alias("is_excluded"),
        )
        .withColumn("nature", classify.nature(F.col("merchant_raw"), F.col("direction"), F.col("account_type")))
    )


def sms_feed(entries: DataFrame) -> DataFrame:
    """Every third entry again, up to four days and 1.20 off."""
    k = F.col("txn_id")
    return (
        entries.where(k % 3 == 0)
        .withColumn("transaction_date", F.date_add("transaction_date", (k % 9 - 4).cast("int")))
        .withColumn("amount", (F.col("amount") + ((k % 5 - 2) * F.lit(0.60).cast("decimal(4,2)"))).cast("decimal(14,2)"))
        .withColumn("txn_id", k + 1000000000)
    )


def transfer_feed(entries: DataFrame) -> DataFrame:
    """The ledger with a mirror credit for every fourth debit, up to seven days and 0.40 off."""
    k = F.col("txn_id")
    mirror = (
        entries.where((F.col("direction") == "debit") & (k % 4 == 0))
        .withColumn("transaction_date", F.date_add("transaction_date", (k % 8).cast("int")))
        .withColumn("amount", (F.col("amount") + ((k % 3 - 1) * F.lit(0.40).cast("decimal(4,2)"))).cast("decimal(14,2)"))
        .withColumn("direction", F.lit("credit")).withColumn("account_type", F.when(F.col("account_type") == "savings", "credit_card").otherwise("savings"))
        .withColumn("account_masked", F.concat(F.lit("YY"), F.lpad((k % 10000).cast("string"), 4, "0"))).withColumn("txn_id", k + 2000000000)
    )
    return entries.unionByName(mirror)


def statement_rows(entries: DataFrame) -> DataFrame:
    """Entries as rows of monthly statements. Printed balances are there for two rows in three; every 29th is 5 off."""
    k = F.col("txn_id")
    month = dates.month(F.col("transaction_date"))
    w = W.partitionBy("statement_id").orderBy("transaction_date", "txn_id").rowsBetween(W.unboundedPreceding, 0)
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    rows = entries.withColumn("statement_id", F.concat_ws("-", F.col("user_id").cast("string"), "account_masked", month))
    running = (F.lit(10000).cast("decimal(16,2)") + F.sum(signed).over(w)).cast("decimal(16,2)")
    printed = F.when(k % 3 != 1, running + F.when(k % 29 == 0, 5).otherwise(0))
    return rows.withColumn("balance_after", printed.cast("decimal(16,2)")).withColumn("seq", k).withColumn("is_credit", F.when(k % 101 != 0, F.col("direction") == "credit"))


def statements(rows: DataFrame) -> DataFrame:
    """A statement for each account and month; closing is 50 off where user plus month number is a multiple of seven."""
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    month = F.month("period_start")
    off = F.when((F.col("user_id") + month) % 7 == 0, 50).otherwise(0)
    return (
        rows.groupBy("statement_id", "user_id", "account_masked", "account_type", "bank_name")
        .agg(F.trunc(F.min("transaction_date"), "MM").alias("period_start"), F.last_day(F.max("transaction_date")).alias("period_end"), F.sum(signed).alias("_moved"), F.count("*").alias("row_count"), F.sum(F.when(F.col("direction") == "debit", F.col("amount"))).alias("_debits"))
        .select(
            "statement_id", "user_id", "account_masked", "account_type", "bank_name", "period_start", "period_end", "row_count", F.lit(10000).cast("decimal(16,2)").alias("opening_balance"),
            (F.col("_moved") + 10000 + off).cast("decimal(16,2)").alias("closing_balance"),
            F.when(F.col("account_type") == "credit_card", F.coalesce("_debits", F.lit(0))).cast("decimal(16,2)").alias("total_due"), F.date_add("period_end", 20).alias("due_date"),
        )
    )


def taxpayers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as taxpayers, with incomes from nothing to some tens of millions."""
    k, m = F.col("c_custkey"), lambda c: c.cast("decimal(16,2)")
    money = lambda n, d: m((k % n) * d)
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), m(F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(14,2)") * 300 + (k % 13) * 450000).alias("gross_salary"),
        money(7, 9000).alias("interest_income"), money(5, 4000).alias("dividend_income"), money(3, 60000).alias("rental_income_net"), money(11, 1500).alias("other_income"),
        money(4, 75000).alias("capital_gain_equity_stcg"), money(6, 90000).alias("capital_gain_equity_ltcg"), money(9, 25000).alias("deduction_80c"), money(4, 20000).alias("deduction_80ccd_1b"),
        money(3, 10000).alias("deduction_80ccd_2"), money(5, 12000).alias("deduction_80d_self"), money(4, 15000).alias("deduction_80d_parents"), money(2, 7000).alias("deduction_80e"),
        money(3, 2500).alias("deduction_80g"), money(8, 3000).alias("deduction_80tta_or_ttb"), money(6, 50000).alias("home_loan_interest_self"), money(5, 70000).alias("home_loan_interest_letout"),
        (k % 8 == 0).alias("is_senior"), (k % 16 == 0).alias("is_super_senior"),
    )
