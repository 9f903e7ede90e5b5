"""Seeds: the tree of categories, merchants with their patterns, and the frames of a hand-off pack."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Categories of spending and what they hold. Fixed values, in order.
CATEGORIES = {
    "Food & Dining": ("Restaurants", "Food Delivery", "Groceries", "Cafe & Snacks"),
    "Shopping": ("Online Shopping", "Clothing & Fashion", "Electronics", "Home & Kitchen"),
    "Transport": ("Fuel", "Cab & Auto", "Parking & Toll", "Public Transport", "Flight & Train"),
    "Bills & Utilities": ("Electricity", "Mobile & Internet", "Water & Gas", "DTH & Cable", "Insurance Premium"),
    "Entertainment": ("Movies & Events", "OTT Subscriptions", "Gaming", "Books & Music"),
    "Health & Fitness": ("Medical & Pharmacy", "Gym & Sports", "Doctor & Hospital"),
    "Education": ("Tuition & Courses", "Books & Supplies", "Coaching & Classes"),
    "Financial": ("EMI Payment", "Credit Card Payment", "Investment", "Insurance", "Tax", "Bank Charges"),
    "Personal Care": ("Salon & Spa", "Cosmetics"),
    "Home": ("Rent", "Maintenance", "Household Supplies", "Furniture"),
    "Travel": ("Hotel & Stay", "Flights", "Trains", "Travel Activities"),
    "Gifts & Donations": ("Gifts", "Charity & Donation"),
    "Cash & ATM": ("ATM Withdrawal", "Cash Transfer"),
    "Government": ("Challan & Fine", "Stamp & Registration", "Passport & Visa"),
    "Miscellaneous": (),
    "Income": ("Salary", "Freelance", "Refund", "Cashback", "Interest", "Dividend"),
}
CATEGORY = "category_id string, parent_id string, name string, sort_order int, is_system boolean"
MERCHANT = "pattern_id int, kind string, pattern string, priority int, merchant string, category string"


def categories(spark: SparkSession, tree: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """The system's categories: a row for each and for each of its children, whose id names both."""
    rows = []
    for place, (name, children) in enumerate(tree.items()):
        rows.append((name, None, name, place, True))
        rows += [(f"{name} > {child}", name, child, k, True) for k, child in enumerate(children)]
    return spark.createDataFrame(rows, CATEGORY)


def merchants(spark: SparkSession, table: Sequence[tuple[str, str, Sequence[tuple[str, str, int]]]]) -> DataFrame:
    """Patterns for matching.merchants from (merchant, category, patterns of kind, text and priority); equal ones count once, for the first merchant."""
    rows, seen = [], set()
    for merchant, category, patterns in table:
        for kind, pattern, priority in patterns:
            if (kind, pattern.upper()) not in seen:
                seen.add((kind, pattern.upper()))
                rows.append((len(rows) + 1, kind, pattern, priority, merchant, category))
    return spark.createDataFrame(rows, MERCHANT)


def new_categories(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds to be added: all of them where the system has none yet, else none."""
    there = existing.where("is_system").limit(1).select(F.lit(1).alias("_there"))
    return seeds.join(F.broadcast(there), how="left").where("_there IS NULL").drop("_there")  # one row at most


def pack_frames(ledger: DataFrame, regimes: DataFrame, deductions: DataFrame, outcomes: Mapping[str, DataFrame], documents: DataFrame, assumptions: Sequence[str]) -> dict[str, DataFrame]:
    """The seven frames of a hand-off pack, for files.write_pack.

    ledger: a year's entries; regimes: tax.compare; deductions: tax.utilisation; outcomes: those of each report by its source
    (user_id, kind, portal_amount, ledger_amount); documents: user_id, file_name, doc_type, status.
    """
    spark, none = ledger.sparkSession, F.lit(None).cast("string")
    have = lambda c: F.col(c) if c in ledger.columns else none
    entries = ledger.where("NOT is_excluded").select("user_id", F.col("txn_id").alias("id"), "transaction_date", "amount", "direction", F.col("nature").alias("transaction_nature"), "merchant_raw", F.col("category_name").alias("category_id"), "bank_name", "account_masked", *(have(c).alias(c) for c in ("extraction_source", "validation_status", "source_statement_id")))
    lines = reduce(DataFrame.unionByName, (df.select("user_id", F.lit(source).alias("source"), "kind", "portal_amount", "ledger_amount", (F.col("portal_amount") - F.col("ledger_amount")).alias("delta")) for source, df in outcomes.items()))
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0))
    sums = entries.groupBy("user_id").agg(F.count("*").alias("entries"), side("credit").alias("credits"), side("debit").alias("debits"))
    matched = lines.groupBy("user_id").agg(F.count_if(F.col("kind") == "matched").alias("matched"), F.count_if(F.col("kind") != "matched").alias("open"))
    summary = sums.join(matched, "user_id", "left").join(documents.groupBy("user_id").agg(F.count("*").alias("documents")), "user_id", "left").fillna(0, ["matched", "open", "documents"])
    return {
        "summary": summary, "ledger_FY": entries, "regime_comparison": regimes, "deduction_breakup": deductions, "reconciliation_FY": lines,
        "documents": documents, "assumptions": spark.createDataFrame(list(enumerate(assumptions, 1)), "place int, assumption string"),
    }
