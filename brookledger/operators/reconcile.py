"""Reconciliation of tax-portal figures with the ledger.

Each check meets two aggregates by user in a full outer join, so a figure that
only one side has is kept as missing on the other.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, text
from ..functions.money import total
from .insights import active

#: Tolerances in rupees. Fixed values.
FORM16, TDS, SELF_PAID, AIS = 100, 1, 1, 100
CROSS = (("total_income", 1000), ("salary_income", 500), ("interest_income", 100), ("tds_deducted", 100), ("advance_tax_paid", 0))
LINKS = (("interest", 500), ("dividend", 500), ("tax_paid", 2000))
CHALLAN_WORDS = ("CHALLAN", "ADVANCE TAX", "SELF ASSESSMENT", "INCOME TAX", "TDS")


def outcome(portal: Column, ledger: Column, tolerance, proportion: float | None = None) -> Column:
    """matched, amount_mismatch, missing_in_ledger or missing_in_portal; null where both sides lack it."""
    gap = F.abs(portal - ledger)
    close = gap <= F.lit(tolerance)
    if proportion is not None:
        close = close | (gap.cast("double") / F.greatest(portal, ledger).cast("double") <= proportion)
    return (
        F.when(portal.isNull() & ledger.isNull(), None).when(portal.isNull(), "missing_in_portal").when(ledger.isNull(), "missing_in_ledger")
        .when(close, "matched").otherwise("amount_mismatch")
    )


def compared(portal: DataFrame, ledger: DataFrame, keys: list[str], tolerance, proportion: float | None = None) -> DataFrame:
    """Both frames have the keys and ``amount``; one row a key with both amounts, their difference and the outcome."""
    a, b = portal.withColumnRenamed("amount", "portal_amount"), ledger.withColumnRenamed("amount", "ledger_amount")
    p, l = F.col("portal_amount"), F.col("ledger_amount")
    return a.join(b, keys, "full_outer").select(*keys, p, l, (p - l).alias("delta"), outcome(p, l, tolerance, proportion).alias("kind")).where("kind IS NOT NULL")


def ledger_buckets(ledger: DataFrame, first: date, last: date) -> DataFrame:
    """Salary, interest, dividend and self-paid tax of the ledger, a row for each that a user has."""
    rows = active(ledger).where(F.col("transaction_date").between(F.lit(first), F.lit(last)))
    up = F.col("merchant_raw")
    buckets = classify.codes(
        ((F.col("nature") == "income") & text.says(up, ("SALARY", "PAYROLL")), "salary"), (F.col("nature") == "interest_income", "interest"), (F.col("nature") == "dividend_income", "dividend"),
        ((F.col("direction") == "debit") & (F.col("nature") == "tax") & text.says(up, CHALLAN_WORDS), "tax_paid"),
    )
    # Exploded, not filtered: a filter on a derived column would be pushed down and evaluate the rules once more.
    return rows.select("user_id", "amount", F.explode(buckets).alias("bucket")).groupBy("user_id", "bucket").agg(F.sum("amount").alias("amount"))


def form16(portal: DataFrame, buckets: DataFrame) -> DataFrame:
    """Gross salary against salary credits."""
    return compared(portal.select("user_id", F.col("gross_salary").alias("amount")).where("amount IS NOT NULL"), buckets.where("bucket = 'salary'").drop("bucket"), ["user_id"], FORM16)


def tds(portal: DataFrame, documented: DataFrame) -> DataFrame:
    """Tax deducted according to the portal against form and certificates."""
    return compared(portal.select("user_id", F.col("tds_total").alias("amount")).where("amount IS NOT NULL"), documented, ["user_id"], TDS)


def self_paid(portal: DataFrame, buckets: DataFrame) -> DataFrame:
    return compared(portal.select("user_id", F.col("self_paid_tax").alias("amount")).where("amount IS NOT NULL"), buckets.where("bucket = 'tax_paid'").drop("bucket"), ["user_id"], SELF_PAID)


def ais_buckets(portal: DataFrame, buckets: DataFrame) -> DataFrame:
    """Salary, interest and dividend; securities are flagged and not compared."""
    names = ("salary", "interest", "dividend")
    lines = portal.select("user_id", F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(c).alias("amount")) for n, c in zip(names, ("gross_salary", "interest_income", "dividend_income"))))).alias("s")).select("user_id", "s.*").where("amount IS NOT NULL")
    checked = compared(lines, buckets.where(F.col("bucket").isin(*names)), ["user_id", "bucket"], AIS)
    none = F.lit(None).cast(checked.schema["ledger_amount"].dataType)
    flagged = portal.where("securities_sold > 0").select("user_id", F.lit("securities").alias("bucket"), F.col("securities_sold").alias("portal_amount"), none.alias("ledger_amount"), none.alias("delta"), F.lit("flagged").alias("kind"))
    return checked.unionByName(flagged)


def line_sums(lines: DataFrame, ledger: DataFrame, keys: list[str], tolerance=FORM16, proportion: float | None = 0.05) -> DataFrame:
    """Sums of portal lines against sums of the ledger."""
    return compared(lines.groupBy(*keys).agg(F.sum("amount").alias("amount")), ledger.groupBy(*keys).agg(F.sum("amount").alias("amount")), keys, tolerance, proportion)


def report(outcomes: DataFrame, source: str) -> DataFrame:
    """Counts of each outcome and both totals, by user."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return outcomes.groupBy("user_id").agg(F.lit(source).alias("source"), *map(n, ("matched", "missing_in_ledger", "missing_in_portal", "amount_mismatch")), total(F.col("portal_amount"), F.lit(True)).alias("portal_total"), total(F.col("ledger_amount"), F.lit(True)).alias("ledger_total"))


def _check(app: Column, portal: Column, tolerance) -> Column:
    gap = F.abs(app - portal)
    return F.when((app == 0) & (portal == 0), "unverified").when(gap <= F.lit(Decimal(tolerance)), "match").otherwise("mismatch")


def cross_verify(app: DataFrame, portal: DataFrame) -> DataFrame:
    """Five figures of the app (columns as in CROSS) against the portal's, a row each; a missing side counts as zero."""
    names = [n for n, _ in CROSS]
    zero = F.lit(0).cast("decimal(18,2)")
    a = app.select("user_id", *(F.col(c).alias(f"a_{c}") for c in names))
    b = portal.select("user_id", *(F.col(c).alias(f"p_{c}") for c in names))
    both = a.join(b, "user_id", "full_outer")
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(f"a_{n}", zero).cast("decimal(18,2)").alias("app_amount"), F.coalesce(f"p_{n}", zero).cast("decimal(18,2)").alias("portal_amount"), F.lit(t).alias("tolerance")) for n, t in CROSS))
    flat = both.select("user_id", F.explode(rows).alias("s")).select("user_id", "s.*")
    return flat.withColumn("status", F.coalesce(*(F.when(F.col("check") == n, _check(F.col("app_amount"), F.col("portal_amount"), t)) for n, t in CROSS)))


def linkage(ledger: Column, documented: Column, threshold) -> Column:
    return F.when((F.coalesce(ledger, F.lit(0)) == 0) & (F.coalesce(documented, F.lit(0)) == 0), "no_data").when(F.abs(F.coalesce(ledger, F.lit(0)) - F.coalesce(documented, F.lit(0))) <= threshold, "matched").otherwise("review_required")


def action_items(facts: DataFrame) -> DataFrame:
    """What a user should look at, a row each; one ``ok`` row where there is nothing.

    ``facts``: user_id, the sums of insights.tax_totals, counts of documents
    (tax_form, interest_certificate, dividend_report, tax_challan), large_cash,
    savings_accounts, documented_interest, documented_tax, unresolved_documents.
    """
    c = F.col
    checks = (
        (c("tax_form") == 0, "warning", "Missing Tax Forms"),
        ((c("interest_income") > 0) & (c("interest_certificate") == 0), "warning", "Interest Income Without Certificate"),
        ((c("dividend_income") > 0) & (c("dividend_report") == 0), "warning", "Dividend Income Without Report"),
        ((c("tax_payments") > 0) & (c("tax_challan") == 0), "warning", "Tax Payments Without Challan"),
        (c("other_income") >= 50000, "info", "Review Other Income"),
        (c("large_cash") > 0, "warning", "High-Value Cash Transactions"),
        (c("savings_accounts") == 0, "warning", "No Savings Statements Linked"),
        ((c("interest_income") > 0) & (F.abs(c("interest_income") - c("documented_interest")) >= 5000), "warning", "Interest Income Mismatch"),
        ((c("tax_payments") > 0) & (F.abs(c("tax_payments") - c("documented_tax")) >= 1000), "warning", "Tax Payment Documentation Gap"),
        (c("unresolved_documents") > 0, "info", "Unresolved Statement Parsers"),
    )
    item = lambda severity, title: F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"))
    found = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), item(s, t)) for cond, s, t in checks)), lambda x: x.isNotNull())
    ok = F.array(item("ok", "No Immediate Tax Flags"))
    return facts.select("user_id", F.explode(F.when(F.size(found) > 0, found).otherwise(ok)).alias("i")).select("user_id", "i.*")


def checklist_facts(people: DataFrame, ais: DataFrame, f26as: DataFrame, form16: DataFrame, summaries: DataFrame, coverage: DataFrame, ledger: DataFrame, fy: str, first: date, last: date) -> DataFrame:
    """The facts of ``checklist`` for each user_id of ``people``, counted from lines of the portal (ais: user_id, fy, category; f26as: user_id, fy, section),
    of salary forms (user_id, fy), summaries (user_id, fy, document_type), statement periods (user_id) and the ledger.

    Each table is aggregated by user before it meets the others; users without lines have zeros.
    """
    year = F.col("fy") == fy
    told = lambda kind: F.count_if(F.col("document_type") == kind)
    parts = (
        ais.where(year).groupBy("user_id").agg(F.count("*").alias("_ais"), F.count_if(F.col("category") == "salary").alias("_salary"), F.count_if(F.col("category") == "securities_sold").alias("_sold"), F.count_if(F.col("category") == "interest").alias("_interest")),
        f26as.where(year).groupBy("user_id").agg(F.count("*").alias("_26as"), F.count_distinct(F.when(F.col("section").isin(*rules.FORM16A_SECTIONS), F.col("section"))).alias("_sections")),
        form16.where(year).groupBy("user_id").agg(F.count("*").alias("_16")),
        summaries.where(year).groupBy("user_id").agg(told("ais").alias("_s_ais"), told("form_26as").alias("_s_26as"), told("form_16").alias("_s_16")),
        coverage.groupBy("user_id").agg(F.count("*").alias("coverage_rows")),
        ledger.where(~F.col("is_excluded") & F.col("transaction_date").between(F.lit(first), F.lit(last))).groupBy("user_id").agg(F.count("*").alias("ledger_rows")),
    )
    out = people.select("user_id").distinct()
    for p in parts:
        out = out.join(p, "user_id", "left")
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    return out.select(
        "user_id", (c("_ais") + c("_s_ais") > 0).alias("has_ais"), (c("_26as") + c("_s_26as") > 0).alias("has_26as"), (c("_16") + c("_s_16") > 0).alias("has_form16"), (c("_salary") > 0).alias("ais_salary"),
        (c("_sold") > 0).alias("ais_securities"), c("_interest").alias("ais_interest_lines"), c("_sections").alias("form16a_sections"), c("coverage_rows").alias("coverage_rows"), c("ledger_rows").alias("ledger_rows"),
    )


def checklist(facts: DataFrame) -> DataFrame:
    """What a user still lacks for a return: kind, severity and how much of the evidence speaks for it.

    ``facts``: user_id; has_ais, has_26as, has_form16 (booleans: lines or a summary of the year are there);
    ais_salary, ais_securities (booleans: the portal reports such lines), ais_interest_lines; form16a_sections
    (distinct sections of deductions that need a further form); coverage_rows, and ledger_rows of the year.
    """
    c = F.col
    none, block, warning = F.lit(None).cast("int"), F.lit("block_filing"), F.lit("warning")
    checks = (
        (~c("has_ais"), "MISSING_AIS", block, none), (~c("has_26as"), "MISSING_26AS", block, none),
        (~c("has_form16"), "MISSING_FORM_16", F.when(c("ais_salary"), block).otherwise(warning), none),
        (c("form16a_sections") > 0, "MISSING_FORM_16A", warning, c("form16a_sections")), (c("ais_securities"), "MISSING_CG_DOC", warning, none),
        (c("ais_interest_lines") > 0, "MISSING_INTEREST_CERT", F.lit("info"), c("ais_interest_lines")), (c("coverage_rows") == 0, "MISSING_BANK_STATEMENTS", warning, none),
        ((c("coverage_rows") > 0) & (c("ledger_rows") < rules.LEAST_LEDGER_ROWS), "LOW_LEDGER_COVERAGE", warning, none),
    )
    rows = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("kind"), s.alias("severity"), e.cast("int").alias("evidence"))) for cond, n, s, e in checks)), lambda x: x.isNotNull())
    return facts.select("user_id", F.explode(rows).alias("i")).select("user_id", "i.*")


def tds_lines(deducted: DataFrame, documented: DataFrame) -> DataFrame:
    """Tax deducted by the portal's lines (user_id, part, amount_tds; parts A and A1 count) against that of salary forms (user_id, head, amount)."""
    zero = F.lit(0).cast("decimal(18,2)")
    a = deducted.where(F.col("part").isin("A", "A1")).groupBy("user_id").agg(F.sum("amount_tds").alias("a"))
    b = documented.where("head = 'tds'").groupBy("user_id").agg(F.sum("amount").alias("b"))
    p, l = F.coalesce("a", zero), F.coalesce("b", zero)
    kind = F.when((F.abs(p - l) <= TDS) & (p > 0), "matched").when((p > 0) & (l == 0), "missing_in_ledger").when((l > 0) & (p == 0), "missing_in_portal").otherwise("amount_mismatch")
    return a.join(b, "user_id", "full_outer").where((p != 0) | (l != 0)).select("user_id", p.alias("portal_amount"), l.alias("ledger_amount"), (p - l).alias("delta"), kind.alias("kind"))


def form16_lines(lines: DataFrame, buckets: DataFrame) -> DataFrame:
    """Gross salary of the lines of a salary form (user_id, head, amount) against the ledger's salary, at most 100 or 5 % apart."""
    salary = lines.where("head = 'gross_salary'").groupBy("user_id").agg(F.sum("amount").alias("amount")).where("amount > 0")
    return compared(salary, buckets.where("bucket = 'salary'").drop("bucket"), ["user_id"], FORM16, 0.05).where("kind <> 'missing_in_portal'")


def ais_lines(lines: DataFrame, ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """Outcome of each portal line and ledger row by the chosen ``matches`` (line_id, txn_id): securities and other lines without one
    are missing in the ledger; rows without one are missing in the portal, but for interest below 100."""
    pairs = matches.select("line_id", "txn_id")
    money = "decimal(18,2)"
    a = lines.join(pairs, "line_id", "left").join(ledger.select("txn_id", F.col("amount").alias("_other")), "txn_id", "left")
    a = a.select("user_id", F.col("amount").cast(money).alias("portal_amount"), F.col("_other").cast(money).alias("ledger_amount"), F.when(F.col("txn_id").isNotNull(), "matched").otherwise("missing_in_ledger").alias("kind"))
    b = ledger.join(pairs, "txn_id", "left_anti").where("bucket <> 'interest' OR amount >= 100")
    return a.unionByName(b.select("user_id", F.lit(None).cast(money).alias("portal_amount"), F.col("amount").cast(money).alias("ledger_amount"), F.lit("missing_in_portal").alias("kind")))


def by_lines_or_sums(lines: DataFrame, lined: DataFrame, summed: DataFrame) -> DataFrame:
    """The outcomes from lines for users who have any, and those from sums for all others."""
    with_lines = lines.select("user_id").distinct()
    plain = ["user_id", "portal_amount", "ledger_amount", "kind"]
    return lined.join(with_lines, "user_id", "left_semi").select(plain).unionByName(summed.join(with_lines, "user_id", "left_anti").select(plain))


def all_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
