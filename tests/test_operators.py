"""Ledger operators on small frames: edge cases, and brute force where order matters."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from brookledger import rules
from brookledger.functions import classify, dates, money, text
from brookledger.operators import balance, dedup, documents, insights, jobs, matching, reconcile, tax
from brookledger.operators import ledger as entries
from brookledger.plans import queries
from brookledger.plans.ledger import ledger, transfer_feed
from brookledger.plans.oracle import ORACLE_SQL

D = Decimal
LEDGER = "txn_id long, user_id long, transaction_date date, amount decimal(14,2), direction string, nature string, category_name string, merchant_raw string, merchant_normalized string, bank_name string, account_type string, account_masked string, notes string, is_excluded boolean"


def entry(i, day, amount, direction="debit", nature="expense", user=1, category="Food", raw="UPI SHOP", name="Shop", bank="HDFC", kind="savings", account="XX1", notes=None, excluded=False):
    return (i, user, day, D(str(amount)), direction, nature, category, raw, name, bank, kind, account, notes, excluded)


def frame(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("Rs. 1,23,456.78", 123456.78), ("(500)", -500.0), ("C 12.50", 12.5), ("", None), (None, None), ("INR 7 Cr", 7.0), ("none", None)])
def test_parse_inr(spark, raw, want):
    assert one(spark, money.parse_inr(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want, two", [("1,234.565", D("1234.57"), False), ("-5", D("5.00"), True), ("₹10.1", D("10.10"), True), ("x", None, False), (None, None, False)])
def test_parse_decimal(spark, raw, want, two):
    assert one(spark, money.parse_decimal(F.col("t")), t=raw) == want
    assert one(spark, money.at_most_two_decimals(F.col("t")), t=raw) == two


@pytest.mark.parametrize("raw, want", [("CR.", True), ("500.00 cr", True), ("D", False), ("Withdrawal", False), ("", None), (None, None), ("X", None)])
def test_credit_flag(spark, raw, want):
    assert one(spark, money.credit_flag(F.col("t")), t=raw) is want


@pytest.mark.parametrize("raw, want", [("05/04/2024", date(2024, 4, 5)), ("5-4-24", date(2024, 4, 5)), ("05 APR 2024", date(2024, 4, 5)), ("5-apr-24", date(2024, 4, 5)), ("31/02/2024", None), ("01/01/1999", None), ("01/01/2099", None), ("soon", None), (None, None)])
def test_parse_date(spark, raw, want):
    assert one(spark, dates.parse_date(F.col("t"), date(2024, 6, 1)), t=raw) == want


def test_financial_years(spark):
    for t in ("FY24-25", "24-25", "2024-25", "2024-2025"):
        assert dates.fy_bounds(t) == (date(2024, 4, 1), date(2025, 3, 31))
    with pytest.raises(ValueError):
        dates.fy_bounds("next year")
    got = spark.createDataFrame([(date(2024, 3, 31),), (date(2024, 4, 1),)], "d date").select(dates.fy_label(F.col("d")).alias("x")).collect()
    assert [r["x"] for r in got] == ["2023-24", "2024-25"]


def test_next_month_is_clamped(spark):
    r = spark.createDataFrame([(date(2024, 1, 31),)], "d date").select(dates.plus_months(F.col("d"), 1, F.lit(31)).alias("a"), dates.plus_months(F.col("d"), 12, F.lit(30)).alias("b")).first()
    assert (r["a"], r["b"]) == (date(2024, 2, 29), date(2025, 1, 30))


@pytest.mark.parametrize("raw, direction, kind, want", [
    ("HDFC CARD PAYMENT", "debit", "savings", "transfer_internal"), ("tele transfer  credit", "credit", "credit_card", "transfer_internal"), ("SIP ZERODHA", "debit", "savings", "investment"),
    ("ADVANCE TAX", "debit", "savings", "tax"), ("IMPS SELF", "debit", "savings", "transfer_internal"), ("Coffee", "debit", "savings", "expense"), ("REFUND", "credit", "savings", "refund"),
    ("FD INT", "credit", "savings", "interest_income"), ("DIVIDEND", "credit", "savings", "dividend_income"), ("SALARY", "credit", "savings", "income"), ("anything", "credit", "credit_card", "refund"),
    (None, "credit", None, "income"), ("CARD PAYMENT at shop", "debit", "savings", "expense"),
])
def test_nature(spark, raw, direction, kind, want):
    assert one(spark, classify.nature(F.col("t"), F.col("d"), F.col("k")), t=raw, d=direction, k=kind) == want


def test_text(spark):
    assert one(spark, text.plain_words(F.col("t")), t="a-b  c!") == "A B C"
    assert one(spark, text.mask_tail(F.col("t")), t="123456") == "XX3456"
    assert one(spark, text.append_note(F.col("t"), "m"), t=None) == "m" and one(spark, text.append_note(F.col("t"), "m"), t="a m") == "a m" and one(spark, text.append_note(F.col("t"), "m"), t="a") == "a\nm"
    assert one(spark, text.label(F.col("b"), F.col("k")), b="KOTAK", k="savings") == "Kotak Saving" and one(spark, text.label(F.col("b"), F.col("k")), b=None, k=None) is None
    assert one(spark, classify.bank_hint(F.col("t")), t="State Bank of India statement") == "SBI" and one(spark, classify.bank_hint(F.col("t")), t="nothing") is None
    assert one(spark, classify.category(F.col("t")), t="swiggy") == "Food Delivery"
    assert one(spark, classify.recurring_bucket(F.col("t"), F.lit(None)), t="Netflix") == "subscription"


def test_sms(spark):
    body = "Rs.500 debited from a/c XX1234 on UPI Ref No 123456789012 to shop@okbank. Avl bal Rs.900.50"
    m = spark.createDataFrame([("AD-HDFCBK", body, 1), ("+919876543210", "Your KYC expired, click http://bit.ly/x", 2), ("AD-HDFCBK", "123456 is your OTP", 3), (None, None, 4)], "a string, b string, t long")
    got = [r["x"] for r in m.orderBy("t").select(classify.sms_class(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[:3] == ["transaction_debit", "spam", "otp"]
    r = m.where("t = 1").withColumns(classify.sms_parsed(F.col("a"), F.col("b"), F.col("t"))).first()
    assert (r["amount"], r["balance_after"], r["account_masked"], r["reference_number"], r["upi_id"], r["confidence"]) == (D("500.00"), D("900.50"), "XX1234", "123456789012", "shop@okbank", 1.0)


def test_validation(spark):
    raw = [("05/04/2024", "100.00", None, "DR", "Coffee", 0.9), ("05/04/2024", "1.005", None, "DR", "x", 0.9), ("01/01/2025", "5", None, "CR", "x", 0.9), ("05/04/2024", "5", "(3)", "?", "x", 0.9), ("05/04/2024", "5", None, "CR", "x", 0.5), (None, None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r, date(2024, 4, 1), date(2024, 4, 30)) for i, r in enumerate(raw)], "i int, date_raw string, amount_raw string, balance_raw string, txn_type_raw string, description_raw string, confidence double, period_start date, period_end date")
    got = {r["i"]: (r["validation_status"], r["validation_errors"]) for r in entries.validate(df, date(2024, 6, 1)).collect()}
    assert got[0] == ("valid", []) and got[1] == ("invalid", ["amount_max_2_decimal"]) and got[2][0] == "invalid" and "date_not_future" in got[2][1]
    assert got[3] == ("needs_review", ["balance_negative", "cr_dr_resolved"]) and got[4][0] == "low_confidence" and got[5][0] == "invalid"


def test_monthly_summary(spark):
    df = frame(spark, [entry(1, date(2024, 1, 5), 10), entry(2, date(2024, 1, 6), 30, "credit", "income"), entry(3, date(2024, 1, 7), 99, excluded=True), entry(4, date(2024, 3, 1), 5, category=None), entry(5, date(2024, 1, 7), 7, "credit", "refund")])
    s = insights.monthly_summary(df)
    got = {r["year_month"]: r for r in s.collect()}
    assert (got["2024-01"]["income"], got["2024-01"]["expense"], got["2024-01"]["txn_count"]) == (30, 10, 3)
    assert [r["change_percent"] for r in insights.month_change(s).orderBy("year_month").collect()] == [None, None]
    t = insights.spending_trend(s, date(2024, 3, 9), 3).orderBy("year_month").collect()
    assert [(r["year_month"], r["expense"]) for r in t] == [("2024-01", 10), ("2024-02", 0), ("2024-03", 5)]
    assert insights.monthly_categories(df).where("category_name = 'Uncategorized'").count() == 1
    assert insights.monthly_summary(df.limit(0)).count() == 0


def test_recurring(spark):
    days = [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]
    df = frame(spark, [entry(i, d, 100 + i, name="Gym") for i, d in enumerate(days)] + [entry(9, days[0], 5, name="Once")])
    r = insights.recurring(df).collect()
    assert [(x["merchant"], x["frequency"], x["expected_day"], x["next_expected"]) for x in r] == [("Gym", "monthly", 30, date(2024, 4, 30))]
    assert insights.subscriptions(insights.recurring(df), date(2024, 5, 2)).first()["status"] == "overdue"


def test_anomalies_against_brute_force(spark):
    from statistics import mean, pstdev

    rng, as_of = random.Random(4), date(2024, 6, 30)
    rows = [entry(i, as_of - timedelta(days=rng.randrange(100)), rng.choice([10, 12, 13, 500, 6000, 6100, 60000]), user=rng.randrange(3), category=rng.choice(["a", "b", None]), name=rng.choice(["M1", "m1", "M2", None, f"N{i}"])) for i in range(300)]
    want = {}
    since, start = as_of - timedelta(days=90), as_of - timedelta(days=30)
    hist = [r for r in rows if r[2] >= since]
    for r in hist:
        if r[2] < start:
            continue
        v = [float(x[3]) for x in hist if x[1] == r[1] and x[6] == r[6] and x[3] != r[3]]
        if len(v) >= 5 and pstdev(v) > 0 and float(r[3]) > mean(v) + 2 * pstdev(v):
            want[r[0]] = "category_spike"
        elif r[3] >= 5000 and r[8] and not any(x[1] == r[1] and (x[8] or "").upper() == r[8].upper() and x[2] < start for x in hist):
            want[r[0]] = "new_large_merchant"
    got = {x["txn_id"]: x["reason"] for x in insights.anomalies(frame(spark, rows), as_of).collect()}
    assert got == want and len(set(want.values())) == 2


def serial(debits, credits, ok, cost):
    used, out = set(), {}
    for d in debits:
        best = min((c for c in credits if c[0] not in used and ok(d, c)), key=lambda c: cost(d, c), default=None)
        if best:
            used.add(best[0])
            out[d[0]] = best[0]
    return out


def test_transfer_pairs_against_the_serial_loop(spark):
    rng = random.Random(8)
    rows = [entry(i, date(2024, 1, 1) + timedelta(days=rng.randrange(12)), D(rng.choice([100, 100, 200])) + D(rng.randrange(4)) / 5, rng.choice(["debit", "credit"]), "transfer_internal", user=rng.randrange(2), bank=rng.choice(["HDFC", "SBI", None, ""]), kind=rng.choice(["savings", "credit_card"]), account=rng.choice(["XX1", "XX2", None])) for i in range(160)]
    same = lambda a, b, k: bool(a[k]) and a[k] == b[k]
    order = lambda r: (r[2], r[0])
    want = serial(
        sorted((r for r in rows if r[4] == "debit"), key=order), sorted((r for r in rows if r[4] == "credit"), key=order),
        lambda d, c: d[1] == c[1] and abs(d[3] - c[3]) <= D("0.50") and abs((d[2] - c[2]).days) <= 5,
        lambda d, c: (abs((d[2] - c[2]).days) + 1.5 * same(d, c, 9) + 2.0 * same(d, c, 11) + 1.0 * same(d, c, 10), *order(c)),
    )
    got = {r["debit_id"]: r["credit_id"] for r in matching.transfer_pairs(frame(spark, rows)).collect()}
    assert got == want and len(want) > 20
    assert matching.transfer_pairs(frame(spark, rows).limit(0)).count() == 0


def test_upi_reversals_against_the_serial_loop(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        back = rng.random() < 0.5
        rows.append(entry(i, date(2024, 1, 1) + timedelta(days=rng.randrange(10)), rng.choice([5, 6]), "credit" if back else "debit", raw="UPI REVERSAL x" if back else "UPI x"))
    want = serial(
        sorted((r for r in rows if r[4] == "debit"), key=lambda r: (-r[2].toordinal(), r[0])), [r for r in rows if r[4] == "credit"],
        lambda d, c: d[3] == c[3] and abs((d[2] - c[2]).days) <= 3, lambda d, c: (abs((d[2] - c[2]).days), -c[2].toordinal(), c[0]),
    )
    assert {r["debit_id"]: r["credit_id"] for r in matching.upi_reversals(frame(spark, rows)).collect()} == want


def test_sms_match_takes_the_earlier_date(spark):
    sms = frame(spark, [entry(1, date(2024, 1, 10), 100, account=None)])
    led = frame(spark, [entry(11, date(2024, 1, 12), 100, account=None), entry(12, date(2024, 1, 8), "100.90", account=None), entry(13, date(2024, 1, 10), 100, account="XX9"), entry(14, date(2024, 1, 10), "101.01", account=None)])
    assert [r["txn_id"] for r in matching.sms_statement_match(sms, led).collect()] == [12]


def test_duplicate_tiers(spark):
    cols = "txn_id long, user_id long, transaction_date date, amount decimal(14,2), direction string, account_masked string, fingerprint string, reference_number string, merchant_raw string"
    d = date(2024, 1, 10)
    new = spark.createDataFrame([(1, 1, d, D(5), "debit", "A", "f1", None, "SWIGGY ORDER 12"), (2, 1, d, D(6), "debit", "A", "f2", "R1", "x"), (3, 1, d, D(7), "debit", "A", "f3", None, "SWIGGY ORDER 12"), (4, 1, d, D(8), "debit", "A", "f4", None, "aaaa"), (5, 1, d, D(9), "debit", "A", "f5", None, "x")], cols)
    old = spark.createDataFrame([(11, 1, d, D(1), "debit", "A", "f1", None, "y"), (12, 1, d, D(1), "debit", None, "g", "R1", "y"), (13, 1, d + timedelta(days=1), D(7), "debit", "A", "g", None, "SWIGGY ORDER 13"), (14, 1, d + timedelta(days=3), D(8), "debit", "A", "g", None, "zzzz")], cols)
    got = {r["txn_id"]: (r["match_id"], r["method"]) for r in matching.duplicates(new, old).collect()}
    assert got == {1: (11, "fingerprint_exact"), 2: (12, "exact_ref"), 3: (13, "amount_date_desc"), 4: (14, "fuzzy")}


def test_dedup(spark):
    df = frame(spark, [entry(1, date(2024, 1, 1), "10.00", raw=" Coffee-Bar "), entry(2, date(2024, 1, 1), 10, "credit", raw="coffee bar"), entry(3, date(2024, 1, 1), "10.01", raw="coffee bar")])
    f = {r["txn_id"]: (r["a"], r["b"]) for r in df.select("txn_id", dedup.fingerprint().alias("a"), dedup.dedup_key().alias("b")).collect()}
    assert f[1][0] == f[2][0] != f[3][0] and f[2][1] != f[1][1]
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, None), (4, "b", 1)], "txn_id long, k string, j int")
    old = spark.createDataFrame([("b", 1), (None, 7)], "k string, j int")
    new = dedup.new_rows(rows, old, ["k", "j"], ["txn_id"])
    assert sorted(r["txn_id"] for r in new.collect()) == [1, 3]
    assert dedup.insert_counts(rows, new).first().asDict() == {"rows": 4, "inserted": 2, "duplicates": 2}


def test_balance_walk(spark):
    s = spark.createDataFrame([("a", D(100), D(130)), ("b", D(0), D(99)), ("none", D(5), D(5))], "statement_id string, opening_balance decimal(16,2), closing_balance decimal(16,2)")
    d = date(2024, 1, 1)
    rows = spark.createDataFrame([
        ("a", 1, d, D(50), True, D("150.90")), ("a", 2, d, D(20), False, None), ("b", 1, d, D(10), True, D(60)), ("b", 2, d, D(40), True, D(100)), ("b", 3, d, D(3), None, None),
    ], "statement_id string, seq long, transaction_date date, amount decimal(14,2), is_credit boolean, balance_after decimal(16,2)")
    got = {r["statement_id"]: (r["computed_closing"], r["flagged_rows"], r["passed"]) for r in balance.balance_walk(rows, s).collect()}
    assert got == {"a": (D(130), 0, True), "b": (D(100), 2, True), "none": (D(5), 0, True)}


def test_net_worth(spark):
    snaps = spark.createDataFrame([("s1", 1, "p", date(2024, 1, 31), D(100), "asset"), ("s2", 1, "q", date(2024, 2, 29), D(30), "liability"), ("s3", 1, "p", date(2024, 3, 31), D(80), "asset")], "statement_id string, user_id long, position_key string, as_of_date date, balance decimal(16,2), entry_kind string")
    got = [(r["as_of_date"].month, r["assets"], r["liabilities"]) for r in balance.net_worth_history(snaps).orderBy("as_of_date").collect()]
    assert got == [(1, 100, 0), (2, 100, 30), (3, 80, 30)]


def brute_tax(income, slabs):
    total, lower = D(0), 0
    for upper, percent in slabs:
        top = income if upper is None else min(income, D(upper))
        total += (max(top - lower, D(0)) * percent / 100).quantize(D("0.01"), "ROUND_HALF_UP")
        lower = upper
    return total


def test_slab_tax_and_rebate(spark):
    incomes = [D(x) for x in (0, 250000, 699999, 700000, 700001, 1500000, "1234567.89", 99999999)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(incomes)], "user_id int, gross_salary decimal(18,2)")
    for fy in rules.NEW_SLABS:
        got = {r["user_id"]: r for r in tax.compare(df, fy).collect()}
        for i, x in enumerate(incomes):
            taxable = max(D(0), x - rules.STANDARD_DEDUCTION[fy][1])
            assert got[i]["new_slab_tax"] == brute_tax(taxable, rules.NEW_SLABS[fy])
            top, cap = rules.NEW_REBATE[fy]
            assert got[i]["new_rebate"] == (min(got[i]["new_slab_tax"], D(cap)) if taxable <= top else 0)
    with pytest.raises(ValueError):
        tax.compare(df, "1999-00")


def test_surcharge_has_marginal_relief(spark):
    df = spark.createDataFrame([(1, D(5050000)), (2, D(5000000)), (3, D(6000000))], "user_id int, gross_salary decimal(18,2)")
    got = {r["user_id"]: r for r in tax.compare(df, "2024-25").collect()}
    assert got[2]["old_surcharge"] == 0 and got[3]["old_surcharge"] == got[3]["old_full_surcharge"]
    at = brute_tax(D(5000000), rules.OLD_SLABS["below_60"])
    assert got[1]["old_tax"] + got[1]["old_surcharge"] == at + D(50000)


def test_capital_gains_split(spark):
    lines = spark.createDataFrame([(1, date(2024, 7, 22), "ltcg", D(200000)), (1, date(2024, 7, 23), "ltcg", D(200000)), (1, date(2024, 7, 23), "stcg", D(1000)), (2, date(2024, 7, 1), "stcg", D(-5)), (2, None, "x", None)], "user_id int, realised_on date, kind string, amount decimal(14,2)")
    got = {r["user_id"]: r for r in tax.capital_gains(lines, "2024-25").collect()}
    assert got[1]["ltcg_tax"] == D("10000.00") + D("9375.00") and got[1]["stcg_tax"] == 200 and got[1]["exemption_used"] == 225000 and got[2]["total_tax"] == 0


def test_itr_forms(spark):
    p = spark.createDataFrame([(1, D(100), False, False, True), (2, D(6000000), False, False, True), (3, D(100), True, True, True), (4, D(100), True, False, True), (5, D(100), False, False, False)], "user_id int, total_income decimal(18,2), has_business_income boolean, is_presumptive boolean, is_resident boolean")
    assert {r["user_id"]: r["form"] for r in tax.itr_form(p).collect()} == {1: "ITR-1", 2: "ITR-2", 3: "ITR-4", 4: "ITR-3", 5: "ITR-2"}


def test_outcomes(spark):
    a = spark.createDataFrame([(1, D(1000)), (2, D(1000)), (3, D(5))], "user_id int, amount decimal(24,2)")
    b = spark.createDataFrame([(1, D(1100)), (2, D(1101)), (4, D(5))], "user_id int, amount decimal(24,2)")
    out = reconcile.compared(a, b, ["user_id"], 100)
    assert {r["user_id"]: r["kind"] for r in out.collect()} == {1: "matched", 2: "amount_mismatch", 3: "missing_in_ledger", 4: "missing_in_portal"}
    assert reconcile.report(out, "x").where("user_id = 1").first()["matched"] == 1


def test_portal_matches_against_the_serial_loop(spark):
    rng = random.Random(10)
    lines = [(i, 1, "2024-25", "salary", D(rng.randrange(1000, 4000))) for i in range(40)]
    led = [(100 + i, 1, "2024-25", "salary", D(rng.randrange(1000, 4000))) for i in range(40)]
    close = lambda d, c: abs(d[4] - c[4]) <= 100 or abs(d[4] - c[4]) / max(d[4], c[4]) <= D("0.05")
    want = serial(lines, led, close, lambda d, c: (abs(d[4] - c[4]), c[0]))
    schema = "user_id int, fy string, bucket string, amount decimal(14,2)"
    got = matching.portal_matches(spark.createDataFrame(lines, f"line_id long, {schema}"), spark.createDataFrame(led, f"txn_id long, {schema}"))
    assert {r["line_id"]: r["txn_id"] for r in got.collect()} == want


def test_portal_matches_of_dense_groups_make_no_pairs(spark, monkeypatch):
    """Amounts that are alike, negative or without a bucket, in groups where nearly all pairs are close."""
    monkeypatch.setattr(matching, "one_to_one", lambda edges: pytest.fail("pairs are made"))
    rng = random.Random(11)
    some = lambda: (rng.choice([1, 2, None]), "2024-25", rng.choice(["salary", "interest", "securities_sold"]), D(rng.choice([rng.randrange(-300, 300), rng.randrange(2000, 2300)])))
    lines, led = [(i, *some()) for i in range(400)], [(5 + 3 * i, *some()) for i in range(400)]
    close = lambda d, c: d[1] is not None and d[3] != "securities_sold" and d[1:4] == c[1:4] and d[4] and c[4] and (abs(d[4] - c[4]) <= 100 or float(abs(d[4] - c[4])) / float(max(d[4], c[4])) <= 0.05)
    want = serial(lines, led, close, lambda d, c: (abs(d[4] - c[4]), c[0]))
    schema = "user_id int, fy string, bucket string, amount decimal(14,2)"
    got = matching.portal_matches(spark.createDataFrame(lines, f"line_id long, {schema}"), spark.createDataFrame(led, f"txn_id long, {schema}")).collect()
    assert {r["line_id"]: r["txn_id"] for r in got} == want and len(got) == len(want)
    amounts = {i: a for i, *_, a in lines}, {i: a for i, *_, a in led}
    assert all((r["portal_amount"], r["ledger_amount"]) == (amounts[0][r["line_id"]], amounts[1][r["txn_id"]]) for r in got)


def test_splits_and_updates(spark):
    df = frame(spark, [entry(1, date(2024, 1, 1), 10), entry(2, date(2024, 1, 1), 10), entry(3, date(2024, 1, 1), 10, excluded=True)])
    parts = spark.createDataFrame([(1, 1, D(4)), (1, 2, D(6)), (2, 1, D(4)), (2, 2, D(5)), (3, 1, D(4)), (3, 2, D(6))], "txn_id long, split_index int, amount decimal(14,2)")
    after, verdict = entries.split(df, parts)
    assert {r["txn_id"]: r["accepted"] for r in verdict.collect()} == {1: True, 2: False, 3: False}
    assert after.count() == 5 and after.where("NOT is_excluded").agg(F.sum("amount")).first()[0] == 20
    new, log = entries.updated(df, df.where("txn_id = 1"), {"category_name": "Food", "notes": "n"})
    assert [(r["field"], r["old_value"], r["new_value"]) for r in log.collect()] == [("notes", None, "n")] and new.columns == df.columns


def test_documents(spark):
    d = spark.createDataFrame([(1, "a" * 10), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk_no"], r["chunk"]) for r in documents.fixed_chunks(d, 6, 2).orderBy("chunk_no").collect()]
    assert got == [(1, 0, "a" * 6), (1, 1, "a" * 6)]
    told = "Dear Ravi Kumar, your account 1234567890123 PAN ABCDE1234F ref 123456789012 mail a@b.com call 9876543210\nYour OTP is 1234"
    masked = documents.masked(spark.createDataFrame([(told,)], "text string")).first()["text"]
    assert "XXXX_PAN" in masked and "XXXX@XXXX.XXX" in masked and "[OTP_LINE_REMOVED]" in masked and "Dear XXXX_NAME" in masked and "123456789012" in masked
    lines = spark.createDataFrame([("d", 1, "head"), ("d", 2, "01/01 coffee"), ("d", 3, "bar"), ("d", 4, "02/01 tea")], "doc_id string, line_no int, text string")
    assert sorted(r["text"] for r in balance.joined_lines(lines).collect()) == ["01/01 coffee bar", "02/01 tea"]
    kinds = documents.classified(spark.createDataFrame([(1, "Form 16 certificate"), (2, "card statement total amount due minimum amount due credit limit"), (3, "hello"), (4, None)], "doc_id long, text string"))
    assert [r["doc_type"] for r in kinds.orderBy("doc_id").collect()] == ["tax_form", "credit_card_statement", "unknown", "unknown"]


def test_jobs(spark):
    j = spark.createDataFrame([(1, 1, "queued", 0, 5), (2, 1, "queued", 1, 6), (3, 2, "queued", 0, 1), (4, 2, "running", 0, 0)], "job_id long, user_id long, status string, priority int, created_at long")
    assert [(r["user_id"], r["job_id"]) for r in jobs.claim_order(j).orderBy("place").collect()] == [(1, 2), (2, 3)]
    r = {x["attempts"]: (x["next_status"], x["wait_seconds"]) for x in jobs.retried(spark.createDataFrame([(0,), (2,), (3,)], "attempts int")).collect()}
    assert r == {0: ("queued", 2), 2: ("queued", 4), 3: ("dlq", None)}


def test_card_integrity(spark):
    c = F.col
    df = spark.createDataFrame([(1, 1000.0, 200.0, 850.0, None, None, 3), (2, 1000.0, 0.0, 9000.0, None, None, 3), (3, 1000.0, 0.0, 3050.0, 2000.0, 3000.0, 3), (4, 0.0, 0.0, None, None, None, 0)], "i int, d double, k double, due double, prev double, close double, n int")
    got = {r["i"]: r["status"] for r in df.withColumns(classify.card_integrity(c("d"), c("k"), c("due"), c("prev"), c("close"), c("n"))).collect()}
    assert got == {1: "ok", 2: "review", 3: "ok", 4: "review"}


@pytest.mark.parametrize("newest", [300, 7])
def test_knowledge_rank_against_brute_force(spark, newest):
    rng, vocabulary = random.Random(9), [a + b + "q" for a in ("alpha", "beta", "gamma", "delta", "omega") for b in "abcdefghijk"]
    stop = sorted(rules.STATEMENT_STOPWORDS)[:3]
    rows = [(i, ("zz 12345 " * 250 if i % 3 == 0 else "") + " ".join(rng.sample(vocabulary, 12) + stop), f"s{rng.randrange(3)}", rng.choice(["HDFC", "SBI", "", None]), rng.choice(["card", "bank", None]), rng.choice(["bank_statement", "ppf", None])) for i in range(90)]
    rows += [(90 + i, rows[20 * i][1], rows[20 * i][2], "AXIS", "bank", "credit_card_statement") for i in range(5)] + [(95, None, "s1", "SBI", "x", None), (96, "", "s1", "SBI", "x", None), (97, rows[1][1], None, "SBI", "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, owner string, bank_hint string, account_type_hint string, doc_type string")
    told = {r[0]: {w for w in re.findall("[a-z0-9]{3,}", re.sub(r"[\s_/\\-]+", " ", (r[1] or "").lower())) if w not in rules.STATEMENT_STOPWORDS and not w.isdigit()} for r in rows}
    want = set()
    for i, t, owner, bank, kind, _ in (r for r in rows if r[0] % 5 == 0):
        others = sorted((r for r in rows if r[2] == owner is not None and r[0] != i), key=lambda r: -r[0])[:newest]
        texts, scores = set(), []
        for j, t2, _, bank2, kind2, doc2 in others:
            n = len(told[i] & told[j]) + 8 * bool(bank and bank == bank2) + 5 * bool(kind and kind == kind2) + 2 * (doc2 in ("bank_statement", "credit_card_statement"))
            if n and (t2 or "") not in texts:
                scores.append((-n, -j))
                texts.add(t2 or "")
        want |= {(i, -j, -score, k + 1) for k, (score, j) in enumerate(sorted(scores)[:4])}
    got = documents.knowledge_rank(frame.where("doc_id % 5 = 0"), frame, newest=newest).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_transfer_report_against_the_serial_loop(spark):
    sf = "/root/testdata/sf0.001"
    columns = ("txn_id", "user_id", "transaction_date", "amount", "direction", "bank_name", "account_masked", "account_type")
    users = {}
    for r in transfer_feed(ledger(spark, sf)).where("NOT is_excluded").select(*columns).collect():
        users.setdefault(r["user_id"], []).append(r)
    same = lambda a, b, k: bool(a[k]) and a[k] == b[k]
    order = lambda r: (r["transaction_date"], r["txn_id"])
    want = {}
    for user, rows in users.items():
        pairs = serial(
            sorted((r for r in rows if r["direction"] == "debit"), key=order), [r for r in rows if r["direction"] == "credit"],
            lambda d, c: abs(d["amount"] - c["amount"]) <= D("0.50") and abs((d["transaction_date"] - c["transaction_date"]).days) <= 7,
            lambda d, c: (abs((d["transaction_date"] - c["transaction_date"]).days) + 1.5 * same(d, c, "bank_name") + 2.0 * same(d, c, "account_masked") + 1.0 * same(d, c, "account_type"), *order(c)),
        )
        want[user] = (len(rows), len(pairs), len(rows) - 2 * len(pairs))
    got = queries.QUERIES["j16_transfer_report"](spark, sf).collect()
    assert {r["user_id"]: (r["transfers"], r["matched_pairs"], r["unmatched"]) for r in got} == want
    assert all(r["match_rate"] == pytest.approx(2 * r["matched_pairs"] / r["transfers"], abs=1e-4) for r in got)
    assert sum(n for _, n, _ in want.values()) > 100


def test_candidates_grow_with_the_rows(spark):
    """Rows that all look alike, each of them an entry too, have a few candidates each, and the smallest id but their own is the best."""
    schema = "txn_id long, user_id int, transaction_date date, amount decimal(14,2), direction string, account_masked string, fingerprint string, reference_number string, merchant_raw string"
    accounts = ("XX1", "XX2", None)
    rows = [(i, 1, date(2024, 1, 1 + i % 3), D(5), "debit", accounts[i % 3], "same" if i % 5 == 0 else None, "REF" if i % 2 else None, "Shop one") for i in range(10, 310)]
    df = spark.createDataFrame(rows, schema)
    assert matching.candidates(df, df).count() < 25 * len(rows)

    def best(r):
        out = []
        for e in rows:
            if e[0] != r[0]:
                if r[6] and r[6] == e[6]:
                    out.append((0, 0, e[0]))
                if r[7] and e[7] and (r[5] is None or e[5] is None or r[5] == e[5]):
                    out.append((1, 0, e[0]))
                if abs((r[2] - e[2]).days) <= 1:
                    out.append((2, 0, e[0]))
        return min(out)[2]

    assert {r["txn_id"]: r["match_id"] for r in matching.duplicates(df, df).collect()} == {r[0]: best(r) for r in rows}


@pytest.mark.parametrize("same", [True, False])
def test_knowledge_rank_of_all_against_brute_force(spark, monkeypatch, same):
    """Whatever files rows are dealt to: several owners, texts without words, and copies that differ by what they score besides words."""
    rng, vocabulary = random.Random(3), [a + b + c for a in ("alpha", "beta", "gamma") for b in "abcdefghij" for c in "xyz"]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.choice((1, 5, 30, 120)))), rng.choice("abb"), rng.choice(["HDFC", "SBI", "", None]), rng.choice(["card", "bank", None]), rng.choice(["bank_statement", "ppf", None])) for i in range(260)]
    rows += [(300 + i, rng.choice([rows[7][1], rows[8][1], "", "the 12", None]), "b", rng.choice(["HDFC", "SBI", None]), rng.choice(["card", None]), rng.choice(["bank_statement", None])) for i in range(90)]
    told = {r[0]: {w for w in re.findall("[a-z0-9]{3,}", (r[1] or "").lower()) if w not in rules.STATEMENT_STOPWORDS and not w.isdigit()} for r in rows}
    want = set()
    for i, _, owner, bank, kind, _ in (r for r in rows if same or r[0] % 5 == 0):
        texts, scores = set(), []
        for j, t, _, bank2, kind2, doc2 in sorted((r for r in rows if r[2] == owner and r[0] != i), key=lambda r: -r[0]):
            n = len(told[i] & told[j]) + 8 * bool(bank and bank == bank2) + 5 * bool(kind and kind == kind2) + 2 * (doc2 == "bank_statement")
            if n and (t or "") not in texts:
                scores.append((-n, -j))
                texts.add(t or "")
        want |= {(i, -j, -score, k + 1) for k, (score, j) in enumerate(sorted(scores)[:4])}
    for name, value in (("A_FILE", 60), ("SEEDS", 3), ("SPARE", 1), ("CELLS", 200), ("STRETCH", 50)):
        monkeypatch.setattr(documents, name, value)
    frame = spark.createDataFrame(rows, "doc_id long, text string, owner string, bank_hint string, account_type_hint string, doc_type string")
    got = documents.knowledge_rank(frame if same else frame.where("doc_id % 5 = 0"), frame, newest=None).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 250


def test_knowledge_rank_does_not_write_pairs(spark):
    """600 documents by 600 references: what tasks hand on grows with the documents, not with the pairs."""
    d = spark.range(600).selectExpr("id AS doc_id", "concat('same telling words beside word', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "'all' AS owner", "'HDFC' AS bank_hint", "'card' AS account_type_hint", "'ppf' AS doc_type")
    store = spark.sparkContext._jsc.sc().statusStore()
    ids = lambda: {j.stageIds().apply(k) for j in _listed(store.jobsList(None)) for k in range(j.stageIds().size())}
    before = ids()
    assert documents.knowledge_rank(d.where("doc_id % 1 = 0"), d, newest=None).count() == 2400
    written = [store.lastStageAttempt(k).shuffleWriteRecords() for k in ids() - before]
    assert 600 <= max(written) < 600 * 600 / 4


def _listed(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_knowledge_rank_query_takes_every_document(spark):
    """The registered query equals its SQL, and each document of the table has its references."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = {tuple(r) for r in queries.QUERIES["c17_knowledge_rank"](spark, sf).collect()}
    assert got == set(con.execute(ORACLE_SQL["c17_knowledge_rank"]).fetchall())
    assert {r[0] for r in got} == {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
