"""Operators of a few expressions, with nulls and empty tables."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from brookledger.functions import classify
from brookledger.operators import dedup, documents, extract, insights, ledger, reconcile


def test_category_source(spark):
    rows = spark.createDataFrame([(1, "food", "rule"), (2, None, None), (3, "rent", "rule")], "txn_id long, category_name string, category_source string")
    after, log = ledger.updated(rows, spark.createDataFrame([(1,), (2,), (2,)], "txn_id long"), {"category_name": "food"})
    assert sorted(tuple(r) for r in after.collect()) == [(1, "food", "user"), (2, "food", "user"), (3, "rent", "rule")]
    assert [tuple(r) for r in log.collect()] == [(2, "category_name", None, "food")]


def test_unreadable(spark):
    long = "word " * 20
    pages = [("empty", None), ("empty", " \n"), ("good", long), ("half", long), ("half", "12"), ("third", long), ("third", long), ("third", long), ("third", "x"), ("digits", "1 " * 60), (None, long)]
    got = {r["doc_id"]: tuple(r)[1:] for r in documents.unreadable(spark.createDataFrame(pages, "doc_id string, text string")).collect()}
    assert got == {"empty": (2, 2, 2, True), "good": (1, 0, 0, False), "half": (2, 0, 1, True), "third": (4, 0, 1, False), "digits": (1, 0, 1, True), None: (1, 0, 0, False)}


def test_raw_rows(spark):
    rows = spark.createDataFrame([("s", 5, date(2024, 2, 1), "SHOP", Decimal("1.50"), "debit", 1.7), ("s", None, None, None, None, None, None), ("s", 7, None, "", None, "credit", -2.0)],
                                 "statement_id string, line_number int, transaction_date date, description string, amount decimal(14,2), direction string, confidence double")
    got = sorted((r["char_offset"], r["date_raw"], r["description_raw"], r["amount_raw"], r["txn_type_raw"], r["confidence"]) for r in ledger.raw_rows(rows, "template").collect())
    assert got == [(0, "", "", "", "", 0.0), (5, "01/02/2024", "SHOP", "1.50", "debit", 1.0), (7, "", "", "", "credit", 0.0)]


def test_line_counts(spark):
    lines = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, None, 5), (4, None, 5), (5, "b", 5), (6, "c", 0), (7, "d", None)], "line_id long, head string, amount int")
    fresh, counts = dedup.line_counts(lines, spark.createDataFrame([("b",)], "head string"), ["head"], ["line_id"], F.col("amount") > 0)
    assert sorted(r["line_id"] for r in fresh.collect()) == [1, 3] and tuple(counts.first()) == (2, 3, 2)
    assert tuple(dedup.line_counts(lines.limit(0), lines, ["head"], ["line_id"], F.lit(True))[1].first()) == (0, 0, 0)


def test_subscription_order(spark):
    rows = [(1, "b", "upcoming", 3), (1, "a", "upcoming", 3), (1, "z", "overdue", -5), (1, "n", "active", None), (2, "x", "active", 1)]
    got = insights.subscription_order(spark.createDataFrame(rows, "user_id long, merchant string, status string, days_left int"))
    assert [(r["user_id"], r["merchant"]) for r in got.orderBy("user_id", "place").collect()] == [(1, "z"), (1, "a"), (1, "b"), (1, "n"), (2, "x")]


def test_pending_messages(spark):
    rows = [(1, True, '{"pending": 2}'), (1, True, '{"pending": "3"}'), (1, False, '{"pending": 9}'), (1, None, '{"pending": 9}'), (2, True, "no json"), (3, True, None)]
    got = ledger.pending_messages(spark.createDataFrame(rows, "user_id long, is_active boolean, context string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5), (2, 0), (3, 0)]


def test_checklist_facts(spark):
    frame = spark.createDataFrame
    people = frame([(1,), (1,), (2,)], "user_id long")
    ais = frame([(1, "2024-25", "salary"), (1, "2024-25", "interest"), (1, "2023-24", "securities_sold")], "user_id long, fy string, category string")
    f26as = frame([(1, "2024-25", "194A"), (1, "2024-25", "194A"), (1, "2024-25", "194"), (1, "2024-25", "192")], "user_id long, fy string, section string")
    told = frame([(2, "2024-25", "form_16"), (2, "2023-24", "ais")], "user_id long, fy string, document_type string")
    rows = frame([(1, date(2024, 5, 1), False), (1, date(2024, 5, 1), True), (1, date(2023, 5, 1), False)], "user_id long, transaction_date date, is_excluded boolean")
    facts = reconcile.checklist_facts(people, ais, f26as, ais.select("user_id", "fy").limit(0), told, frame([(1,)], "user_id long"), rows, "2024-25", date(2024, 4, 1), date(2025, 3, 31))
    assert sorted(tuple(r) for r in facts.collect()) == [(1, True, True, False, True, False, 1, 2, 1, 1), (2, False, False, True, False, False, 0, 0, 0, 0)]
    assert {r["kind"] for r in reconcile.checklist(facts).where("user_id = 1").collect()} == {"MISSING_FORM_16", "MISSING_FORM_16A", "MISSING_INTEREST_CERT", "LOW_LEDGER_COVERAGE"}


def test_sms_classes_compile(spark):
    """The senders' bank, score and class by steps are what the single expressions give, and their plan names the sender's patterns a few times only."""
    rows = [("AD-HDFCBK", "Rs.500 debited from a/c XX1234"), ("VM-ICICIT-S", "482913 is your OTP"), ("JD-HDFCXX", "Your KYC expired, click http://bit.ly/x"), ("+919876543210", "won a prize, claim"), ("AX-SBIINBX", "INR 5 credited to account XX0001"), (None, "balance is Rs.5"), ("AD-HDFCBK", None)]
    m = spark.createDataFrame(rows, "address string, body string")
    got = extract.sms_classes(m)
    a, b = F.col("address"), F.col("body")
    want = m.select("*", classify.spam_score(a, b).alias("spam_score"), classify.sms_class(a, b).alias("sms_class"))
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.select(got.columns).collect(), key=key)
    assert [r[0] for r in spark.createDataFrame([("HDFCBK",), ("ICICIT",), ("KOTAKBX",), ("HDFCCCZ",), ("UNKNWN",), (None,)], "s string").select(classify.sender_bank(F.col("s"))).collect()] == ["HDFC", "ICICI", "KOTAK", "HDFC", None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("{4,8}") <= 4


def test_knowledge_rank_looks_at_all_references(spark):
    """The oldest of 400 documents tells most: it's beyond the newest 300, and found where all are looked at, whatever blocks they are dealt in."""
    rows = [(i, "same telling words here" if i in (1, 400) else f"word{'abcdefghij'[i % 10]} other{i}x", "all", None, None, None) for i in range(1, 401)]
    d = spark.createDataFrame(rows, "doc_id long, text string, owner string, bank_hint string, account_type_hint string, doc_type string")
    d = d.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    got = documents.knowledge_rank(d.where("doc_id = 400"), d, newest=None).collect()
    assert [(r["ref_id"], r["place"]) for r in got] == [(1, 1)]
    assert documents.knowledge_rank(d.where("doc_id = 400"), d).collect() == []
    size, documents.REFERENCES_A_TASK = documents.REFERENCES_A_TASK, 30
    try:
        cut = documents.knowledge_rank(d.where("doc_id % 20 = 0"), d, newest=None).collect()
    finally:
        documents.REFERENCES_A_TASK = size
    assert sorted(cut) == sorted(documents.knowledge_rank(d.where("doc_id % 20 = 0"), d, newest=None).collect()) and len(cut) == 77
