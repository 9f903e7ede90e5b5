"""Intake, review, tax documents and masks, against brute force and cases."""

import difflib
import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest

from brookledger.operators import balance, documents, extract, graph, intake, jobs, ledger, matching, review
from brookledger.sources import seeds

ROW = "txn_id long, user_id long, transaction_date date, amount decimal(14,2), direction string, account_masked string, fingerprint string, reference_number string, merchant_raw string, account_type string"


def ledger_rows(rng, n, first):
    out = []
    for k in range(n):
        out.append((first + k, rng.randrange(2), date(2024, 1, 1) + timedelta(days=rng.randrange(12)), Decimal(rng.randrange(1, 4) * 100), rng.choice(["debit", "credit"]), rng.choice([None, "XX1", "XX2"]),
                    f"fp{rng.randrange(40)}", rng.choice([None, None, None, "R1", "R2"]), rng.choice(["UPI SHOP", "NEFT SALARY", "ATM"]), "savings"))
    return out


def repeats(a, b, similar=False):
    """(tier, order, method, confidence) by which ``a`` repeats ``b``, else None."""
    _, user, day, amount, side, account, fp, ref, *_ = a
    if user != b[1]:
        return None
    if fp == b[6]:
        return 0, 0.0, "fingerprint_exact", 0.99
    if ref is not None and ref == b[7] and side == b[4] and (account is None or b[5] is None or account == b[5]):
        return 1, 0.0, "exact_ref", 1.0
    gap = abs((day - b[2]).days)
    alike = difflib.SequenceMatcher(None, (a[8] or "").upper(), (b[8] or "").upper()).ratio()
    if similar and amount == b[3] and side == b[4] and gap <= 1 and alike > 0.6:
        return 2, -alike, "amount_date_desc", min(0.95, 0.8 + (alike - 0.6) * 0.375)
    if amount == b[3] and side == b[4] and gap <= 3:
        return 3, float(gap), "fuzzy", max(0.6, 0.8 - gap * 0.2 / 3)
    return None


def serial_links(new, old, similar):
    known, links = [(x, False) for x in old], {}
    for row in sorted(new, key=lambda x: (x[2], x[0])):
        found = min(((*r[:2], batch, x[0], *r[2:]) for x, batch in known if (r := repeats(row, x, similar))), default=None)
        links[row[0]] = (found[3], found[4], round(found[5], 4)) if found else (row[0], "single_source", 1.0)
        if not found:
            known.append((row, True))
    return links


def test_thousands_of_alike_rows_join_in_few_rounds(spark, monkeypatch):
    """5,000 rows of one amount, side and user, of which each may repeat hundreds of those before it."""
    rng, made = random.Random(4), []
    new = [(k, 1, date(2024, 1, 1) + timedelta(days=rng.randrange(300)), Decimal(5), "debit", None, f"f{k}", None, rng.choice(["SWIGGY ORDER", "UBER TRIP"]), "savings") for k in range(5000)]
    monkeypatch.setattr(graph, "written", lambda df, name="table", real=graph.written: made.append(name) or real(df, name))
    got = review.promoted(spark.createDataFrame(new, ROW), spark.createDataFrame([], ROW))
    assert {r["txn_id"]: (r["match_id"], r["method"], r["confidence"]) for r in got.links.collect()} == serial_links(new, [], True)
    assert len(made) <= 4 * 12


def test_a_chain_of_days_needs_no_rounds(spark, monkeypatch):
    """400 rows of one amount, each of which may repeat the one before it: their component is found without following the chain."""
    new = [(k, 1, date(2024, 1, 1) + timedelta(days=3 * k), Decimal(5), "debit", None, f"f{k}", None, "SHOP", "savings") for k in range(400)]
    made = []
    monkeypatch.setattr(graph, "written", lambda df, name="table", real=graph.written: made.append(name) or real(df, name))
    got = review.kin(spark.createDataFrame(new, ROW)).collect()
    assert {r["node"] for r in got} == set(range(400)) and {r["component"] for r in got} == {0}
    assert len(made) <= 8


def test_similarities_of_many_texts_are_those_of_difflib():
    rng = random.Random(5)
    sizes = (0, 1, 7, 30, 60, 199, 200, 260)
    texts = ["".join(rng.choices(signs, k=rng.choice(sizes[:most]))) for signs, most in (("ab", 4), ("abc #0123\u00e9", 5), ("abcdef \u6f22\U0001f600", 8)) for _ in range(120)]
    pairs = [(a, b) for a in rng.sample(texts, 30) for b in rng.sample(texts, 30)]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert matching.ratios(*map(list, zip(*pairs))).tolist() == want
    # Of a row's pairs those that are left out are less alike than its best one, or not alike.
    rows = [k // 30 for k in range(len(pairs))]
    got = matching._best_ratios(np.array(rows), *map(list, zip(*pairs))).tolist()
    assert all(x in (0.0, y) for x, y in zip(got, want)) and 0.0 in got
    for row in set(rows):
        best = max(y for y, r in zip(want, rows) if r == row)
        assert best <= 0.6 or [k for k, r in enumerate(rows) if r == row and got[k] == best] == [k for k, r in enumerate(rows) if r == row and want[k] == best]
    assert matching.ratios([], []).tolist() == [] and matching._best_ratios(np.array([], dtype=int), [], []).tolist() == []


@pytest.mark.parametrize("seed,similar", [(0, False), (1, False), (2, True), (3, True)])
def test_promoted_rows_see_those_before_them(spark, seed, similar):
    rng = random.Random(seed)
    old, new = ledger_rows(rng, 6, 1), ledger_rows(rng, 40, 100)
    links = serial_links(new, old, similar)
    got = review.promoted(spark.createDataFrame(new, ROW), spark.createDataFrame(old, ROW), similar=similar)
    assert {r["txn_id"]: (r["match_id"], r["method"], r["confidence"]) for r in got.links.collect()} == links
    made = {r["txn_id"]: r["nature"] for r in got.entries.collect()}
    assert set(made) == {k for k, v in links.items() if v[1] == "single_source"} and None not in made.values()
    none = review.promoted(spark.createDataFrame([], ROW), spark.createDataFrame(old, ROW), similar=False)
    assert none.links.count() == 0 and none.entries.count() == 0


def test_portal_lines(spark):
    text = "Annual Information Statement\nSalary Income from HDFC BANK: 1,200,000\nInterest from Savings Bank ICICI BANK: 18,500\nDividend Received: 4,200"
    got = {(r["category"], r["word"], r["amount"]) for r in extract.ais_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    # The text between a word and its amount may hold other letters; a longer word is read before a shorter one of its category.
    assert {("salary", "salary income", 1200000.0), ("interest", "interest from savings bank", 18500.0), ("dividend", "dividend received", 4200.0)} <= got
    twice = "fd interest 500.00 paid. " + "x" * 100 + " fd interest 500.00 paid again"
    rows = extract.ais_lines(spark.createDataFrame([(1, twice)], "doc_id long, text string")).collect()
    assert sorted(r["amount"] for r in rows) == [500.0] * len(rows) and len(rows) >= 2


def test_deductions(spark):
    text = "Form 26AS Part A\nDEDUCTOR TAN: ABCD12345E  Section: 192  Amount Credited: 1500000  Amount of TDS: 100000\n" + "y " * 150 + "WXYZ54321A lump 250.50" + " z" * 150 + "BSR: 1234567 paid 5,000"
    rows = [tuple(r)[1:] for r in extract.form26as_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()]
    assert ("A", "ABCD12345E", "192", 1500000.0, 100000.0) in rows and ("B", "WXYZ54321A", None, 54321.0, 250.5) not in rows
    assert any(r[:3] == ("B", "WXYZ54321A", None) and r[3] == 250.5 for r in rows)
    assert ("C", None, "self_paid_challan", 1234567.0, None) in rows


def test_masks(spark):
    def masked(text, short=False):
        return documents.masked(spark.createDataFrame([(text,)], "text string"), short).first()["text"]

    out = masked("UPI/123456789012/PHONEPE REF 123456789012 " + "." * 60 + " account 1234567890123")
    assert out.count("123456789012") == 2 and out.endswith("account XXXX-XXXX-XXXX-XXXX")
    assert masked("account no 123456789 ends") == "account no XXXX_ACCTends" and masked("id 987654321000 is free") == "id 987654321000 is free"
    assert masked("your OTP is 1234\nPAN ABCDE1234F, aadhaar 1234 5678 9012") == "[OTP_LINE_REMOVED]\nPAN XXXX_PAN, aadhaar XXXX XXXX XXXX"
    assert masked("Mail a.b@c.example or +91 9876543210") == "Mail XXXX@XXXX.XXX or XXXX_PHONE"
    assert masked("Dear John Smith, Name: Jane Doe") == "Dear XXXX_NAME, Name: XXXX_NAME" and masked(None) is None and masked("") == ""
    assert masked("Payment with code 987654321234 for invoice", True) == "Payment with code 987654321234 for invoice"
    assert masked("Card ending number 4111111111111111.", True) == "Card ending number XXXX-XXXX-XXXX-XXXX."
    assert masked("Batch 4111111111111111 done", True) == "Batch 4111111111111111 done" and masked("Batch 4111111111111111 done") == "Batch XXXX-XXXX-XXXX-XXXXdone"


def test_masks_take_time_in_step_with_the_text(spark):
    import time

    long = "a" * 400_000
    rows = [(f"{long} x.y@z.example.c_d@e.f account 123456789 {long}",)]
    began = time.time()
    got = documents.masked(spark.createDataFrame(rows, "text string")).first()["text"]
    assert got == f"{long} XXXX@XXXX.XXXXXXX@XXXX.XXX account XXXX_ACCT{long}" and time.time() - began < 30


def test_newest_first_statements(spark):
    rows = [("s", k, date(2024, 1, 10 - k), Decimal(a), Decimal(b), t) for k, (a, b, t) in enumerate([(50, 850, "SHOP"), (100, 900, "RENT"), (500, 1000, "OPEN")])]
    rows += [("t", 0, date(2024, 1, 1), Decimal(70), None, "MAY SALARY"), ("t", 1, date(2024, 1, 2), Decimal(70), None, "BY TRANSFER")]
    df = spark.createDataFrame(rows, "statement_id string, seq int, transaction_date date, amount decimal(14,2), balance_after decimal(14,2), description string")
    got = {(r["statement_id"], r["seq"]): r["direction"] for r in balance.directions(df).collect()}
    assert got == {("s", 0): "debit", ("s", 1): "debit", ("s", 2): "debit", ("t", 0): "credit", ("t", 1): "debit"}


def test_line_chunks(spark):
    text = "\n".join(f"line {k} " + "x" * (k % 7) for k in range(60)) + "\n\n" + "y" * 300
    lines = [s for x in text.splitlines() if (s := x.strip())]
    got = [r["chunk"].split("\n") for r in intake.line_chunks(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string"), 120, 2, 50).orderBy("chunk_no").collect()]
    at = 0
    for k, chunk in enumerate(got):
        start = lines.index(chunk[0])
        assert chunk == lines[start : start + len(chunk)] and (len(chunk) == 1 or sum(len(x) + 1 for x in chunk) <= 120)
        assert start == (max(at + 1, at + len(got[k - 1]) - 2) if k else 0)
        at = start
    assert got[-1][-1] == lines[-1]


def test_promotion_of_a_statement_that_came_before(spark):
    raw = "statement_id string, seq long, user_id long, account_masked string, account_type string, source string, confidence double, txn_date date, description string, amount decimal(14,2), is_credit boolean, balance_after decimal(16,2), validation_status string, validation_errors array<string>, file_hash string, statement_fp string"
    row = lambda s, k, text, credit, h: (s, k, 1, "XX1", "savings", "template", 0.9, date(2024, 1, k + 1), text, Decimal(10 * (k + 1)), credit, None, "valid", [], h, None)
    new = spark.createDataFrame([row("b", 0, "SHOP ONE", True, "f1"), row("b", 1, "NEW", False, "f1")], raw)
    old = spark.createDataFrame([("a", 1, "key", "f1", None, date(2024, 1, 1), Decimal(10), "SHOP ONE")], "statement_id string, user_id long, dedup_key string, file_hash string, statement_fp string, transaction_date date, amount decimal(14,2), merchant_raw string")
    s = spark.createDataFrame([("b", Decimal(100), Decimal(100))], "statement_id string, opening_balance decimal(16,2), closing_balance decimal(16,2)")
    out = ledger.promote(new, old, s)
    assert [r["seq"] for r in out.entries.collect()] == [1] and out.counts.first()["duplicates"] == 1
    assert {r["reason"] for r in out.reviews.collect()} == {"balance_walk_failed"}


def test_bulk_update_needs_all_entries(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "txn_id long, notes string")
    after, log = review.bulk_updated(rows, spark.createDataFrame([(1,)], "txn_id long"), {"notes": "c"})
    assert {r["notes"] for r in after.collect()} == {"c", "b"} and log.count() == 1
    with pytest.raises(ValueError):
        review.bulk_updated(rows, spark.createDataFrame([(3,)], "txn_id long"), {"notes": "c"})


def test_manual_snapshots_only_are_deleted(spark):
    snaps = spark.createDataFrame([(1, 1, "manual"), (2, 1, "statement"), (3, 2, "manual")], "snapshot_id long, user_id long, source_kind string")
    ids = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "snapshot_id long, user_id long")
    assert sorted(r["snapshot_id"] for r in review.without_manual(snaps, ids).collect()) == [2, 3]


def test_sender_subjects(spark):
    mails = spark.createDataFrame([(k, "A@x.example", f"s{k % 5}" if k % 7 else None, False) for k in range(50)], "message_id long, from_address string, subject string, has_attachment boolean")
    assert jobs.sender_discovery(mails, [], ["s"]).first()["subjects"] == ["s1", "s2", "s3"]
    assert jobs.sender_discovery(mails.where("subject IS NULL"), [], ["s"]).first()["subjects"] == []


def test_seeds(spark):
    rows = {r["category_id"]: r for r in seeds.categories(spark, {"A": ("x", "y"), "B": ()}).collect()}
    assert set(rows) == {"A", "A > x", "A > y", "B"} and rows["A > y"]["parent_id"] == "A" and rows["B"]["sort_order"] == 1
    made = seeds.categories(spark)
    assert seeds.new_categories(made, made).count() == 0 and seeds.new_categories(made.limit(0), made).count() == made.count()
    table = [("Shop", "Shopping", [("contains", "shop", 5), ("exact", "the shop", 9)]), ("Other", "Shopping", [("contains", "SHOP", 7)])]
    patterns = seeds.merchants(spark, table)
    assert patterns.count() == 2
    got = matching.merchants(spark.createDataFrame([("the shop",), ("a shop here",), ("none",), (None,)], "merchant_raw string"), patterns)
    assert {r["merchant_raw"] for r in got.collect()} == {"the shop", "a shop here"}


def test_merchants_in_blocks(spark, monkeypatch):
    patterns = spark.createDataFrame([(k, "contains", f"w{k}x", k, f"m{k}", "c") for k in range(30)], seeds.MERCHANT)
    texts = spark.createDataFrame([(" ".join(f"w{j}x" for j in range(k)),) for k in range(1, 20)], "merchant_raw string")
    whole = {tuple(r) for r in matching.merchants(texts, patterns).collect()}
    monkeypatch.setattr(matching, "RULES", 7)
    assert {tuple(r) for r in matching.merchants(texts, patterns).collect()} == whole and len(whole) == 19


def test_pack_frames(spark):
    rows = spark.createDataFrame([(1, 7, date(2024, 5, 1), Decimal(10), "credit", "income", "X", None, "B", None, False)], "txn_id long, user_id long, transaction_date date, amount decimal(14,2), direction string, nature string, merchant_raw string, category_name string, bank_name string, account_masked string, is_excluded boolean")
    found = spark.createDataFrame([(7, "matched", Decimal(1), Decimal(1)), (7, "missing_in_ledger", Decimal(1), None)], "user_id long, kind string, portal_amount decimal(14,2), ledger_amount decimal(14,2)")
    docs = spark.createDataFrame([], "user_id long, file_name string, doc_type string, status string")
    frames = seeds.pack_frames(rows, rows.select("user_id"), rows.select("user_id"), {"AIS": found}, docs, ["none"])
    assert len(frames) == 7 and frames["summary"].first().asDict() == {"user_id": 7, "entries": 1, "credits": Decimal(10), "debits": Decimal(0), "matched": 1, "open": 1, "documents": 0}
    assert len(frames["ledger_FY"].columns) == 13


def test_card_payments_become_transfers(spark):
    columns = "txn_id long, user_id long, transaction_date date, amount decimal(14,2), direction string, account_type string, account_masked string, bank_name string, merchant_raw string, nature string, is_excluded boolean"
    row = lambda k, day, side, kind, text: (k, 1, date(2024, 1, day), Decimal(500), side, kind, f"XX{kind}", "HDFC", text, "expense", False)
    rows = spark.createDataFrame([row(1, 1, "debit", "savings", "CREDIT CARD PAYMENT BILLDESK"), row(2, 2, "credit", "credit_card", "CREDIT CARD PAYMENT RECEIVED"), row(3, 20, "debit", "savings", "UPI SHOP"), row(4, 25, "debit", "savings", "MUTUAL FUND SIP")], columns)
    known = spark.createDataFrame([(1, 2, 0.5, "confirmed"), (8, 9, 0.4, "rejected")], "debit_id long, credit_id long, confidence double, resolution_status string")
    after, matches = review.transfers_reclassified(rows, known)
    assert {r["txn_id"]: r["nature"] for r in after.collect()} == {1: "transfer_internal", 2: "transfer_internal", 3: "expense", 4: "investment"} and after.columns == rows.columns
    got = {(r["debit_id"], r["credit_id"]): (r["confidence"] > 0.5, r["resolution_status"]) for r in matches.collect()}
    assert got == {(1, 2): (True, "confirmed"), (8, 9): (False, "rejected")}


def test_thousands_of_merchant_patterns(spark):
    """Patterns by content against plain search; without regular expressions nothing is a nested loop."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgAB é", k=n))
    texts = [word(rng.randrange(1, 40)) for _ in range(300)] + [None, "", "  x  ", "İstanbul", "straße 7"]
    patterns = [(k, "contains", rng.choice([word(rng.choice([1, 2, 3, 4, 5, 9])), rng.choice(texts[:300])[2:9] or "ab"]), rng.randrange(5), f"m{k}", "c") for k in range(30_000)]
    patterns += [(40_000, "contains", None, 9, "null", "c"), (40_001, "contains", "STRASSE", 9, "s", "c"), (40_002, "contains", "zzzz", 9, "z", "c"), (40_003, "exact", "X", 9, "x", "c")]
    rows = [p for p in patterns if p[2]]
    upper = dict(zip(texts, (r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("upper(trim(t)) AS u").collect())))
    uppers = [(spark_upper, p) for spark_upper, p in zip((r["u"] for r in spark.createDataFrame(rows, "i int, k string, p string, r int, m string, c string").selectExpr("upper(p) AS u").collect()), rows)]
    want = {}
    for t in filter(None, texts):
        hits = [(-p[3], p[0], p[4]) for u, p in uppers if (u in upper[t] if p[1] == "contains" else u == upper[t])]
        if hits:
            want[t] = min(hits)[2]
    got = matching.merchants(spark.createDataFrame([(t,) for t in texts], "merchant_raw string"), spark.createDataFrame(patterns, "pattern_id int, kind string, pattern string, priority int, merchant string, category string"))
    assert {r["merchant_raw"]: r["merchant"] for r in got.collect()} == want and len(want) > 200
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_word_chunks(spark):
    rng = random.Random(3)
    texts = [None, "", "   ", "one", "x" * 5000, " ".join("w" * rng.randint(1, 30) for _ in range(900)), "a" * 1000 + " " + "b" * 900, "a " * 899 + "\n\t" + "c" * 2000, "é\u00a0ü " * 700]
    got = {}
    for r in documents.word_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
    for k, t in enumerate(texts):
        whole, want, start = " ".join((t or "").split()), [], 0
        while start < len(whole):
            window = whole[start : start + 1800]
            end = start + len(window)
            if end < len(whole) and window.rfind(" ") > 900:
                end = start + window.rfind(" ")
            want.append(whole[start:end].strip())
            if end >= len(whole):
                break
            start = max(0, end - 240)
        assert got.get(k, {}) == dict(enumerate(want))
    with pytest.raises(ValueError):
        documents.word_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 100, 50)


def test_word_chunks_come_in_small_batches(spark):
    """Unless the session says otherwise."""
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
        assert documents.word_chunks(docs).count() == 5000 and int(spark.conf.get(key)) <= 1000
        spark.conf.set(key, "77")
        documents.word_chunks(docs)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)


def test_all_reports_read_the_ledger_for_written_tables_alone(spark):
    """Several reports name a user's figures; none works them out again from the ledger."""
    from brookledger.plans import desk, queries  # noqa: F401  desk adds its queries

    plan = queries.QUERIES["m8_all_reports"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderdate" not in plan
