"""Statements against a plain loop over lines, however lines are dealt."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest

from brookledger import grammars
from brookledger.operators import statements

D = Decimal


def number(s):
    return D(s.replace(",", ""))


def day(s):
    d, m, y = s.replace("-", "/").split("/")
    try:
        return date({4: int(y), 2: int(y) + (1900 if int(y) >= 69 else 2000)}[len(y)], int(m), int(d))
    except (ValueError, KeyError):
        return None


def plain(text, g):
    """(line_no, date, description, amount, direction, balance), line by line."""
    search = lambda patterns, s: any(re.search(p, s) for p in patterns)
    found = re.search(grammars.BALANCE.format("Opening"), text)
    lines = text.split("\n")

    def entry(s, before):
        """None: no row; False: a row that doesn't count; else the row."""
        for name, p, (at, _, what, out, into, bal, mark) in g.shapes:
            if m := re.match(p, s):
                if day(m[at]) is None:
                    return False
                debit, credit = number(m[out]), number(m[into]) if into else None
                balance = number(m[bal]) if bal else None
                words = re.sub(r"\s{2,}", " ", m[what].strip())
                if credit is not None:
                    if not debit and not credit:
                        return False if not g.bad_rows_count else "same"
                    if debit and credit:
                        if before is None:
                            return [words, debit, "debit", balance, day(m[at])] if g.both_without_balance else "same"
                        side = balance >= before if g.equal_is_credit else balance > before
                    else:
                        side = bool(credit)
                    return [words, credit if side else debit, "credit" if side else "debit", balance, day(m[at])]
                if not debit:
                    return False
                side = m[mark].upper() in ("CR", "C") if mark else balance > before if before is not None else any(w in words.upper() for w in g.credit_words)
                return [words, debit, "credit" if side else "debit", balance, day(m[at])]
        return None

    out, inside, pending, streak, before = [], False, None, 0, number(found[1]) if found else None
    for n, s in enumerate(map(str.strip, lines), 1):
        if not s:
            pending, streak = None, streak + 1
            inside = inside and streak <= 3
            continue
        if search(g.starts, s):
            inside, streak = True, 0
            continue
        if inside and search(g.ends, s):
            inside, pending = False, None
            continue
        if not inside or search(g.skips, s):
            continue
        e = entry(s, before)
        if isinstance(e, list):
            out.append([n, *e])
            pending, streak, before = out[-1], 0, before if e[3] is None else e[3]
        elif e is None and pending and not s[0].isdigit():
            pending[1] += " " + s
            streak = 0
        elif e is None:
            pending, streak = None, streak + 1
            inside = streak <= 8
        elif e is False:
            streak += g.bad_rows_count
    if not out:
        for n, s in enumerate(map(str.strip, lines), 1):
            if len(s) >= 15 and not search(g.skips, s) and isinstance(e := entry(s, before), list):
                out.append([n, *e])
                before = before if e[3] is None else e[3]
    return {(n, d, w, a, side, b) for n, w, a, side, b, d in out}


def lines_of(rng, n):
    out = []
    for k in range(n):
        a, b = (rng.choice(["0.00", f"{rng.randrange(1, 90000)}.50", "1,00,000.00"]) for _ in range(2))
        at = (date(2024, 1, 1) + timedelta(days=rng.randrange(90))).strftime(rng.choice(["%d/%m/%Y", "%d-%m-%y", "31/02/2024", "1/1/123"] if rng.random() < 0.1 else ["%d/%m/%Y"]))
        out.append(rng.choice([
            *[f"{at} UPI  SHOP {k} {a} {b} {rng.randrange(99999)}.00"] * 4, *[f"{at} SALARY {a} {rng.randrange(99999)}.00"] * 2, f"{at} 02/01/2024 BY TRANSFER {a} {b} 5.00",
            f" {at} ATM {a} {rng.choice(['Cr', 'DR', 'C'])}", "  more of it", "ref no AB", "12 digits first", *[""] * (rng.random() < 0.3), "Page 3", "----", "Date Narration Debit", "Txn Date", "Closing Balance 5.00", "Transaction Details",
        ]) if rng.random() < 0.93 else rng.choice(["\n\n\n\n", "9\n9\n9\n9\n9\n9\n9\n9\n9", "Statement Summary", "Date Description"]))
    return out


@pytest.mark.parametrize("g", grammars.GRAMMARS, ids=lambda g: g.bank)
def test_rows(spark, g):
    rng = random.Random(g.bank)
    head = rng.choice(["Date Narration", "Txn Date", "Transaction Details"])
    texts = ["\n".join([*([f"Opening Balance: Rs. {rng.randrange(9)}00.00"] * (k % 2)), *([head] * (k % 3 > 0)), *lines_of(rng, rng.choice([3, 20, 60]))]) for k in range(40)]
    texts += ["\n".join([head, *lines_of(rng, 9000)]), None, "", "nothing here", "01/02/2024 SHOP one 10.00 5.00\n01/02/2024 SHOP two 10.00 15.00"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in statements.rows(docs.repartition(3), g).collect():
        got.setdefault(r["doc_id"], set()).add((r["line_no"], r["transaction_date"], r["description"], r["amount"], r["direction"], r["balance"]))
    want = {k: w for k, t in enumerate(texts) if (w := plain(t or "", g))}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], (k, sorted(got[k] ^ want[k])[:3])
    assert sum(map(len, want.values())) > 1000


def test_ranges_in_the_midst_of_a_document(spark, monkeypatch):
    """Every state and letter, in documents that are dealt over many ranges and files."""
    monkeypatch.setattr(statements, "PIECE", 170)
    rng = random.Random(1)
    rows, want = [], set()
    for doc, n in ((1, 4000), (2, 1), (None, 300), (3, 2000)):
        state, last, weights = statements.STATES[0], None, [rng.random() ** 3 for _ in statements.LETTERS]
        for k in range(n):
            letter = rng.choices(statements.LETTERS, weights)[0] if k else "S"
            rows.append((doc, k, letter, 0))
            state, said = statements.step(state, letter)
            last = k if said == "e" else last
            if said:
                want.add((doc, k, last))
    df = spark.createDataFrame(rows, "doc_id long, line_no long, letter string, begins int")
    for parts in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {(r["doc_id"], r["line_no"], r["entry"]) for r in statements.roles(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert statements.roles(df.limit(0)).count() == 0


def test_metadata(spark):
    text = "HDFC Bank Savings Account Statement\nAccount No: 5010 0123 4567\nStatement Period: 01/04/2024 to 30-04-24\nOpening Balance : Rs. 1,000.50\nTxn Date\n02/04/2024 NEFT CR ACME 500.00 1,500.50\nClosing Balance 1,500.50"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "State Bank of India Passbook"), (4, "SBI Card Account Statement")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in statements.metadata(docs).collect()}
    assert got[1] == ("XXXXXXXX4567", date(2024, 4, 1), date(2024, 4, 30), D("1000.50"), D("1500.50")) and got[2] == (None,) * 5
    assert [sorted(r["doc_id"] for r in statements.detected(docs, g).collect()) for g in grammars.GRAMMARS] == [[1], [3], []]
    found = statements.rows(docs, grammars.HDFC_SAVINGS)
    assert [tuple(r)[3:] for r in found.collect()] == [(None, "NEFT CR ACME", D("500.00"), "credit", D("1500.50"))]
    assert [tuple(r) for r in statements.opening_from_rows(found).collect()] == [(1, D("1000.50"))]
