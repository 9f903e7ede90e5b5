"""Card statements and passbooks against plain loops over lines."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest

from brookledger import grammars
from brookledger.operators import cards, statements

D, AS_OF = Decimal, date(2026, 1, 1)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def when(s):
    d, m, y = re.split(r"[/\-\s]+", s)
    m = int(m) if m.isdigit() else MONTHS.index(m[:3].lower()) + 1 if m[:3].lower() in MONTHS else 0
    try:
        out = date(int(y) + (2000 if len(y) == 2 else 0), m, int(d))
    except ValueError:
        return None
    return out if 2010 <= out.year <= 2028 else None


def entry(s, card):
    """None: no row; False: one that can't be read; else date, words, amount, direction."""
    for p, (at, what, plus, amount, mark) in card.shapes:
        if m := re.match(p, s):
            value, on = D(m[amount].replace(",", "")), when(m[at])
            if not on or not value:
                return False
            words = re.sub(r"\s{2,}", " ", m[what].strip()) if card.tight else m[what].strip()
            return [on, words, value, "credit" if (plus and m[plus]) or (m[mark] or "").upper() in card.credit_marks else "debit"]
    return None


def plain(text, card):
    hit = lambda patterns, s: any(re.search(p, s) for p in patterns)
    lines, out = [s.strip() for s in text.split("\n")], []
    inside, open_, gap = card.course == "open", None, 0
    for n, s in enumerate(lines, 1):
        starts, ends = hit(card.starts, s), hit(card.ends, s)
        if card.course == "gaps":
            if not s:
                open_, gap = None, gap + 1
                inside = inside and gap <= 3
            elif starts:
                inside, open_, gap = True, None, 0
            elif inside and ends:
                inside, open_ = False, None
            elif inside and not hit(card.skips, s):
                e = entry(s, card)
                if e:
                    open_, gap = [n, *e], 0
                    out.append(open_)
                elif e is False:
                    gap += 1
                elif open_ and not s[0].isdigit():
                    open_[2], gap = open_[2] + " " + s, 0
                else:
                    open_, gap = None, gap + 1
                    inside = gap <= 8
        elif card.course == "blocks":
            if not s:
                inside = inside and not out
            elif not inside:
                inside = starts
            elif ends:
                inside = False
            elif not hit(card.skips, s):
                e = entry(s, card)
                if e:
                    open_ = [n, *e]
                    out.append(open_)
                elif e is None and open_ and not s[0].isdigit():
                    open_[2], open_ = open_[2] + " " + s, None
        elif not s:
            open_ = None
        elif (e := entry(s, card)) is not None:
            open_ = [n, *e] if e else None
            out += [open_] if e else []
        elif open_ and not re.match(grammars.AXIS_DAY, s):
            open_[2] += "" if ends else " " + s
            open_ = None
    if card.course == "gaps" and not out:
        for n, s in enumerate(lines, 1):
            if not s:
                open_ = None
            elif not hit(card.skips, s) and not hit(card.ends, s):
                e = entry(s, card)
                if e:
                    open_ = [n, *e]
                    out.append(open_)
                elif e is None and open_ and not s[0].isdigit():
                    open_[2], open_ = open_[2] + " " + s, None
    return {tuple(e) for e in out}


def lines_of(rng, n):
    for k in range(n):
        at = (date(2024, 1, 1) + timedelta(days=rng.randrange(90))).strftime(rng.choice(["%d/%m/%Y", "%d-%m-%y", "%d-%b-%Y", "%d %b %y", "%d %B %Y", "%d/%m/%Y"]))
        at = rng.choice(["31/02/2024", "01/01/1999", "45-Xyz-2024"]) if rng.random() < 0.08 else at
        amount = rng.choice(["0.00", f"{rng.randrange(1, 90000)}.50", "1,00,000.00"])
        yield rng.choice([
            *[f"{at} SHOP  {k} {amount}"] * 3, *[f"{at}  PAYMENT {k} {amount} {rng.choice(['Cr', 'DR', 'C', 'CR'])}"] * 3, f"{at} | 10:45 STORE {k} + C {amount} l", f"{at} FOOD {k} {amount} Dr 1.00 Cr", f"{at} only words",
            "   more of it", "ref AB", "12 digits first", "", "Page 3", "-----", "Date Transaction Description", "Total Amount Due", "Transaction Details", "End of Statement", "SBI Card", "Domestic Transactions",
        ]) if rng.random() < 0.93 else rng.choice(["\n\n\n\n", "9\n9\n9\n9\n9\n9\n9\n9\n9", "Reward Points", "New Transactions", "Account Summary"])


@pytest.mark.parametrize("card", grammars.CARDS, ids=lambda c: c.bank)
def test_rows(spark, card, monkeypatch):
    monkeypatch.setattr(statements, "PIECE", 300)
    rng = random.Random(card.bank)
    texts = ["\n".join([*(["Transaction Details"] * (k % 3 > 0)), *lines_of(rng, rng.choice([3, 20, 60]))]) for k in range(160)]
    texts += ["\n".join(["Domestic Transactions", *lines_of(rng, 7000)]), None, "", "nothing here", "01/02/2024 SHOP 10.00\nmore\nand more\n02/02/2024 SHOP 5.00 Cr\n\nlost"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in cards.rows(docs.repartition(3), card, AS_OF).collect():
        got.setdefault(r["doc_id"], set()).add(tuple(r)[1:])
    want = {k: w for k, t in enumerate(texts) if (w := plain(t or "", card))}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], (k, sorted(got[k] ^ want[k])[:4])
    assert sum(map(len, want.values())) > 500
    assert cards.rows(docs.limit(0), card, AS_OF).count() == 0


def test_metadata(spark):
    hdfc = "HDFC Bank Credit Card Statement\nCard No: 5268 12XX XXXX 1234\nBilling Period 18 Feb, 2026 - 17 March, 2026\nTotal Dues: Rs. 12,345.60\nMinimum Amount Due : 600\nDUE DATE\nC600.00 06 Apr, 2026\nCredit Limit 2,00,000\nAvailable Credit Limit: 1,50,000.00\nPrevious Statement Balance 99.50\nPayments Received 50.00"
    below = "HDFC Bank\nCredit Card\nStatement Date: 11/11/2024\nTOTAL AMOUNT DUE\nPayments received C9.00\nC1,234.50\nMINIMUM DUE DUE DATE\nC100.00 01 Dec, 2024\nTOTAL CREDIT LIMIT AVAILABLE\nC5.00\nC70,000 C60,000.25"
    sbi = "SBI Card Statement\nCard Number XXXX XXXX XXXX 4321\nStatement Period: 12 Oct 24 to 11 Nov 24\nTotal Amount Due: 900.00\nMin Amount Due 45\nPayment Due Date: 01-Dec-2024\nCredit Limit 1,00,000\nOpening Balance 10.00"
    axis = "Axis Bank Credit Card\nTotal Payment Due Minimum Payment Due Period Due Date\n\n9,000.00 Dr 450.00 Dr 15/10/2024 - 14/11/2024 04/12/2024\nCredit Card Number Credit Limit Available\n533467******7381 3,00,000.00 2,91,000.00"
    docs = spark.createDataFrame([(1, hdfc), (2, below), (3, sbi), (4, axis), (5, None), (6, "HDFC Bank Savings Account")], "doc_id long, text string")
    assert [sorted(r["doc_id"] for r in statements.detected(docs, c).collect()) for c in grammars.CARDS] == [[1, 2], [3], [4]]
    got = {}
    for card in grammars.CARDS:
        got |= {(card.bank, r["doc_id"]): tuple(r)[1:] for r in cards.metadata(docs, card, AS_OF).collect()}
    assert got["HDFC", 1] == ("XXXX XXXX XXXX 1234", date(2026, 2, 18), date(2026, 3, 17), date(2026, 4, 6), D("12345.60"), D("600.00"), D("200000.00"), D("150000.00"), D("99.50"), D("50.00"))
    assert got["HDFC", 2] == (None, date(2024, 10, 12), date(2024, 11, 11), date(2024, 12, 1), D("1234.50"), D("100.00"), D("70000.00"), D("60000.25"), None, None)
    assert got["SBI", 3] == ("XXXX XXXX XXXX 4321", date(2024, 10, 12), date(2024, 11, 11), date(2024, 12, 1), D("900.00"), D("45.00"), D("100000.00"), None, D("10.00"), None)
    assert got["AXIS", 4] == ("XXXX XXXX XXXX 7381", date(2024, 10, 15), date(2024, 11, 14), date(2024, 12, 4), D("9000.00"), D("450.00"), D("300000.00"), D("291000.00"), None, None)
    assert all(got[c.bank, 5] == (None,) * 10 for c in grammars.CARDS)
    rows = spark.createDataFrame([(1, date(2026, 2, 1)), (1, date(2026, 3, 1))], "doc_id long, transaction_date date")
    wide = {r["doc_id"]: (r["period_start"], r["period_end"]) for r in cards.widened(cards.metadata(docs, grammars.HDFC_CARD, AS_OF), rows).collect()}
    assert wide[1] == (date(2026, 2, 1), date(2026, 3, 17)) and wide[2] == (date(2024, 10, 12), date(2024, 11, 11))


def bob(text):
    """(line_no, date, posted, words, amount, direction, balance) of a passbook, line by line."""
    g, out, inside = grammars.BOB_SAVINGS, [], False
    number = lambda s: D(re.sub(r"(?i)(cr|dr)$", "", s).replace(",", ""))

    def exact(s):
        m = re.fullmatch(r"(\d+)([/-])(\d+)\2(\d{2}|\d{4})", s)
        try:
            return date(int(m[4]) + (2000 if len(m[4]) == 2 else 0), int(m[3]), int(m[1])) if m else None
        except ValueError:
            return None

    def pop(words, p):
        at = max((k for k, w in enumerate(words) if re.search(p, w)), default=None)
        return words.pop(at) if at is not None else None

    for n, s in enumerate((" ".join(x.split()) for x in text.split("\n")), 1):
        if not s:
            continue
        if re.search(g.starts[0], s):
            inside = True
        elif inside and not re.search(g.skips[0], s):
            m, words = re.match(r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}) (.+)$", s), []
            posted = balance = amount = None
            if m and exact(m[1]) and len(words := m[2].split()) >= 3:
                posted = exact(words.pop(0)) if re.fullmatch(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", words[0]) else None
                balance, amount = pop(words, g.balance), pop(words, g.amount)
            if balance and amount:
                out.append([n, exact(m[1]), posted, " ".join(words), number(amount), None, -number(balance) if balance.lower().endswith("dr") else number(balance)])
            elif out and not s.lower().startswith("total"):
                out[-1][3] = f"{out[-1][3]} {s}".strip()
    before = None
    for e in out[::-1] if len(out) > 1 and out[0][1] > out[-1][1] else out:
        moved = None if before is None else e[6] - before
        fits = moved is not None and abs(abs(moved) - e[4]) <= D("0.02")
        e[5] = "credit" if (moved > 0 if fits else any(w in e[3].upper() for w in g.credit_words)) else "debit"
        before = e[6]
    return {tuple(e) for e in out}


def test_passbook(spark):
    rng, head = random.Random(3), "TRAN DATE VALUE DATE NARRATION CHQ.NO. WITHDRAWAL(DR) DEPOSIT(CR) BALANCE(INR)"
    texts = []
    for k in range(40):
        total, at, rows = 5000, date(2024, 1, 1), []
        for n in range(rng.choice([1, 5, 60])):
            amount, at = rng.randrange(1, 900), at + timedelta(days=rng.randrange(3))
            total += amount * rng.choice([1, -1])
            shown = at.strftime(rng.choice(["%d-%m-%Y", "%d/%m/%y"])) if rng.random() < 0.95 else "31-02-2024"
            side = "Cr" if total >= 0 else "Dr"
            rows.append(f"{shown} {shown if rng.random() < 0.7 else ''} {rng.choice(['UPI/123456/ABC', 'SALARY', 'x 77', 'Gift  from', ''])} {amount}.00 {abs(total) if rng.random() < 0.9 else 1:,}.00{side if rng.random() < 0.95 else ''}"
                        + rng.choice(["", "", "\nmore NEFT/99/XYZ", "\n\nPage 2", "\nTotal 5", "\n5 and a digit", "\n" + head]))
        texts.append("\n".join(["Bank of Baroda", "01-01-2024 NOT YET 1.00 2.00Cr", head, *(rows[::-1] if k % 2 else rows)]))
    texts += [None, "", head, "Account Number: 1234 5678 9012\nStatement Period from 01-04-2024 to 30-04-2024\nClosing Balance: 77.50\n" + head + "\n02-04-2024 02-04-2024 SALARY 100.00 150.00Cr"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = cards.passbook_rows(docs, grammars.BOB_SAVINGS)
    got = {}
    for r in found.drop("place", "reference").collect():
        got.setdefault(r["doc_id"], set()).add(tuple(r)[1:])
    want = {k: w for k, t in enumerate(texts) if (w := bob(t or ""))}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], (k, sorted(got[k] ^ want[k])[:4])
    meta = {r["doc_id"]: tuple(r)[1:] for r in cards.passbook_metadata(docs, grammars.BOB_SAVINGS, found).collect()}
    assert meta[len(texts) - 1] == ("XXXXXXXX9012", date(2024, 4, 1), date(2024, 4, 30), D("50.00"), D("77.50")) and meta[40] == (None,) * 5
    assert {r["reference"] for r in found.where("description = 'UPI/123456/ABC'").collect()} == {"UPI/123456/ABC"}
    assert [r["doc_id"] for r in statements.detected(docs.where("doc_id < 2"), grammars.BOB_SAVINGS).collect()] == [0, 1]


def test_texts_and_lines_are_read_once_a_pattern(spark, monkeypatch):
    """What is read of a text or line is a column of its own, and isn't worked out again by each expression that names it."""
    docs = spark.createDataFrame([(1, "HDFC Bank\nCredit Card Statement")], "doc_id long, text string")
    plans, write = [], cards.written

    def kept(df, name="table", **options):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, **options)

    monkeypatch.setattr(cards, "written", kept)
    for card in grammars.CARDS:
        plans.clear()
        cards.rows(docs, card, AS_OF)
        letters = dict(plans)["card-letters"]
        assert letters.count("regexp_extract(line") == 0 and letters.count("regexp_") < 45, card.bank
        meta = cards.metadata(docs, card, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
        patterns = len(card.periods) + len(card.due) + len(card.card) + sum(map(len, card.amounts.values())) + 1
        assert meta.count("regexp_extract(text") <= patterns, card.bank

