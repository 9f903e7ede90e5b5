"""Kinds of uploads against the rules read one by one."""

import random
import re

from brookledger import rules
from brookledger.operators import filing


def plain(name, text, bank, told, account):
    suffix = (re.search(r"\.([^./\\]+)$", name or "") or [None, ""])[1].lower()
    if suffix not in ("pdf", "xlsx", "xls", "csv"):
        return "unsupported", None, None, 1.0, False
    bank = (bank or "").strip() or None
    t = re.sub(r"[_\-/\\]", " ", f"{name or ''} {text or ''}".lower())
    has = lambda s, phrases: any(p in s for p in phrases)
    kind = next((k for k, names in rules.DOCUMENT_TYPES.items() if re.sub("[- ]", "_", (told or "").strip().lower()) in names), None)
    if kind and kind != "auto":
        return kind, bank, {"credit_card_statement": "credit_card", "bank_statement": "bank_account"}.get(kind), 1.0, True
    if suffix != "pdf":
        for phrases, kind, sure in ((rules.SHEET_TRADES, "demat_trade_report", 0.94), (rules.SHEET_GAINS, "demat_tax_report", 0.9), (rules.SHEET_HOLDINGS, "demat_holdings", 0.88), (("",), "spreadsheet", 0.6)):
            if has(t, phrases):
                return kind, bank, None, sure, False
    account = (account or "").strip().lower()
    if account in ("credit_card", "bank_account", "savings", "current"):
        return ("credit_card_statement", bank, "credit_card", 0.96, True) if account == "credit_card" else ("bank_statement", bank, "bank_account", 0.96, True)
    head = []
    for line in t.splitlines():
        if has(" ".join(line.split()), rules.HEADING_ENDS) or len(head) == 40:
            break
        head.append(line)
    h = "\n".join(head)[:2500]
    if has(h, rules.PPF_PHRASES):
        return "ppf_statement", bank, None, 0.95, False
    if has(h, rules.CHALLAN_PHRASES):
        return "tax_challan", None, None, 0.95, False
    for phrases, form in ((rules.FORM16_PHRASES, "form16"), (rules.FORM12BB_PHRASES, "form12bb")):
        if has(h, phrases):
            return "tax_form", form, None, 0.9, False
    if "fixed deposit" in h or re.search(r"\bfd\b", h):
        return "fd_report", bank, None, 0.84, False
    if has(h, rules.CERTIFICATE_PHRASES) or ("certificate" in h and has(h, rules.CERTIFICATE_WORDS)):
        return "interest_certificate", bank, None, 0.88, False
    if has(h, rules.INVESTMENT_PHRASES) or re.search(rules.INVESTMENT_WORDS, h):
        for phrases, kind, sure in ((rules.HOLDING_PHRASES, "demat_holdings", 0.9), (rules.GAIN_PHRASES, "demat_tax_report", 0.93), (rules.TRADE_PHRASES, "demat_trade_report", 0.93), (("dividend",), "dividend_report", 0.88), (("",), "demat_holdings", 0.86)):
            if has(h, phrases):
                return kind, None, None, sure, False
    if has(h, rules.BARE_GAIN_PHRASES):
        return "demat_tax_report", None, None, 0.86, False
    if has(h, rules.BARE_HOLDING_PHRASES):
        return "demat_holdings", None, None, 0.82, False
    score = lambda phrases: sum(3 if p.count(" ") >= 2 else 2 for p in phrases if p in t)
    card, acct = score(rules.CARD_PHRASES), score(rules.BANK_PHRASES) + ("statement" in t)
    one, two = ("credit_card_statement", bank, "credit_card"), ("bank_statement", bank, "bank_account")
    for base, least, gap in ((0.58, 8, 2), (0.62, 6, 0)):
        if base == 0.58 or bank:
            if card >= least and card >= acct + (gap or 1):
                return *one, min(0.97, base + min(card, 18) / 40), False
            if acct >= least and acct >= card + gap:
                return *two, min(0.97, base + min(acct, 18) / 40), False
    if bank and has(h, rules.CARD_NAMES):
        return *one, 0.76, False
    if bank and has(h, rules.BANK_NAMES):
        return *two, 0.74, False
    return "unknown_pdf", bank, None, 0.2, False


def test_classified(spark):
    rng = random.Random(5)
    lists = [v for k, v in vars(rules).items() if k.endswith("_PHRASES") or k in ("SHEET_TRADES", "SHEET_GAINS", "SHEET_HOLDINGS", "CARD_NAMES", "BANK_NAMES", "CERTIFICATE_WORDS", "HEADING_ENDS")]
    weights = [12 if v in (rules.CARD_PHRASES, rules.BANK_PHRASES) else 1 for v in lists]
    rows = []
    for k in range(1500):
        words = [rng.choice(rng.choice([rng.choices(lists, weights)[0], ("hello", "fd", "nse", "certificate", "Coins\r\nof", "\n" * 45)])) for _ in range(rng.choice([0, 1, 2, 6, 9]))]
        text = rng.choice([" ", "\n", "_"]).join(words)
        rows.append((k, rng.choice([f"a{k}.pdf", "X.PDF", "b.pdf", "c.csv", "my.xlsx", "d.doc", "none", None]), rng.choice([text.upper(), text, text]) or None, rng.choice([None, "", "HDFC"]),
                     rng.choice([None] * 12 + ["auto", "Savings-Statement", "fixed deposit", "what"]), rng.choice([None] * 9 + ["", "credit_card", "Savings"])))
    columns = "doc_id long, file_name string, text string, bank_hint string, document_type_hint string, account_type_hint string"
    got = {r["doc_id"]: tuple(r)[6:] for r in filing.classified(spark.createDataFrame(rows, columns)).collect()}
    seen = set()
    for r in rows:
        want, have = plain(*r[1:]), got[r[0]]
        assert have[:3] + have[4:] == want[:3] + want[4:] and abs(have[3] - want[3]) < 1e-9, (r, have, want)
        seen.add(want[:1] + want[3:])
    assert len({k for k, *_ in seen}) >= 13
    assert filing.classified(spark.createDataFrame([], columns)).count() == 0
