"""Rule-based classification expressions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import money
from .text import choose, contains_any, first_group, first_rule, matches_any, says, statement_words


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def self_transfer(text: Column) -> Column:
    return says(text, rules.CHANNEL) & says(text, rules.SELF)


def card_bill(text: Column, direction: Column, account_type: Column) -> Column:
    """Whether a narration tells the payment of a card's bill."""
    explicit = says(text, rules.EXPLICIT_BILL)
    debit = explicit | (says(text, ("CARD PAYMENT",)) & (self_transfer(text) | says(text, rules.BANK_TOKENS))) | says(text, ("AUTOPAY", "BILLDESK"))
    by_side = (
        F.when((account_type == "credit_card") & (direction == "credit"), explicit | says(text, ("AUTOPAY",)))
        .when(direction == "credit", explicit)
        .when(direction == "debit", debit)
        .otherwise(False)
    )
    return says(text, rules.TELE_CREDIT) | (says(text, rules.CARD_PAYMENT) & by_side)


def nature(text: Column, direction: Column, account_type: Column) -> Column:
    """One of rules.NATURES; anything but a debit counts as a credit."""
    side, kind = F.lower(F.trim(F.coalesce(direction, F.lit("")))), F.lower(F.trim(F.coalesce(account_type, F.lit(""))))
    bill, own = card_bill(text, side, kind), self_transfer(text)
    debit = side == "debit"
    return choose(
        (debit & bill, "transfer_internal"), (debit & says(text, rules.INVESTMENT), "investment"), (debit & says(text, rules.TAX), "tax"),
        (debit & own, "transfer_internal"), (debit, "expense"),
        (says(text, rules.REFUND), "refund"), (says(text, rules.INTEREST), "interest_income"), (says(text, rules.DIVIDEND), "dividend_income"),
        (says(text, rules.SALARY), "income"), (bill | own, "transfer_internal"), (kind == "credit_card", "refund"),
        default="income",
    )


def category(description: Column) -> Column:
    return first_rule(description, rules.CATEGORY_RULES)


def category_of_web_text(text: Column) -> Column:
    return first_rule(text, rules.WEB_RULES)


def recurring_bucket(description: Column, category_name: Column) -> Column:
    text = F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(category_name, F.lit("")))
    return F.coalesce(*(F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in rules.RECURRING_RULES), F.lit("other"))


def transferish(description: Column) -> Column:
    return says(description, rules.TRANSFERISH)


def is_upi(description: Column) -> Column:
    return says(description, rules.UPI)


def is_reversal(description: Column) -> Column:
    return says(description, rules.REVERSAL)


def alias(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The name one of whose aliases the value is, else null."""
    bare = F.upper(F.trim(value))
    return F.coalesce(*(F.when(bare.isin(*names), F.lit(name)) for name, names in table.items()))


def bank_hint(text: Column) -> Column:
    """The bank whose words weigh most; those in the first 2500 characters weigh more. Ties go to the first name."""
    low = statement_words(text)
    head = F.substring(low, 1, 2500)
    scores = []
    for bank, words in rules.BANK_WORDS.items():
        score = reduce(lambda a, b: a + b, (F.when(head.contains(w), max(8, 6 * len(w.split()))).when(low.contains(w), 1).otherwise(0) for w in words))
        scores.append(F.struct((-score).alias("least"), F.lit(bank).alias("bank")))
    best = F.array_min(F.array(*scores))
    return F.when(best["least"] < 0, best["bank"])


def account_type_hint(text: Column) -> Column:
    low = statement_words(text)
    return F.when(contains_any(low, rules.CARD_CUES), "credit_card").when(contains_any(low, rules.BANK_CUES), "bank_account")


def extraction_source(parser_id: Column, ocr: Column) -> Column:
    low = F.lower(F.coalesce(parser_id, F.lit("")))
    return F.when(low.contains("vision"), "llm_vision").when(low.contains("llm"), F.when(_flag(ocr), "ocr_llm").otherwise("llm_text")).when(_flag(ocr), "ocr_llm").otherwise("template")


def codes(*checks: tuple[Column, str]) -> Column:
    """The codes whose condition holds."""
    return F.filter(F.array(*(F.when(_flag(c), F.lit(code)) for c, code in checks)), lambda x: x.isNotNull())


def validated(as_of: date, floor: float = rules.CONFIDENCE_FLOOR) -> list[dict[str, Column]]:
    """Columns for raw rows (txn_date, amount_raw, balance_raw, txn_type_raw, description_raw, confidence, period_start, period_end), in steps.

    Hard errors make a row invalid, then low confidence counts, then soft errors.
    """
    day, amount, balance, credit, description = (F.col(c) for c in ("txn_date", "_amount", "balance_after", "is_credit", "description"))
    read = {
        "_amount": money.parse_decimal(F.col("amount_raw")), "balance_after": money.parse_decimal(F.nullif(F.col("balance_raw"), F.lit("")), signed=True), "is_credit": money.credit_flag(F.col("txn_type_raw")),
        "description": F.trim(F.regexp_replace(F.coalesce(F.col("description_raw"), F.lit("")), r"\s+", " ")),
    }
    hard = codes(
        (day.isNull(), "date_parse_failed"), (day > F.lit(as_of), "date_not_future"), (F.year(day) < 1990, "date_not_before_1990"),
        (amount.isNull(), "amount_parse_failed"), (amount <= 0, "amount_positive"), (amount >= 100000000, "amount_not_absurd"),
        (amount.isNotNull() & ~money.at_most_two_decimals(F.col("amount_raw")), "amount_max_2_decimal"), (description == "", "description_required"),
    )
    soft = codes(
        (~day.between(F.col("period_start"), F.col("period_end")), "date_within_statement_period"),
        (balance < 0, "balance_negative"), (credit.isNull(), "cr_dr_resolved"),
    )
    status = F.when(F.size("_hard") > 0, "invalid").when(F.col("confidence") < floor, "low_confidence").when(F.size("_soft") > 0, "needs_review").otherwise("valid")
    return [read, {"_hard": hard, "_soft": soft}, {"amount": F.coalesce(amount, F.lit(0).cast("decimal(14,2)")), "validation_errors": F.concat("_hard", "_soft"), "validation_status": status}]


def review_reasons(confidence: Column, source: Column, amount: Column, walk_passed: Column, status: Column) -> Column:
    """Why an entry should be looked at."""
    ai = source.isin("llm_text", "llm_vision", "ocr_llm")
    return codes(
        (confidence < rules.CONFIDENCE_FLOOR, "low_confidence"), (ai, "ai_sourced"),
        ((amount > rules.LARGE_AMOUNT) & (ai | ~_flag(walk_passed)), "large_amount"), (status.isin("low_confidence", "needs_review"), "needs_review"),
        (walk_passed == F.lit(False), "balance_walk_failed"),
    )


def card_integrity(debit: Column, credit: Column, due: Column, previous: Column, closing: Column, rows: Column) -> dict[str, Column]:
    """Whether a card statement's rows agree with its totals."""
    net = F.round(debit - credit, 2)
    by_due = F.round(F.greatest(F.lit(500.0), F.abs(F.coalesce(due, F.lit(0.0))) * 0.10), 2)
    by_balance = F.round(F.greatest(F.lit(250.0), F.abs(F.coalesce(closing, F.lit(0.0))) * 0.02), 2)
    due_gap, full_gap = F.round(F.abs(due - net), 2), F.round(F.abs(due - F.round(previous + net, 2)), 2)
    closing_gap = F.round(F.abs(closing - F.round(previous + net, 2)), 2)
    ok = _flag(full_gap <= by_due) | _flag(due_gap <= by_due) | _flag(closing_gap <= by_balance)
    return {"net_activity": net, "due_gap": due_gap, "due_gap_with_previous": full_gap, "closing_gap": closing_gap, "status": F.when((rows > 0) & ok, "ok").otherwise("review")}


# --- SMS


def sender_id(address: Column) -> Column:
    strict = F.regexp_extract(address, r"(?i)^[A-Z]{2}-([A-Z]{4,8})(?:-[A-Z])?$", 1)
    loose = F.regexp_extract(address, r"(?i)([A-Z]{4,8})(?:-[A-Z])?$", 1)
    return F.upper(F.coalesce(F.nullif(strict, F.lit("")), F.nullif(loose, F.lit(""))))


def sender_bank(sender: Column) -> Column:
    """The bank of the sender id, or of the first known one that shares its longest prefix of at least four letters."""
    held = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    found = [held({name: bank for name, bank, _ in reversed(rules.SENDERS)}, sender)]
    for size in range(7, 3, -1):
        first = {name[:size]: bank for name, bank, _ in reversed(rules.SENDERS) if len(name) >= size}
        if first:
            found.append(held(first, F.when(F.length(sender) > size, F.substring(sender, 1, size))))
    return F.coalesce(*found)


def spam_score(address: Column, body: Column, sender: Column | None = None) -> Column:
    """0 to 100; ``sender`` is the address's ``sender_id`` where it is known."""
    sender = sender_id(address) if sender is None else sender
    points = lambda c, n: F.when(_flag(c), n).otherwise(0)
    urgent = reduce(lambda a, b: a + b, (points(body.rlike(p), 10) for p in rules.SPAM_URGENT))
    link = F.when(
        body.rlike("https?://"),
        F.when(body.rlike(r"(?i)bit\.ly|tinyurl|cutt\.ly|is\.gd|short\.url"), 25).when(~body.rlike("(?i)hdfc|icici|axis|sbi|kotak|yesbank"), 15).otherwise(0),
    ).otherwise(0)
    return F.least(
        F.lit(100),
        points(sender_bank(sender).isNull(), 40) + points(F.regexp_replace(address, r"[\s-]", "").rlike(r"^\+?91?\d{10}$"), 40)
        + link + F.least(urgent, F.lit(20)) + points(matches_any(body, rules.SPAM_SENSITIVE), 25)
        + points(matches_any(body, rules.SPAM_TEMPLATE), 40) + points(~matches_any(body, rules.SMS_AMOUNT), 10),
    )


def sms_class(address: Column, body: Column, score: Column | None = None) -> Column:
    """The kind of a message; ``score`` is its ``spam_score`` where it is known."""
    score = spam_score(address, body) if score is None else score
    amount, account = matches_any(body, rules.SMS_AMOUNT), body.rlike(rules.SMS_HAS_ACCOUNT)
    return choose(
        (score >= 50, "spam"), (matches_any(body, rules.SMS_OTP), "otp"), (matches_any(body, rules.SMS_PROMO) & ~account, "promo"),
        (matches_any(body, rules.SMS_DEBIT) & amount & account, "transaction_debit"), (matches_any(body, rules.SMS_CREDIT) & amount & account, "transaction_credit"),
        (amount & body.rlike("(?i)balance"), "balance_info"), default="unknown",
    )


def sms_parsed(address: Column, body: Column, sent: Column) -> dict[str, Column]:
    """What an SMS says; amount and the rest are null where nothing matches."""
    number = lambda patterns: F.regexp_replace(first_group(body, patterns), ",", "").try_cast("decimal(14,2)")
    amount, digits, reference = number(rules.SMS_AMOUNT), first_group(body, rules.SMS_ACCOUNT), first_group(body, rules.SMS_REFERENCE)
    points = lambda c, x: F.when(c.isNotNull(), x).otherwise(0.0)
    bank = sender_bank(sender_id(address))
    return {
        "sms_hash": F.sha2(F.concat_ws("|", F.coalesce(address, F.lit("")), F.coalesce(body, F.lit("")), sent.cast("string")), 256),
        "sender_id": F.coalesce(sender_id(address), F.lit("UNKNOWN")), "bank_name": F.coalesce(bank, F.lit("UNKNOWN")),
        "account_masked": F.concat(F.lit("XX"), digits), "amount": F.when(amount > 0, amount), "balance_after": number(rules.SMS_BALANCE),
        "reference_number": reference, "upi_id": first_group(body, rules.SMS_VPA), "description": F.substring(body, 1, 200),
        "confidence": F.least(F.lit(1.0), F.lit(0.5) + points(bank, 0.25) + points(digits, 0.1) + points(F.when(amount > 0, amount), 0.1) + points(reference, 0.05)),
    }
