"""Card statements and passbooks: rows and metadata of their texts.

Sections are state machines over lines, as in ``statements``, so a document of any length is read by many tasks side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, money
from ..grammars import AXIS_DUES, AXIS_LIMITS, AXIS_LINES, BELOW, BELOW_AMOUNT, BELOW_DAY, BELOW_LINES, Card, Passbook
from ..tables import written
from .statements import OTHERS, Machine, any_of, continued, day, roles, text_lines
from .statements import step as section_step

#: Tolerance between a row's amount and what its balance moved.
NEAR = 0.02


def _gaps(state: tuple, letter: str) -> tuple[tuple, str]:
    """As sections of a savings statement, but a start ends the entry before it."""
    return ((False, False, 0), "") if letter == "S" else section_step(state, letter)


def _blocks(state: tuple[bool, int], letter: str) -> tuple[tuple, str]:
    """(inside, 0: no entry yet, 1: some, 2: one to go on with). A lower-case letter is a line that would also start a section; ``b`` is blank."""
    inside, had = state
    if not inside:
        return (letter != "b" and letter.islower(), had), ""
    if letter == "b":
        return (had == 0, had), ""
    kind = letter.upper()
    if kind == "E":
        return (False, had), ""
    if kind == "T":
        return (True, 2), "e"
    return ((True, 1), "m") if kind == "C" and had == 2 else (state, "")


def _open(state: tuple[bool], letter: str) -> tuple[tuple, str]:
    """One line at most goes on with an entry; ``X`` ends it, as a blank line does."""
    if letter == "T":
        return (True,), "e"
    if letter == "C" and state[0]:
        return (False,), "m"
    return ((False,) if letter in "bX" else state), ""


def _table(state: tuple[bool, bool], letter: str) -> tuple[tuple, str]:
    """(inside, an entry to go on with): once begun a table doesn't end."""
    inside, pending = state
    if letter == "S":
        return (True, pending), ""
    if inside and letter == "T":
        return (True, True), "e"
    return state, "m" if inside and pending and letter == "C" else ""


MACHINES = {
    "gaps": Machine([(False, None, 0), *((False, p, s) for p in (False, True) for s in range(OTHERS + 2))], "bSEHXDCT", _gaps),
    "blocks": Machine([(i, n) for i in (False, True) for n in range(3)], "bEHTCDehtcd", _blocks),
    "open": Machine([(False,), (True,)], "bHXTCD", _open),
    "table": Machine([(i, p) for i in (False, True) for p in (False, True)], "bSHTC", _table),
}


def _short(text: Column) -> Column:
    """A day's text with a month of three letters and without a comma."""
    return F.regexp_replace(text, r"([\s/\-.])([A-Za-z]{3})[A-Za-z]*,?([\s/\-.])\s*", "$1$2$3")


def _named(text: Column, as_of: date) -> Column:
    """A day whose month is a number or a name of any length, with or without a comma."""
    return dates.parse_date(F.regexp_replace(_short(text), r"\s+", " "), as_of)


def rows(documents: DataFrame, card: Card, as_of: date) -> DataFrame:
    """The rows of card statements (doc_id, text; ids don't repeat): doc_id, line_no, transaction_date, description, amount, direction.

    A row is a debit unless a plus sign or mark says otherwise. Of a bank whose sections end after gaps, a statement in whose sections there
    is no row is read without regard to them. Null and empty texts have no rows.
    """
    line, got = F.col("line"), F.col("_got")
    lines = text_lines(documents)
    # A shape is a whole line, so one pass makes a row its fields, each behind an end of line, which no line has.
    for k, (p, g) in enumerate(card.shapes):
        fields = F.regexp_replace(line, p + r"[\s\S]*", "".join(f"\n${n}" if n else "\n" for n in g))
        lines = lines.withColumn("_got", F.when(got.contains("\n"), got).otherwise(fields) if k else fields)
    lines = written(lines.withColumn("_got", F.when(got.contains("\n"), got)), "card-shapes")

    def field(n: int) -> Column:
        return F.nullif(F.get(F.split("_got", "\n"), F.lit(n + 1)), F.lit(""))

    # In steps: each expression below names those before it several times.
    lines = lines.withColumns({"_short": _short(field(0)), "_text": F.trim(field(1)), "_plus": field(2), "_amount": field(3), "_mark": F.upper(field(4)), "_row": got.isNotNull()}).drop("_got")
    lines = dates.dated(lines, "_day", F.regexp_replace("_short", r"\s+", " "), as_of).drop("_short").withColumn("_amount", money.parse_decimal(F.col("_amount")))
    good = F.col("_day").isNotNull() & (F.col("_amount") > 0)
    lines = lines.withColumns({"_start": any_of(line, card.starts), "_end": any_of(line, card.ends), "_skip": any_of(line, card.skips)})
    start, end, skip, row, digit = F.col("_start"), F.col("_end"), F.col("_skip"), F.col("_row"), line.rlike("^[0-9]")
    blank = F.when(line == "", "b")
    loose = blank.when(skip | end, "H").when(row, F.when(good, "T").otherwise("H")).when(digit, "D").otherwise("C")
    if card.course == "gaps":
        letter = blank.when(start, "S").when(end, "E").when(skip, "H").when(row, F.when(good, "T").otherwise("X")).when(digit, "D").otherwise("C")
    elif card.course == "blocks":
        letter = blank.when(end, "E").when(skip, "H").when(row, F.when(good, "T").otherwise("H")).when(digit, "D").otherwise("C")
        letter = F.when((line != "") & start, F.lower(letter)).otherwise(letter)
    else:
        # What begins as a row's date does and is no row leaves the entry before it as it is.
        dated = line.rlike("^" + card.shapes[0][0].split(r"\s+", 1)[0].removeprefix("^"))
        letter = blank.when(row, F.when(good, "T").otherwise("X")).when(dated, "D").when(end, "X").otherwise("C")
    kept = ["doc_id", "line_no", "line", "_day", "_text", "_plus", "_amount", "_mark"]
    lines = written(lines.select(*kept, letter.alias("letter"), (loose if card.course == "gaps" else F.lit(None).cast("string")).alias("_loose"), F.lit(0).alias("begins")), "card-letters")
    found = roles(lines.drop("_loose"), MACHINES[card.course])
    if card.course == "gaps":
        found = written(found, "card-roles")
        rest = lines.join(found.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("letter", F.col("_loose")).drop("_loose")
        found = found.unionByName(roles(rest, MACHINES["open"]))
    description = F.regexp_replace("_text", r"\s{2,}", " ") if card.tight else F.col("_text")
    credit = F.coalesce(F.col("_mark").isin(*card.credit_marks), F.lit(False)) | F.col("_plus").isNotNull()
    return continued(found).select(
        "doc_id", "line_no", F.col("_day").alias("transaction_date"), F.concat_ws(" ", description, "_more").alias("description"), F.col("_amount").alias("amount"), F.when(credit, "credit").otherwise("debit").alias("direction"),
    )


def _found(pattern: str, group: int = 1, text: str | Column = "text") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _masked(pattern_texts: list[Column]) -> Column:
    raw = F.regexp_replace(F.coalesce(*pattern_texts), r"\s", "")
    return F.nullif(F.when(F.length(raw) >= 4, F.concat(F.lit("XXXX XXXX XXXX "), F.right(raw, F.lit(4)))).otherwise(raw), F.lit(""))


def _below(lines: Column, labels: tuple[str, ...], ahead: int, value: Callable[[Column], Column], first_only: bool = False) -> Column:
    """The first value of the lines that follow one with all the labels."""
    has = lambda s: F.coalesce(*[F.when(~F.upper(s).contains(x), F.lit(False)) for x in labels], F.lit(True))
    marked = F.filter(F.transform(lines, lambda s, i: F.when(has(s), i)), lambda i: i.isNotNull())
    if first_only:
        marked = F.slice(marked, 1, 1)
    seen = F.flatten(F.transform(marked, lambda i: F.transform(F.slice(lines, i + 2, ahead), value)))
    return F.get(F.filter(seen, lambda v: v.isNotNull()), F.lit(0))


def _nth_amount(nth: int, least: int, without: str | None) -> Callable[[Column], Column]:
    """The nth amount of a line that has at least so many and not that word."""

    def value(line: Column) -> Column:
        got = F.transform(F.regexp_extract_all(line, F.lit(BELOW_AMOUNT)), lambda a: money.parse_decimal(a))
        got = F.when(F.size(got) >= least, F.get(got, F.lit(nth - 1)))
        return F.when(~F.upper(line).contains(without), got) if without else got

    return value


def metadata(documents: DataFrame, card: Card, as_of: date) -> DataFrame:
    """doc_id, account_masked, period_start, period_end, due_date and the amounts total_due, minimum_due, credit_limit, available_limit,
    previous_balance and payments_received as the text states them; null where it doesn't, and of null texts."""
    steps: list[dict[str, Column]] = [{}, {}, {}]

    def kept(at: int, value: Column) -> Column:
        """The value worked out once, in one of three steps: expressions name their texts many times over, and would read them as often."""
        name = f"_{at}_{len(steps[at])}"
        steps[at][name] = value
        return F.col(name)

    found = lambda p, g=1, text="text", at=0: F.nullif(kept(at, F.regexp_extract(text, p, g)), F.lit(""))
    named = lambda text: kept(2, _named(text, as_of))
    number = lambda ps: F.coalesce(*(money.parse_decimal(found(p)) for p in ps), F.lit(None).cast("decimal(14,2)"))
    none, no_day = F.lit(None).cast("decimal(14,2)"), F.lit(None).cast("date")
    out = {k: number(card.amounts.get(k, ())) for k in ("total_due", "minimum_due", "credit_limit", "available_limit", "previous_balance", "payments_received")}
    # A pair of days counts only if both can be read.
    pairs = []
    for p in card.periods:
        told = kept(0, F.regexp_extract("text", p, 0))
        pairs.append([named(_found(p, g, told)) for g in (1, 2)])
    periods = [F.coalesce(*(F.when(a.isNotNull() & b.isNotNull(), x) for (a, b) in pairs for x in [(a, b)[k]]), no_day) for k in (0, 1)]
    due = F.coalesce(*(named(found(p)) for p in card.due), no_day)
    head, top = F.substring_index("text", "\n", {"gaps": BELOW_LINES, "open": AXIS_LINES}.get(card.course, 1)), F.col("_top")
    if card.course == "gaps":
        stated = named(found(r"(?i)Statement\s*Date\s*[:\-]?\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"))
        periods = [F.coalesce(periods[0], F.date_sub(stated, 30)), F.coalesce(periods[1], stated)]
        for name, labels, ahead, without, nth in BELOW:
            least = 2 if name.endswith("_limit") else 1
            out[name] = F.coalesce(out[name], _below(top, labels, ahead, _nth_amount(nth, least, without)))
        due = F.coalesce(due, _below(top, ("MINIMUM DUE", "DUE DATE"), 5, lambda s: _named(_found(BELOW_DAY, 1, s), as_of)))
    account = [found(p, 1, "_head" if card.course == "open" else "text") for p in card.card]
    if card.course == "open":
        whole = lambda pattern: lambda s: F.when(s.rlike(pattern), s)
        dues, limits = (kept(0, _below(top, labels, 3, whole(p), first_only=True)) for labels, p in (AXIS_DUES, AXIS_LIMITS))
        part = lambda s, p, k: found(p, k, s, 1)
        out |= {"total_due": money.parse_decimal(part(dues, AXIS_DUES[1], 1)), "minimum_due": money.parse_decimal(part(dues, AXIS_DUES[1], 2))}
        out |= {"credit_limit": money.parse_decimal(part(limits, AXIS_LIMITS[1], 2)), "available_limit": money.parse_decimal(part(limits, AXIS_LIMITS[1], 3)), "previous_balance": none, "payments_received": none}
        periods, due = [named(part(dues, AXIS_DUES[1], k)) for k in (3, 4)], named(part(dues, AXIS_DUES[1], 5))
        account.append(part(limits, AXIS_LIMITS[1], 1))
    rows = documents.select("doc_id", "text", head.alias("_head")).withColumn("_top", F.split("_head", "\n"))
    for k, values in enumerate(steps):
        rows = rows.select(*rows.columns, *(c.alias(n) for n, c in values.items()))
    return rows.select("doc_id", _masked(account).alias("account_masked"), periods[0].alias("period_start"), periods[1].alias("period_end"), due.alias("due_date"), *(c.alias(k) for k, c in out.items()))


def widened(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Metadata whose period holds all rows of its statement."""
    span = entries.groupBy("doc_id").agg(F.min("transaction_date").alias("_first"), F.max("transaction_date").alias("_last"))
    return meta.join(span, "doc_id", "left").withColumns({"period_start": F.least("period_start", "_first"), "period_end": F.greatest("period_end", "_last")}).drop("_first", "_last")


def passbook_rows(documents: DataFrame, grammar: Passbook) -> DataFrame:
    """The rows of passbook statements (doc_id, text; ids don't repeat): doc_id, line_no, place (its order in time), transaction_date, posting_date,
    description, reference, amount, direction, balance.

    A statement whose first row is later than its last is newest first. A row is a credit or debit as the balance rose or fell by its amount since the row
    before it in time, else a credit where its words say so. Null and empty texts have no rows.
    """
    start = r"^(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}) (.+)$"
    only = r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}$"
    exact = lambda t: F.when(t.rlike(r"^(\d{1,2}/\d{1,2}/|\d{1,2}-\d{1,2}-)(\d{2}|\d{4})$"), day(t))
    last_of = lambda words, p: F.size(words) - F.array_position(F.reverse(F.transform(words, lambda w: w.rlike(p))), True) + 1
    without = lambda words, at: F.filter(words, lambda _, i: i + 1 != at)
    lines = text_lines(documents).withColumn("line", F.regexp_replace("line", r"\s+", " "))
    lines = lines.withColumns({"_day": exact(_found(start, 1, "line")), "_words": F.split(_found(start, 2, "line"), " ")}).withColumn("_many", F.size("_words") >= 3)
    lines = lines.withColumn("_posted", F.when(F.get("_words", F.lit(0)).rlike(only), F.get("_words", F.lit(0))))
    lines = lines.withColumn("_words", F.when(F.col("_posted").isNotNull(), F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))).otherwise(F.col("_words")))
    lines = lines.withColumn("_at", last_of(F.col("_words"), grammar.balance)).withColumns({"_balance": F.get("_words", F.col("_at") - 1), "_words": without(F.col("_words"), F.col("_at"))})
    lines = lines.withColumn("_at", last_of(F.col("_words"), grammar.amount)).withColumns({"_amount": F.get("_words", F.col("_at") - 1), "_words": without(F.col("_words"), F.col("_at"))})
    bare = lambda c: money.parse_decimal(F.regexp_replace(c, r"(?i)(cr|dr)$", ""))
    balance = F.when(F.lower("_balance").endswith("dr"), -bare("_balance")).otherwise(bare("_balance"))
    row = F.col("_day").isNotNull() & F.col("_many") & F.col("_balance").isNotNull() & F.col("_amount").isNotNull()
    letter = (
        F.when(F.col("line") == "", "b").when(any_of(F.col("line"), grammar.starts), "S").when(any_of(F.col("line"), grammar.skips), "H")
        .when(F.coalesce(row, F.lit(False)), "T").when(F.lower("line").startswith("total"), "H").otherwise("C")
    )
    lines = lines.select("doc_id", "line_no", "line", "_day", exact(F.col("_posted")).alias("_posted"), F.array_join("_words", " ").alias("_text"), bare("_amount").alias("_amount"), balance.alias("_balance"), letter.alias("letter"), F.lit(0).alias("begins"))
    found = written(continued(roles(written(lines, "passbook-letters"), MACHINES["table"])), "passbook-rows")
    ends = found.groupBy("doc_id").agg((F.min_by("_day", "line_no") > F.max_by("_day", "line_no")).alias("_down"))
    ordered = found.join(ends, "doc_id").withColumn("place", F.when(F.col("_down"), -F.col("line_no")).otherwise(F.col("line_no")))
    moved = F.col("_balance") - F.lag("_balance").over(W.partitionBy("doc_id").orderBy("place"))
    description = F.trim(F.concat_ws(" ", "_text", "_more"))
    told = any_of(F.upper(description), tuple(f"\\Q{w}\\E" for w in grammar.credit_words))
    credit = F.when(F.abs(F.abs(moved) - F.col("_amount")) <= F.lit(NEAR).cast("decimal(4,2)"), moved > 0).otherwise(told)
    return ordered.select(
        "doc_id", "line_no", "place", F.col("_day").alias("transaction_date"), F.col("_posted").alias("posting_date"), description.alias("description"), _found(grammar.reference, 1, description).alias("reference"),
        F.col("_amount").alias("amount"), F.when(credit, "credit").otherwise("debit").alias("direction"), F.col("_balance").alias("balance"),
    )


def passbook_metadata(documents: DataFrame, grammar: Passbook, entries: DataFrame) -> DataFrame:
    """doc_id, account_masked, period_start, period_end, opening_balance and closing_balance; balances that the text doesn't state are those before the
    first and after the last of its rows (``passbook_rows``) in time."""
    whole = F.upper(F.regexp_replace(_found(grammar.account), r"\s+", ""))
    digits = F.regexp_replace(whole, r"[^0-9]", "")
    account = F.nullif(F.when(whole.rlike("[X*]"), whole).when(F.length(digits) >= 4, F.concat(F.repeat(F.lit("X"), F.length(digits) - 4), F.right(digits, F.lit(4)))).otherwise(whole), F.lit(""))
    stated = lambda kind: money.parse_decimal(_found(rf"(?i){kind}\s+Balance\s*[:\-]?\s*(?:Rs\.?\s*|INR\s*|₹\s*)?([\d,]+\.?\d*)"))
    before = F.col("balance") - F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    span = entries.groupBy("doc_id").agg(F.min_by(before, "place").alias("_opening"), F.max_by("balance", "place").alias("_closing"))
    period = lambda g: day(_found(grammar.period, g))
    meta = documents.select("doc_id", account.alias("account_masked"), period(1).alias("period_start"), period(2).alias("period_end"), stated("Opening").alias("_o"), stated("Closing").alias("_c"))
    return meta.join(span, "doc_id", "left").select("doc_id", "account_masked", "period_start", "period_end", F.coalesce("_o", "_opening").cast("decimal(14,2)").alias("opening_balance"), F.coalesce("_c", "_closing").alias("closing_balance"))
