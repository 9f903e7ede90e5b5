"""Statement text into sections, rows and metadata.

Whether a line belongs to a section depends on all lines before it: markers open and close sections, so do gaps, and a line
that is no row goes on with the row before it. Each line is a letter, and a letter is a table
from state to state. Tables compose, and composition is associative: a range of lines of one document is one table. So lines are
range-sorted and dealt over tasks whatever document they are of; a task composes the tables of the first and last document that it
has (all others are whole in it), the driver joins these, two a task, into the states in which ranges begin, and a second pass runs the ranges
side by side. A document of a million lines is read by as many tasks as its lines need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from ..grammars import ACCOUNT, BALANCE, PERIODS, Card, Grammar, Passbook
from ..tables import written

#: Blank lines and others that a section bears before it ends.
BLANKS, OTHERS = 3, 8
#: Lines that one task folds at once.
PIECE = 200_000
#: Outside, or inside with or without an entry to go on with and a streak of lines that are none; and whether a balance is known.
STATES = [(known, pending, streak) for known in (False, True) for pending, streak in [(None, 0), *((p, s) for p in (False, True) for s in range(OTHERS + 2))]]
AT = {s: k for k, s in enumerate(STATES)}
LETTERS = "bSEHXDCTKB"


def step(state: tuple, letter: str) -> tuple[tuple, str]:
    """The state after a line, and what the line is: ``e`` an entry, ``m`` more of the entry before it, or nothing.

    Letters: ``b`` blank, ``S`` and ``E`` a section's start and end, ``H`` a heading, ``T`` and ``K`` rows without and with a balance,
    ``B`` a row that counts only if a balance is known, ``X`` one that can't be read, ``D`` and ``C`` others that begin with a digit or don't.
    """
    known, pending, streak = state
    out, more = (known, None, 0), min(streak + 1, OTHERS + 1)
    if letter == "S":
        return (known, bool(pending), 0), ""
    if pending is None or letter == "H" or (letter == "B" and not known):
        return state, ""
    if letter == "b":
        return (out if more > BLANKS else (known, False, more)), ""
    if letter == "E":
        return out, ""
    if letter in "TKB":
        return (known or letter != "T", True, 0), "e"
    if letter == "X":
        return (known, pending, more), ""
    if letter == "C" and pending:
        return (known, True, 0), "m"
    return (out if more > OTHERS else (known, False, more)), ""


class Machine:
    """What each letter makes of each state, and what it says in it."""

    def __init__(self, states: Sequence[tuple], letters: str, step: Callable[[tuple, str], tuple[tuple, str]]) -> None:
        self.states, self.at = states, {s: k for k, s in enumerate(states)}
        self.moves, self.says = {}, {}
        for letter in letters:
            got = [step(s, letter) for s in states]
            self.moves[letter] = bytes([self.at[s] for s, _ in got]) + bytes(256 - len(states))
            self.says[letter] = "".join(x or "-" for _, x in got).encode()
        #: Letters that can begin an entry.
        self.entries = "".join(x for x in letters if b"e" in self.says[x])


SECTIONS = Machine(STATES, LETTERS, step)


def roles(lines: DataFrame, machine: Machine = SECTIONS) -> DataFrame:
    """Lines (doc_id, line_no, letter, begins: the state's number at the document's start, further columns) that are entries or go on with one, with
    ``entry``, the line number of the entry. Rows that repeat a document's line number are in no set order."""
    count, moves, says, entries = len(machine.states), machine.moves, machine.says, machine.entries
    row = F.monotonically_increasing_id()
    order = [F.col("doc_id").cast("string").asc_nulls_first(), F.col("line_no")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(row, 33).cast("int"), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))})
    # A file is a piece of a range and has one row group, so a task reads it whole and in order, whatever else it reads.
    dealt = written(dealt, "statement-lines", maxRecordsPerFile=PIECE, **{"parquet.block.size": 1 << 30})

    def whole(pdf: pd.DataFrame) -> Iterator[tuple]:
        """Rows with the piece that they are of, and whether they are its first."""
        for part, at, *rest in zip(*(pdf[c].tolist() for c in ("_part", "_row", "_doc", "line_no", "letter", "begins"))):
            yield (part, at // PIECE), at % PIECE == 0, *rest

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, piece, now = [], None, None
        for pdf in batches:
            for of, head, doc, line, letter, begins in whole(pdf):
                if of != piece:
                    if not head:
                        raise ValueError("a piece of lines was cut")
                    made, now = made + ([now] if now else []), None
                    piece, kin = of, 0
                if now is None or doc != now[2]:
                    # Of the documents of a piece the first and the last may go on elsewhere.
                    made, kin = made + ([now] if now and now[7] == 0 else []), kin + (now is not None)
                    now = [*of, doc, line, bytes(range(count)), [-1] * count, begins, kin]
                if letter in entries:
                    said = says[letter]
                    now[5] = [line if said[s] == 101 else at for s, at in zip(now[4], now[5])]
                now[4] = now[4].translate(moves[letter])
        yield pd.DataFrame([x[:7] for x in made + ([now] if now else [])], columns=["part", "piece", "doc", "line", "moves", "last", "begins"])

    doc = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("")).alias("_doc")
    state_columns = [doc, "line_no", "letter", "begins", "_part", "_row"]
    edges = dealt.select(*state_columns).mapInPandas(compose, "part int, piece long, doc string, line long, moves binary, last array<long>, begins int")
    starts: dict[tuple, tuple[int, int]] = {}
    before: dict[str, tuple[int, int]] = {}
    for e in sorted(edges.collect(), key=lambda e: (e["part"], e["piece"], e["line"])):  # two rows a piece at most
        state, last = before.get(e["doc"], (e["begins"], -1))
        starts[e["part"], e["piece"], e["doc"]] = state, last
        before[e["doc"]] = e["moves"][state], max(last, e["last"][state])
    shared = lines.sparkSession.sparkContext.broadcast(starts)
    columns = [c for c in lines.columns if c not in ("letter", "begins")]
    schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, last = None, 0, -1
        for pdf in batches:
            keep, entry = [], []
            for k, (piece, _, doc, line, letter, begins) in enumerate(whole(pdf)):
                if (piece, doc) != now:
                    now, (state, last) = (piece, doc), shared.value.get((*piece, doc), (begins, -1))
                said = says[letter][state]
                state = moves[letter][state]
                if said != 45:
                    last = line if said == 101 else last
                    keep.append(k)
                    entry.append(last)
            yield pdf.iloc[keep][columns].assign(entry=entry)

    return dealt.select(*(c for c in columns if c != "line_no"), *state_columns).mapInPandas(run, f"{schema}, entry long")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def day(text: Column) -> Column:
    """Day, month and a year of two or four digits; null if there is no such day."""
    part = F.split(F.replace(text, F.lit("-"), F.lit("/")), "/")
    year = part[2].cast("int")
    whole = F.when(F.length(part[2]) == 4, year).when(F.length(part[2]) == 2, year + F.when(year >= 69, 1900).otherwise(2000))
    return F.try_to_date(F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0")), "yyyy-MM-dd")


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, account_masked, period_start, period_end, opening_balance and closing_balance as the whole text states them; null where it doesn't."""
    found = lambda p, g=1: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    account = F.replace(found(ACCOUNT), F.lit(" "), F.lit(""))
    hidden = F.concat(F.repeat(F.lit("X"), F.length(account) - 4), F.right(account, F.lit(4)))
    amount = lambda kind: money.parse_decimal(found(BALANCE.format(kind)))
    period = lambda g: F.coalesce(*(day(found(p, g)) for p in PERIODS))
    return documents.select("doc_id", hidden.alias("account_masked"), period(1).alias("period_start"), period(2).alias("period_end"), amount("Opening").alias("opening_balance"), amount("Closing").alias("closing_balance"))


def detected(documents: DataFrame, grammar: Grammar | Card | Passbook) -> DataFrame:
    """The documents that are statements of the grammar's bank."""
    text = F.coalesce("text", F.lit(""))
    yes = ~any_of(text, grammar.lacks)
    for p in grammar.has:
        yes = yes & text.rlike(p)
    return documents.where(yes)


def rows(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of statements (doc_id, text; ids don't repeat): doc_id, line_no, transaction_date, posting_date, description, amount, direction, balance.

    Rows are looked for within sections; a statement in whose sections there is none is read without regard to them. A row with
    one amount before its balance, or with two, is a credit or debit as the balance rose or fell since the row before it, else as the words tell. Null
    and empty texts have no rows.
    """
    opening = written(metadata(documents).select("doc_id", "opening_balance"), "statement-openings")
    lines = text_lines(documents)
    line, shapes = F.col("line"), grammar.shapes
    fits = F.coalesce(*(F.when(line.rlike(p), F.lit(k)) for k, (_, p, _) in enumerate(shapes)), F.lit(-1))
    lines = written(lines.withColumn("_shape", fits).join(opening, "doc_id"), "statement-shapes")

    def field(n: int) -> Column:
        return F.coalesce(*(F.when(F.col("_shape") == k, F.nullif(F.regexp_extract("line", p, g[n]), F.lit(""))) for k, (_, p, g) in enumerate(shapes) if g[n]), F.lit(None).cast("string"))

    cash = lambda n: money.parse_decimal(field(n))
    named = lines.withColumns({"_day": day(field(0)), "_posted": day(field(1)), "_text": field(2), "_debit": cash(3), "_credit": cash(4), "_balance": cash(5), "_mark": F.upper(field(6))})
    debit, credit, two = F.coalesce("_debit", F.lit(0)) > 0, F.coalesce("_credit", F.lit(0)) > 0, F.col("_shape").isin([k for k, s in enumerate(shapes) if s[2][4]])
    bad = F.lit("X" if grammar.bad_rows_count else "H")
    row = (
        F.when(F.col("_day").isNull(), bad).when(two & debit & credit, "K" if grammar.both_without_balance else "B").when(two & (debit | credit), "K").when(two, "H")
        .when(~debit, bad).when(F.col("_balance").isNotNull(), "K").otherwise("T")
    )
    letter = (
        F.when(line == "", "b").when(any_of(line, grammar.starts), "S").when(any_of(line, grammar.ends), "E").when(any_of(line, grammar.skips), "H")
        .when(F.col("_shape") >= 0, row).when(line.rlike("^[0-9]"), "D").otherwise("C")
    )
    begins = F.when(F.col("opening_balance").isNull(), AT[False, None, 0]).otherwise(AT[True, None, 0])
    kept = ["doc_id", "line_no", "line", "_day", "_posted", "_text", "_debit", "_credit", "_balance", "_mark", "opening_balance"]
    named = written(named.select(*kept, letter.alias("letter"), begins.alias("begins"), row.alias("_row")), "statement-letters")
    found = written(roles(named.drop("_row")), "statement-roles")
    # Statements without a row in any section: their rows alone count, as if all were one section.
    rest = named.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    alone = (F.length("line") >= 15) & F.col("_row").isin("T", "K", "B") & ~any_of(F.col("line"), grammar.skips)
    inside = F.when(F.col("opening_balance").isNull(), AT[False, False, 0]).otherwise(AT[True, False, 0])
    rest = rest.where(alone).withColumns({"letter": F.col("_row"), "begins": inside}).drop("_row")
    return _entries(found.unionByName(roles(rest)), grammar)


def continued(found: DataFrame) -> DataFrame:
    """The entries of what ``roles`` gives, with ``_more``: the lines that go on with them, in order."""
    more = found.where("line_no <> entry").groupBy("doc_id", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("_more"))
    return found.where("line_no = entry").join(more, ["doc_id", "entry"], "left")


def text_lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no from 1 and the trimmed line of texts that aren't null."""
    lines = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumns({"line_no": (F.col("line_no") + 1).cast("long"), "line": F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))})


def _entries(found: DataFrame, grammar: Grammar) -> DataFrame:
    own = continued(found)
    last = F.last("_balance", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("_before", F.coalesce(last, "opening_balance"))
    debit, credit = F.coalesce("_debit", F.lit(0)) > 0, F.coalesce("_credit", F.lit(0)) > 0
    rose = F.col("_balance") >= F.col("_before") if grammar.equal_is_credit else F.col("_balance") > F.col("_before")
    told = any_of(F.upper("_text"), tuple(f"\\Q{w}\\E" for w in grammar.credit_words))
    side = (
        F.when(F.col("_mark").isNotNull(), F.col("_mark").isin("CR", "C")).when(credit & ~debit, True).when(credit, F.coalesce(rose, F.lit(False)))
        .when(F.col("_credit").isNotNull(), False).otherwise(F.coalesce(F.col("_balance") > F.col("_before"), told))
    )
    description = F.concat_ws(" ", F.regexp_replace(F.trim("_text"), r"\s{2,}", " "), "_more")
    return own.withColumn("_in", side).select(
        "doc_id", "line_no", F.col("_day").alias("transaction_date"), F.col("_posted").alias("posting_date"), description.alias("description"),
        F.when(F.col("_in") & credit, F.col("_credit")).otherwise(F.col("_debit")).alias("amount"), F.when(F.col("_in"), "credit").otherwise("debit").alias("direction"), F.col("_balance").alias("balance"),
    )


def opening_from_rows(entries: DataFrame) -> DataFrame:
    """doc_id and opening_balance of statements that don't state one: the first row's balance less what it brought, or with what it took."""
    first = entries.groupBy("doc_id").agg(F.min(F.struct("line_no", "balance", "amount", "direction")).alias("f")).select("doc_id", "f.*")
    return first.where("balance IS NOT NULL AND amount IS NOT NULL").select("doc_id", F.when(F.col("direction") == "credit", F.col("balance") - F.col("amount")).otherwise(F.col("balance") + F.col("amount")).alias("opening_balance"))
