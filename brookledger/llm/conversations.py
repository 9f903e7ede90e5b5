"""Conversation structure repair by signature deduplication.

1. Rows are read in the order of (turn, role, digest). What the repair needs to know of a row
   is one letter: its role's initial, in upper case if its text breaks off, or ``x``
   if the row must go. A conversation is the string of its letters, its signature.
   Texts don't move for this: slim rows are sorted by conversation and streamed
   through the tasks, so a conversation costs a byte a row and never its texts.
2. Each distinct signature is solved once, by a memoised recursion over its rows
   and the states of the grammar ``(s?(ua)+)?``; the answer is an audit, one letter an edit.
   A third of all conversations may have one signature: signatures are grouped
   before they are solved.
3. Audits are joined back, and each conversation's edits are replayed over its rows as
   they stream by in order behind its audit. Only here do texts shuffle, once.

From each state a letter leads to one other state, and the edits of a row begin with different
letters, so ties are settled by the first letter alone. Two insertions in a row
never pay: without them the string stays legal, but for a lone ``s``, whose deletion is cheaper.

Defined results: a null role, text, turn or id counts as one space where strings are made
of it; null ids are one conversation; null turns come first; rows of one turn are read by
role and then by a digest of role and text; a role with another initial is rerolled or
deleted; an empty table gives an empty result; further columns are ignored. Turns must
be whole numbers. A conversation's rows are replayed in one task, as its digest is serial, but
only one batch of them is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What an undeleted row whose text breaks off costs besides.
BROKEN = 5
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = {"u": "user", "a": "assistant"}
#: State and initial -> next state; states: nothing yet, after s, after u, after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The initial that comes next in a state, of a row that is rerolled or inserted.
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
FINAL = (0, 3)


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _plain(conv_col: str, turn_col: str, role_col: str, text_col: str) -> list[Column]:
    return [F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _spaced(role_col).alias("role"), _spaced(text_col).alias("text")]


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties the text, 2 takes its
    ``.!?``, 3 repeats, 4 makes the role user."""
    fault = F.crc32(F.concat(_spaced(conv_col), F.lit(":"), _spaced(turn_col))) % 20
    rows = df.select(fault.alias("_fault"), F.struct(*_plain(conv_col, turn_col, role_col, text_col)).alias("_row")).where("_fault <> 0").select("_fault", "_row.*")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))))
    return rows.drop("col")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def signatures(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): its signature, how many rows are
    blank, duplicate or truncated, gaps of its turns and illegal neighbours. ``ids``: conversations that are listed even without rows."""
    kind = rows.schema["conv_id"].dataType
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(F.col("conv_id").cast("string").alias("_c"), "turn", "role", _digest().alias("_d"), (bare == "").alias("_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("_cut"))
    nth = F.row_number().over(W.partitionBy("_c", "_d").orderBy(F.asc_nulls_first("turn")))
    slim = slim.withColumn("_again", nth).select("_c", "turn", F.substring("role", 1, 1).alias("_i"), "role", "_d", "_again", "_blank", "_cut", F.lit(True).alias("_real"))
    if ids is not None:
        slim = slim.unionByName(ids.select(F.col("conv_id").cast("string").alias("_c"), F.lit(False).alias("_real")).distinct(), allowMissingColumns=True)
    order = [F.asc_nulls_first("_c"), F.asc_nulls_first("turn"), F.col("role"), F.col("_d"), F.col("_again")]
    columns = "conv_id string, signature string, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Summary | None = None
        for pdf in batches:
            out = []
            for conv, part in _parts(pdf):
                if now is None or now.conv != conv:
                    out += [now.row()] if now else []
                    now = Summary(conv)
                now.add(part)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])
        if now:
            yield pd.DataFrame([now.row()], columns=[c.split()[0] for c in columns.split(", ")])

    sorted_rows = slim.repartition("_c").sortWithinPartitions(*order).select("_c", F.col("turn").cast("string").alias("turn"), "_i", "_again", "_blank", "_cut", "_real")
    return sorted_rows.mapInPandas(of, columns).withColumn("conv_id", F.col("conv_id").cast(kind))


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[str | None, pd.DataFrame]]:
    """Runs of rows of one conversation."""
    conv = [None if pd.isna(c) else c for c in pdf["_c"].tolist()]
    start = 0
    for k in range(1, len(conv) + 1):
        if k == len(conv) or conv[k] != conv[start]:
            yield conv[start], pdf.iloc[start:k]
            start = k


class Summary:
    """What is known of a conversation whose rows come in order."""

    def __init__(self, conv: str | None):
        self.conv, self.signature, self.n = conv, [], 0
        self.blank = self.duplicate = self.truncated = self.legal = self.turns = 0
        self.first = self.last = None
        self.before = ""  # the initial of the row before

    def add(self, part: pd.DataFrame) -> None:
        real = part[part["_real"].astype(bool)]
        for turn, initial, again, blank, cut in zip(real["turn"].tolist(), real["_i"].tolist(), real["_again"].tolist(), real["_blank"].tolist(), real["_cut"].tolist()):
            self.n += 1
            if isinstance(turn, str) and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            self.legal += self.before + initial in ("su", "ua", "au")
            self.before = initial
            letter = initial if initial in ("s", "u", "a") else "o"
            if blank or again > 1:
                self.blank, self.duplicate, letter = self.blank + blank, self.duplicate + (not blank), "x"
            elif cut:
                self.truncated, letter = self.truncated + 1, letter.upper()
            self.signature.append(letter)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else int(self.last) - int(self.first) + 1 - self.turns
        return self.conv, "".join(self.signature), self.n, gaps, self.blank, self.duplicate, self.truncated, max(0, self.n - 1 - self.legal)


def solve(signature: str) -> tuple[int, str]:
    """The least cost of edits that make ``signature`` legal, and of these edits the ASCII-least letters.

    Costs are remembered for a row and the one behind it, edits as a byte for each row, state and whether it follows an insertion."""
    n = len(signature)
    memo: dict[tuple[int, int, bool], float] = {}
    edits = bytearray(8 * (n + 1))

    def led(k: int, state: int, edit: str) -> tuple[int, int, bool]:
        """Where an edit leads: row, state, and whether an insertion may follow."""
        if edit == DELETE:
            return k + 1, state, True
        if edit == KEEP:
            return k + 1, NEXT[state, signature[k].lower()], True
        return (k, NEXT[state, DUE[state]], False) if edit == INSERT else (k + 1, NEXT[state, DUE[state]], True)

    def best(k: int, state: int, may_insert: bool) -> float:
        """The cost of what is left from row ``k`` on."""
        key = k, state, may_insert
        if key not in memo:
            letter, options = signature[k : k + 1], [(float("inf"), "")]
            if not letter and state in FINAL:
                options = [(0, "")]
            if may_insert:
                options.append((COST[INSERT] + best(*led(k, state, INSERT)), INSERT))
            if letter:
                options.append((COST[DELETE] + best(*led(k, state, DELETE)), DELETE))
            if letter not in ("", "x"):
                for edit in (KEEP, REROLE) if (state, letter.lower()) in NEXT else (REROLE,):
                    options.append((COST[edit] + BROKEN * letter.isupper() + best(*led(k, state, edit)), edit))
            memo[key], edit = min(options)
            edits[8 * k + 2 * state + may_insert] = ord(edit or " ")
        return memo[key]

    for k in range(n, -1, -1):  # from the end, so that the recursion never runs deep
        for state in range(4):
            best(k, state, True), best(k, state, False)
            memo.pop((k + 2, state, True), None), memo.pop((k + 2, state, False), None)
    audit, at = [], (0, 0, True)
    while (edit := chr(edits[8 * at[0] + 2 * at[1] + at[2]])) != " ":
        audit.append(edit)
        at = led(at[0], at[1], edit)
    return int(best(0, 0, True)), "".join(audit)


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(s, *solve(s)) for s in pdf["signature"]], columns=["signature", "cost", "audit"])

    return signatures.select("signature").distinct().mapInPandas(of, "signature string, cost long, audit string")


class Replay:
    """Edits of one conversation, row by row."""

    def __init__(self, conv: str | None, audit: str):
        self.conv, self.audit, self.at, self.state, self.n = conv, audit, 0, 0, 0
        self.sha = hashlib.sha256()

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.state = NEXT[self.state, role[0]]
        self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.n += 1
        return self.conv, self.n - 1, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._put(INSERT, ROLES[DUE[self.state]], "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            yield self._put(edit, ROLES[DUE[self.state]] if edit == REROLE else role, text)


def _replayed(rows: DataFrame, audits: DataFrame, returns: str, repaired: bool) -> DataFrame:
    """Streams each conversation's rows behind its audit; gives the repaired rows, or one digest a conversation."""
    kind = audits.schema["conv_id"].dataType
    behind = rows.select(F.col("conv_id").cast("string").alias("_c"), F.lit(1).alias("_z"), "turn", "role", _digest().alias("_d"), "text")
    first = audits.select(F.col("conv_id").cast("string").alias("_c"), F.lit(0).alias("_z"), F.col("audit").alias("text"))
    both = first.unionByName(behind, allowMissingColumns=True).repartition("_c").sortWithinPartitions(F.asc_nulls_first("_c"), "_z", F.asc_nulls_first("turn"), "role", "_d")
    names = [c.split()[0] for c in returns.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Replay | None = None

        def ended() -> list[tuple]:
            if not now:
                return []
            rest = list(now.inserted())
            return rest if repaired else [(now.conv, now.sha.hexdigest())]

        for pdf in batches:
            out: list[tuple] = []
            for conv, z, role, text in zip(pdf["_c"].tolist(), pdf["_z"].tolist(), pdf["role"].tolist(), pdf["text"].tolist()):
                if z == 0:
                    out += ended()
                    now = Replay(None if pd.isna(conv) else conv, text)
                    continue
                got = list(now.row(role, text))
                out += got if repaired else []
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    return both.select("_c", "_z", "role", "text").mapInPandas(of, returns).withColumn("conv_id", F.col("conv_id").cast(kind))


def audited(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: ``signatures`` with cost and audit."""
    convs = stage(signatures(rows, ids), "conversation-signatures")
    answers = stage(solved(convs), "conversation-audits")
    return convs.join(answers, "signature")


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: conv_id, turn, role and text, as ``damaged`` gives them."""
    small_batches(rows.sparkSession)
    known = stage(audited(rows, ids), "conversation-reports")
    digests = _replayed(rows, known, "conv_id string, repaired_sha256 string", False).withColumnRenamed("conv_id", "_of")
    out = known.join(digests, known["conv_id"].eqNullSafe(digests["_of"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role and text of each row that stays or is inserted."""
    small_batches(df.sparkSession)
    rows = df.select(*_plain(conv_col, turn_col, role_col, text_col))
    return _replayed(rows, audited(rows), "conv_id string, place long, edit string, role string, text string", True).withColumnRenamed("conv_id", conv_col)
