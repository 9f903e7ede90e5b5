"""Matching joins over ledger rows.

Candidates come from an equi-join on the user, a bucket of the amount and a
bucket of the date, so a user with a third of all rows is still dealt over many
tasks. One-to-one assignment settles most pairs in a few rounds of joins and grouped minima, and
what depends on one another in chains by components of a bounded size.
"""

from __future__ import annotations

import bisect
import difflib
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, money
from ..functions.text import append_note
from ..tables import written
from .graph import components, folded
from .insights import active

#: Patterns by content that are broadcast at once.
RULES = 5000
#: Rounds of an assignment before components are looked for, and edges of a component that one task finishes.
ROUNDS, SMALL = 3, 200_000
#: Signs of a text that is compared side by side with others, and windows of texts that are looked at in one step.
SHORT, A_STEP = 199, 4096
#: What texts must exceed to be alike.
ALIKE = 0.6


def near(left: DataFrame, right: DataFrame, keys: Sequence[str], amount_gap: Decimal, days: int) -> DataFrame:
    """Pairs with equal keys (null equals null), amounts at most ``amount_gap`` and dates at most ``days`` apart.

    Both sides have ``amount`` and ``transaction_date``; columns come back as
    ``l_*`` and ``r_*``. A right row is copied to its own bucket and the two
    beside it, for amounts and for dates: nine slim copies, whatever the skew.
    """
    width = int(amount_gap * 100) + 1
    span = days + 1
    bucket = lambda df, c, d: df.withColumn("_a", F.floor(money.paise(F.col(c)) / width)).withColumn("_d", F.floor(F.datediff(F.col(d), F.lit("1970-01-01")) / span))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = bucket(left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)), "l_amount", "l_transaction_date")
    b = bucket(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), "r_amount", "r_transaction_date")
    # Equal amounts are in equal buckets.
    b = b.withColumn("_i", F.explode(around if amount_gap else F.array(F.lit(0)))).withColumn("_j", F.explode(around)).withColumn("_a", F.col("_a") + F.col("_i")).withColumn("_d", F.col("_d") + F.col("_j")).drop("_i", "_j")
    on = (a["_a"] == b["_a"]) & (a["_d"] == b["_d"])
    for k in keys:
        on &= F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    gap = F.datediff("r_transaction_date", "l_transaction_date")
    on &= (F.abs(money.paise(F.col("l_amount")) - money.paise(F.col("r_amount"))) <= int(amount_gap * 100)) & (F.abs(gap) <= days)
    return a.join(b, on).drop("_a", "_d").withColumn("gap", gap)


class Assignment(NamedTuple):
    """Chosen pairs (l, r); rounds it took; edges that were left for the pass by components."""

    pairs: DataFrame
    rounds: int
    grouped: int


def assignment(edges: DataFrame, rounds: int = ROUNDS, small: int = SMALL) -> Assignment:
    """Serial choice: lefts in the order of ``l_order`` each take the free right of least ``cost``.

    ``edges`` has l, r, l_order and cost, both orderable and without ties within a left (or right). All rights rank
    lefts alike, so a pair is settled where the right is the best of its left and the left is the first of all that
    might take it. Settled pairs leave with all their edges. After ``rounds`` of that, what depends on one another in long
    chains is left: components of up to ``small`` edges finish in one pass that folds each in order, and only
    larger ones go on in rounds, until they fall apart.
    """
    kinds = {c: edges.schema[c].dataType for c in ("l", "r")}
    edges, done, n, grouped = written(edges.select("l", "r", "l_order", "cost"), "edges"), [], 0, 0
    while (left := edges.count()) and (n < rounds or left > small):
        for _ in range(rounds):
            wish = edges.groupBy("l").agg(F.min(F.struct("cost", "r")).alias("w")).select("l", "w.r")
            first = edges.groupBy("r").agg(F.min(F.struct("l_order", "l")).alias("f")).select("r", "f.l")
            settled = written(wish.join(first, ["l", "r"]), "settled")
            done.append(settled)
            edges = written(edges.join(settled.select("l"), "l", "left_anti").join(settled.select("r"), "r", "left_anti"), "edges")
            n += 1
            if edges.isEmpty():
                break
        else:
            if edges.count() > small:
                node = lambda side: F.concat(F.lit(side), F.col(side).cast("string"))
                part = components(edges.select(node("l").alias("a"), node("r").alias("b")))
                edges = written(edges.withColumn("node", node("l")).join(part, "node").drop("node"), "edges")
                sizes = edges.groupBy("component").agg(F.count("*").alias("_size"))
                edges = edges.join(sizes, "component")
                some = written(edges.where(F.col("_size") <= small).drop("_size"), "edges-small")
                grouped += some.count()
                done.append(_serial(some, kinds))
                edges = written(edges.where(F.col("_size") > small).select("l", "r", "l_order", "cost"), "edges")
    if left:
        grouped += left
        done.append(_serial(edges.withColumn("component", F.lit("")), kinds))
    pairs = [d.select("l", "r") for d in done] or [edges.select("l", "r")]
    return Assignment(reduce(DataFrame.unionByName, pairs), n, grouped)


def _serial(edges: DataFrame, kinds: dict) -> DataFrame:
    """The serial loop within each component: edges by left and cost, each taken if both its ends are free."""

    def fold():
        lefts, rights = set(), set()

        def step(row: tuple[str, str]) -> list[tuple[str, str]]:
            if row[0] in lefts or row[1] in rights:
                return []
            lefts.add(row[0])
            rights.add(row[1])
            return [row]

        return step

    rows = edges.select("component", F.col("l").cast("string").alias("l"), F.col("r").cast("string").alias("r"), "l_order", "cost")
    out = folded(rows.select("component", "l", "r", F.struct("l_order", "l", "cost").alias("_o")), "component", [F.col("_o")], fold, "l string, r string", ["l", "r"])
    return out.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def one_to_one(edges: DataFrame) -> DataFrame:
    """The pairs (l, r) of ``assignment``."""
    return assignment(edges).pairs


def _same(column: str) -> Column:
    a, b = F.col(f"l_{column}"), F.col(f"r_{column}")
    return F.coalesce((a != "") & (b != "") & (a == b), F.lit(False))


def _points(condition: Column, n: str) -> Column:
    return F.when(condition, F.lit(Decimal(n))).otherwise(F.lit(Decimal("0.00")))


def transfer_pairs(ledger: DataFrame, days: int = rules.TRANSFER_DAYS) -> DataFrame:
    """Debits and credits that look like one transfer: debit_id, credit_id, user_id, amount, day_gap, confidence."""
    rows = ledger.select("txn_id", "user_id", "transaction_date", "amount", "direction", "bank_name", "account_type", "account_masked")
    pairs = near(rows.where("direction = 'debit'"), rows.where("direction = 'credit'"), ["user_id"], rules.TRANSFER_AMOUNT, days)
    gap = F.abs("gap")
    bank, kind, masked = _same("bank_name"), _same("account_type"), _same("account_masked")
    score = gap.cast("decimal(10,2)") + _points(bank, "1.50") + _points(masked, "2.00") + _points(kind, "1.00")
    confidence = F.lit(Decimal("0.92")) - gap * F.lit(Decimal("0.08")) - _points(bank, "0.10") - _points(kind, "0.05") - _points(masked, "0.15")
    pairs = written(
        pairs.select(
            F.col("l_txn_id").alias("l"), F.col("r_txn_id").alias("r"), F.struct("l_transaction_date", "l_txn_id").alias("l_order"),
            F.struct(score.alias("s"), F.col("r_transaction_date").alias("d"), F.col("r_txn_id").alias("i")).alias("cost"),
            F.col("l_user_id").alias("user_id"), F.col("l_amount").alias("amount"), gap.alias("day_gap"),
            F.greatest(F.least(confidence, F.lit(Decimal("0.99"))), F.lit(Decimal("0.30"))).cast("decimal(4,2)").alias("confidence"),
        ),
        "transfer-edges",
    )
    return pairs.join(one_to_one(pairs), ["l", "r"]).select(F.col("l").alias("debit_id"), F.col("r").alias("credit_id"), "user_id", "amount", "day_gap", "confidence")


def transfer_report(ledger: DataFrame, days: int = rules.TRANSFER_DAYS, newest: int | None = None) -> DataFrame:
    """By user: internal transfers, matched pairs, share matched and how many stand alone; of the ``newest`` transfers of each user, or of all if None."""
    rows = active(ledger).where("nature = 'transfer_internal'")
    if newest is not None:
        rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("transaction_date"), "txn_id"))).where(F.col("_place") <= newest).drop("_place")
    pairs = transfer_pairs(rows, days).groupBy("user_id").agg(F.count("*").alias("matched_pairs"))
    n = F.coalesce("matched_pairs", F.lit(0))
    return rows.groupBy("user_id").agg(F.count("*").alias("transfers")).join(pairs, "user_id", "left").select("user_id", "transfers", n.alias("matched_pairs"), F.round(2 * n / F.col("transfers"), 4).alias("match_rate"), (F.col("transfers") - 2 * n).alias("unmatched"))


def unmatched_transfers(ledger: DataFrame, pairs: DataFrame, newest: int | None = 300) -> DataFrame:
    """Internal transfers that no pair holds; of the ``newest`` of each user, or of all if None."""
    rows = active(ledger).where("nature = 'transfer_internal'")
    if newest is not None:
        rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("transaction_date"), "txn_id"))).where(F.col("_place") <= newest).drop("_place")
    held = pairs.select(F.col("debit_id").alias("txn_id")).unionByName(pairs.select(F.col("credit_id").alias("txn_id")))
    return rows.join(held, "txn_id", "left_anti")


def card_payment_pairs(ledger: DataFrame, days: int = 7) -> DataFrame:
    """Transfer-like pairs between a card and a bank account."""
    rows = active(ledger).where(classify.transferish(F.col("merchant_raw")))
    kinds = rows.select("txn_id", "account_type")
    both = transfer_pairs(rows, days).join(kinds.toDF("debit_id", "_debit"), "debit_id").join(kinds.toDF("credit_id", "_credit"), "credit_id")
    bank = ("savings", "current", "salary")
    return both.where((F.col("_debit").isin(*bank) & (F.col("_credit") == "credit_card")) | (F.col("_credit").isin(*bank) & (F.col("_debit") == "credit_card"))).drop("_debit", "_credit")


def upi_reversals(ledger: DataFrame) -> DataFrame:
    """Failed UPI debits with the credits that reverse them; newest debits choose first."""
    rows = active(ledger).where(classify.is_upi(F.col("merchant_raw"))).withColumn("_back", classify.is_reversal(F.col("merchant_raw")))
    rows = rows.select("txn_id", "user_id", "transaction_date", "amount", "direction", "_back")
    pairs = near(rows.where("direction = 'debit' AND NOT _back"), rows.where("direction = 'credit' AND _back"), ["user_id"], rules.UPI_AMOUNT, rules.UPI_DAYS)
    pairs = written(
        pairs.select(
            F.col("l_txn_id").alias("l"), F.col("r_txn_id").alias("r"), F.struct((-F.datediff("l_transaction_date", F.lit("1970-01-01"))).alias("d"), F.col("l_txn_id").alias("i")).alias("l_order"),
            F.struct(F.abs("gap").alias("g"), (-F.datediff("r_transaction_date", F.lit("1970-01-01"))).alias("d"), F.col("r_txn_id").alias("i")).alias("cost"), F.col("l_user_id").alias("user_id"), F.abs("gap").alias("day_gap"),
        ),
        "upi-edges",
    )
    return pairs.join(one_to_one(pairs), ["l", "r"]).select(F.col("l").alias("debit_id"), F.col("r").alias("credit_id"), "user_id", "day_gap", F.lit(rules.UPI_CONFIDENCE).alias("confidence"))


def reclassified(ledger: DataFrame, pairs: DataFrame, note: str) -> DataFrame:
    """The ledger with both entries of each pair as internal transfers that carry the note."""
    ids = pairs.select(F.explode(F.array("debit_id", "credit_id")).alias("txn_id")).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return ledger.join(ids, "txn_id", "left").withColumn("nature", F.when(hit, "transfer_internal").otherwise(F.col("nature"))).withColumn("notes", F.when(hit, append_note(F.col("notes"), note)).otherwise(F.col("notes"))).drop("_hit").select(ledger.columns)


def sms_statement_match(sms: DataFrame, ledger: DataFrame) -> DataFrame:
    """For each SMS row the nearest entry of its account and direction; on equal gaps the earlier date, then the smaller id. Entries may serve several."""
    columns = ("txn_id", "user_id", "account_masked", "direction", "transaction_date", "amount")
    pairs = near(sms.select(*columns), ledger.select(*columns), ["user_id", "account_masked", "direction"], rules.SMS_AMOUNT_GAP, rules.SMS_DAYS)
    best = pairs.groupBy(F.col("l_txn_id").alias("sms_id")).agg(F.min(F.struct(F.abs("gap").alias("gap"), F.col("r_transaction_date").alias("matched_date"), F.col("r_txn_id").alias("txn_id"))).alias("b"))
    return best.select("sms_id", "b.txn_id", F.col("b.gap").alias("day_gap"), "b.matched_date")


def seq_ratio(row: Column, a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts; for candidate pairs only. Of pairs of one ``row`` those that can't be its most similar ones, or not
    above ``ALIKE``, may have 0: how many signs two texts share at most is counted first, and those that share most are compared first."""

    @F.pandas_udf("double")
    def of(r: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_best_ratios(pd.factorize(r)[0], *([t or "" for t in c.tolist()] for c in (x, y))), dtype=float)

    return of(row, a, b)


def _best_ratios(rows: np.ndarray, first: list[str], second: list[str]) -> np.ndarray:
    code, texts = pd.factorize(np.array([*first, *second], dtype=object))
    n = np.array([len(t) for t in texts], dtype=np.int64)
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(np.repeat(np.arange(len(texts)) * 64, n) + signs % 64, minlength=len(texts) * 64).reshape(-1, 64).astype(np.int32 if n.max(initial=0) > 255 else np.uint8)
    a, b = code[: len(first)], code[len(first):]
    shared = np.concatenate([np.empty(0, np.int64), *(np.minimum(counts[a[k : k + A_STEP]], counts[b[k : k + A_STEP]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), A_STEP))])
    # Two empty texts are equal.
    most = np.where(n[a] + n[b] > 0, 2.0 * shared / np.maximum(n[a] + n[b], 1), 1.0)
    out, best = np.zeros(len(a)), np.full(rows.max(initial=0) + 1, ALIKE)
    order = np.lexsort((-most, rows))
    begins = np.concatenate([np.ones(min(len(a), 1), bool), rows[order][1:] != rows[order][:-1]])
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(begins, np.arange(len(a)), 0))
    take = 1
    while take <= 2 * (place.max(initial=0) + 1):
        now = order[(place >= take - 1) & (place < 2 * take - 1)]
        now = now[most[now] >= best[rows[now]]]
        out[now] = ratios([first[k] for k in now], [second[k] for k in now])
        np.maximum.at(best, rows[now], out[now])
        take *= 2
    return out


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """``difflib.SequenceMatcher(None, a, b).ratio()`` of each pair. Short texts are compared side by side: in each round all of a pair's
    windows lose their longest common run, of equal ones the first in a and then in b, and leave what stands before and behind it."""
    n_a, n_b = (np.array([len(t) for t in c], dtype=np.int64) for c in (first, second))
    total, same = n_a + n_b, np.zeros(len(first), np.int64)
    short = (n_a <= SHORT) & (n_b <= SHORT)
    # Longer ones have words that difflib itself leaves out.
    out = np.array([0.0 if ok else difflib.SequenceMatcher(None, x, y).ratio() for x, y, ok in zip(first, second, short.tolist())], dtype=float)
    signs = np.frombuffer("".join(t for c in (first, second) for t, ok in zip(c, short.tolist()) if ok).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.uint8 if signs.max(initial=0) < 254 else np.uint32
    # No sign equals what windows are filled up with, which differs on both sides.
    signs = np.append(signs.astype(kind), [kind(np.iinfo(kind).max - 1), kind(np.iinfo(kind).max)]).astype(kind)
    pair = np.flatnonzero(short)
    starts = np.cumsum(np.concatenate([n_a[pair], n_b[pair]])) - np.concatenate([n_a[pair], n_b[pair]])
    # Windows: pair, where they begin in a and in b, and how long they are there.
    windows = np.stack([pair, starts[: len(pair)], starts[len(pair):], n_a[pair], n_b[pair]])
    while windows.shape[1]:
        windows = windows[:, (windows[3] > 0) & (windows[4] > 0)]
        windows = windows[:, np.argsort(np.maximum(windows[3], windows[4]), kind="stable")]
        left = []
        for at in range(0, windows.shape[1], A_STEP):
            w = windows[:, at : at + A_STEP]
            size, i, j = _longest(signs, *w[1:])
            w, size, i, j = w[:, size > 0], size[size > 0], i[size > 0], j[size > 0]
            np.add.at(same, w[0], size)
            left += [np.stack([w[0], w[1], w[2], i, j]), np.stack([w[0], w[1] + i + size, w[2] + j + size, w[3] - i - size, w[4] - j - size])]
        windows = np.concatenate(left, axis=1) if left else windows[:, :0]
    return np.where(short, np.where(total > 0, 2.0 * same / np.maximum(total, 1), 1.0), out)


def _longest(signs: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of the longest common run of each window, and where in it the first one begins."""
    def cut(at: np.ndarray, n: np.ndarray, fill: int) -> np.ndarray:
        k = np.arange(n.max())[:, None]
        return signs[np.where(k < n, at + k, len(signs) - fill)]

    x, y = cut(a, n_a, 2), cut(b, n_b, 1)
    run, then, back = np.zeros(y.shape, np.uint8), np.empty(y.shape, np.uint8), np.arange(len(y), 0, -1, dtype=np.uint8)[:, None]
    best, ends_a, ends_b = np.zeros(len(a), np.uint8), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(x)):
        # Runs that end here are one longer than those that end one before in both.
        then[0] = 1
        np.add(run[:-1], 1, out=then[1:])
        then *= y == x[k]
        most = then.max(axis=0)
        more = np.flatnonzero(most > best)
        if len(more):
            # The first place of the longest run is the farthest from the end.
            best[more], ends_a[more], ends_b[more] = most[more], k, len(y) - ((then[:, more] == most[more]) * back).max(axis=0).astype(np.int64)
        run, then = then, run
    size = best.astype(np.int64)
    return size, ends_a - size + 1, ends_b - size + 1


def _first_two(entries: DataFrame, *keys: str | Column) -> DataFrame:
    """The entries with the two smallest ids of each key: the best of equals, also for a row that is one of them itself."""
    place = F.dense_rank().over(W.partitionBy(*keys).orderBy("txn_id"))
    return entries.withColumn("_place", place).where(F.col("_place") <= 2).drop("_place")


def candidates(rows: DataFrame, existing: DataFrame, similar: bool = True) -> DataFrame:
    """Pairs (txn_id, match_id) of a row and an entry that it may repeat, with tier, _order within it, method and confidence; see ``duplicates``.
    The best pair of each row is among them, of those that are compared by text maybe no other.

    Of entries that a row can't tell apart (equal fingerprint; equal reference, direction and account; equal amount and day, and text where texts are
    compared) the two with the smallest ids alone are paired, so that pairs grow with the rows; those that are compared by text grow with the different texts
    of an amount on a day.
    """
    pick = lambda tier, method, confidence, order: [F.col("l.txn_id").alias("txn_id"), F.lit(tier).alias("tier"), F.lit(method).alias("method"), confidence.alias("confidence"), order.alias("_order"), F.col("r.txn_id").alias("match_id")]

    def equal(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        on = F.col("l.txn_id") != F.col("r.txn_id")
        for k in keys:
            on &= F.col(f"l.{k}") == F.col(f"r.{k}")
        return left.alias("l").join(_first_two(right, *keys).alias("r"), on)

    exact = equal(rows, existing.where("fingerprint IS NOT NULL"), ("user_id", "fingerprint")).select(*pick(0, "fingerprint_exact", F.lit(0.99), F.lit(0.0)))
    keys = ("user_id", "reference_number", "direction")
    told = existing.where("reference_number IS NOT NULL")
    # Accounts are equal, or one is unknown.
    ways = (("account_masked IS NOT NULL", "account_masked IS NOT NULL", (*keys, "account_masked")), ("account_masked IS NOT NULL", "account_masked IS NULL", keys), ("account_masked IS NULL", "true", keys))
    reference = reduce(DataFrame.unionByName, [equal(rows.where(a), told.where(b), k).select(*pick(1, "exact_ref", F.lit(1.0), F.lit(0.0))) for a, b, k in ways])
    columns = ("txn_id", "user_id", "direction", "transaction_date", "amount", "merchant_raw")
    cell = ("user_id", "direction", money.paise(F.col("amount")), "transaction_date")
    dated = existing.where("amount IS NOT NULL AND transaction_date IS NOT NULL").select(*columns)
    near_to = lambda right, days: near(rows.select(*columns), right, ["user_id", "direction"], Decimal("0.00"), days).where("l_txn_id <> r_txn_id").withColumn("gap", F.abs("gap"))
    pairs = near_to(_first_two(dated, *cell), 3)
    fuzzy = pairs.select(F.col("l_txn_id").alias("txn_id"), F.lit(3).alias("tier"), F.lit("fuzzy").alias("method"), F.greatest(F.lit(0.6), 0.8 - F.col("gap") * 0.2 / 3).alias("confidence"), F.col("gap").cast("double").alias("_order"), F.col("r_txn_id").alias("match_id"))
    found = exact.unionByName(reference).unionByName(fuzzy)
    if similar:
        pairs = near_to(_first_two(dated.withColumn("merchant_raw", F.upper("merchant_raw")), *cell, "merchant_raw"), 1)
        alike = pairs.withColumn("_s", seq_ratio(F.col("l_txn_id"), F.upper("l_merchant_raw"), F.col("r_merchant_raw"))).where(F.col("_s") > ALIKE)
        found = found.unionByName(alike.select(F.col("l_txn_id").alias("txn_id"), F.lit(2).alias("tier"), F.lit("amount_date_desc").alias("method"), F.least(F.lit(0.95), 0.8 + (F.col("_s") - 0.6) * 0.375).alias("confidence"), (-F.col("_s")).alias("_order"), F.col("r_txn_id").alias("match_id")))
    return found


def duplicates(rows: DataFrame, existing: DataFrame, similar: bool = True) -> DataFrame:
    """The existing entry that each row repeats, by the first tier that hits: equal fingerprint (0.99);
    equal reference and direction, account equal or unknown (1.0); equal amount and direction within a
    day and texts more than 0.6 alike; equal amount and direction within three days.

    Both have txn_id, user_id, transaction_date, amount, direction, account_masked,
    fingerprint, reference_number, merchant_raw. Returns txn_id, match_id, method, confidence.
    """
    best = candidates(rows, existing, similar).groupBy("txn_id").agg(F.min(F.struct("tier", "_order", "match_id", "method", "confidence")).alias("b"))
    return best.select("txn_id", "b.match_id", "b.method", F.round("b.confidence", 4).alias("confidence"))


def _nearest_free(key):
    """Starts a group: its entries in order of amount and id, then its lines in order of id, of which each takes the nearest entry that is free.

    Entries of one amount are taken in order of id. An amount that has no entry left points to its neighbours, so a line sees the nearest one below and
    above at once; if such a one is too far so are those behind it.
    """

    def fold():
        ids, amounts, first, ends, above, below = [], [], [], [], [], []

        def root(links: list[int], k: int) -> int:
            while links[k] != k:
                links[k] = k = links[links[k]]
            return k

        def close(a, b) -> bool:
            return abs(a - b) <= 100 or float(abs(a - b)) / float(max(a, b)) <= 0.05

        def step(row: tuple) -> list[tuple]:
            line, i, amount = row
            if not line:
                if not amounts or amounts[-1] != amount:
                    amounts.append(amount)
                    first.append(len(ids))
                    ends.append(len(ids))
                ids.append(i)
                ends[-1] += 1
                return []
            n = len(amounts)
            if not above:
                above.extend(range(n + 1))
                below.extend(range(n + 1))  # one off: 0 is none
            at = bisect.bisect_left(amounts, amount)
            some = [m for m in (root(below, at) - 1, root(above, at)) if 0 <= m < n and close(amount, amounts[m])]
            if not some:
                return []
            m = min(some, key=lambda m: (abs(amount - amounts[m]), key(ids[first[m]])))
            got = ids[first[m]]
            first[m] += 1
            if first[m] == ends[m]:
                above[m], below[m + 1] = m + 1, m
            return [(i, got, amount, amounts[m])]

        return step

    return fold


def portal_matches(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Portal lines (line_id, user_id, fy, bucket, amount) with the ledger entry (txn_id, user_id, fy, bucket, amount)
    nearest in amount, at most 100 or 5 % apart; lines in order of id choose first, an entry serves one. Ids don't repeat.

    A user's lines of one year and bucket are one group, which one task folds in order beside its entries: pairs within 5 % would grow
    with the square of a group and are never made.
    """
    group, none = F.to_json(F.struct("user_id", "fy", "bucket")).alias("group"), F.lit(None)
    known = "user_id IS NOT NULL AND fy IS NOT NULL AND bucket IS NOT NULL AND bucket <> 'securities_sold' AND amount <> 0"
    kinds = {"l": lines.schema["line_id"].dataType, "r": ledger.schema["txn_id"].dataType, "portal_amount": lines.schema["amount"].dataType, "ledger_amount": ledger.schema["amount"].dataType}
    l, r = F.col("line_id"), F.col("txn_id")
    a = ledger.where(known).select(group, F.lit(False).alias("line"), r.cast("string").alias("id"), "amount", F.col("amount").alias("_by"), r.alias("_r"), none.cast(kinds["l"]).alias("_l"))
    b = lines.where(known).select(group, F.lit(True).alias("line"), l.cast("string").alias("id"), "amount", none.cast(kinds["ledger_amount"]).alias("_by"), none.cast(kinds["r"]).alias("_r"), l.alias("_l"))
    rows = a.unionByName(b)
    kind = rows.schema["amount"].dataType.simpleString()
    key = str if kinds["r"].simpleString() == "string" else Decimal
    out = folded(rows, "group", [F.col(c) for c in ("line", "_by", "_r", "_l")], _nearest_free(key), f"l string, r string, portal_amount {kind}, ledger_amount {kind}", ["line", "id", "amount"])
    return out.select(*(F.col(c).cast(k).alias({"l": "line_id", "r": "txn_id"}.get(c, c)) for c, k in kinds.items()))


def _grams(c: Column, n: Column | int) -> Column:
    """The distinct runs of ``n`` characters; none if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, n)))


def _containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of texts (_up) and patterns that they contain, by an index of runs of three characters.

    Each pattern is filed under the run of its own that is rarest among the texts, and meets only texts that have this run; one with a run that
    no text has is out. Patterns of one or two characters are filed under themselves.
    """
    held = patterns.withColumn("_pat", F.upper("pattern")).withColumn("_size", F.least(F.length("_pat"), F.lit(3)))
    sizes = [r["_size"] for r in held.select("_size").distinct().collect()] or [3]  # three at most
    runs = written(texts.select("_up").distinct().select("_up", F.explode(F.concat(*(_grams(F.col("_up"), n) for n in sizes))).alias("_run")), "narration-runs")
    often = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    own = held.select("pattern_id", F.explode(_grams(F.col("_pat"), F.col("_size"))).alias("_run")).join(often, "_run", "left")
    filed = own.groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_k")).where("_k.n > 0").select("pattern_id", "_k._run")
    filed = written(held.join(filed, "pattern_id"), "filed-patterns")
    met = runs.join(filed, "_run").where(F.contains("_up", "_pat")).drop("_run", "_pat", "_size")
    return texts.select("_up", "merchant_raw").join(met, "_up")


def merchants(ledger: DataFrame, patterns: DataFrame) -> DataFrame:
    """The first pattern (pattern_id, without repeats, kind exact/contains/regex, pattern, priority, merchant, category) that each distinct narration matches.

    Narrations are matched once each. Exact patterns are met by an equi-join, those by content by an index of three-character
    runs (``_containing``). Regular expressions alone are a rule table that goes to every task, in blocks of about ``RULES`` where it is larger; so
    are patterns by content that are empty and fit all.
    """
    texts = written(ledger.select("merchant_raw").where("merchant_raw IS NOT NULL").distinct().withColumn("_up", F.upper(F.trim("merchant_raw"))), "narrations")
    found = F.struct((-F.col("priority")).alias("p"), F.col("pattern_id").alias("i"), "merchant", "category").alias("b")
    exact = texts.join(patterns.where("kind = 'exact'").withColumn("_up", F.upper("pattern")), "_up").select("merchant_raw", found)
    exact = exact.unionByName(_containing(texts, patterns.where("kind = 'contains' AND pattern <> ''")).select("merchant_raw", found))
    rest = written(patterns.where("kind = 'regex' OR (kind = 'contains' AND pattern = '')"), "expressions")
    blocks = -(-rest.count() // RULES)
    hit = F.expr("kind = 'contains' OR _up rlike concat('(?i)', pattern)")
    for k in range(blocks):
        block = rest.where(F.pmod(F.xxhash64("pattern_id"), F.lit(blocks)) == k)
        exact = exact.unionByName(texts.join(F.broadcast(block), hit).select("merchant_raw", found))
    best = exact.groupBy("merchant_raw").agg(F.min("b").alias("b"))
    return best.select("merchant_raw", "b.merchant", "b.category")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the order given."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(c.desc() for c in order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
