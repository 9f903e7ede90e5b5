"""What people decide: reviews, corrections, confirmed transfers, balances by hand, and single rows that join the ledger."""

from __future__ import annotations

import difflib
from collections import defaultdict
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, money, text
from ..tables import written
from . import ledger as entries
from .graph import components, folded
from .matching import ALIKE, candidates, card_payment_pairs


class Promoted(NamedTuple):
    links: DataFrame
    entries: DataFrame


class Resolved(NamedTuple):
    tasks: DataFrame
    parsed: DataFrame
    promoted: DataFrame


def statement_review(parsed: DataFrame, sources: DataFrame, annotations: DataFrame) -> DataFrame:
    """A statement's parsed rows with their ledger entry and their notes in order of time (a row has few notes)."""
    entry = sources.groupBy("parsed_id").agg(F.max("txn_id").alias("txn_id"))
    notes = annotations.where("parsed_id IS NOT NULL").groupBy("parsed_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "note"))).alias("_n"))
    none = F.array().cast("array<string>")
    return parsed.join(entry, "parsed_id", "left").join(notes, "parsed_id", "left").withColumn("notes", F.coalesce(F.transform("_n", lambda x: x["note"]), none)).drop("_n")


def resolved(tasks: DataFrame, parsed: DataFrame, decisions: DataFrame) -> Resolved:
    """Open tasks (task_id, statement_id, status) with a decision (task_id, action promote or ignore, reason) are resolved.

    All quarantined rows of the statement leave quarantine with the reason; those of a promoted one are to become
    entries by ``promoted``. Other tasks, and decisions of other words, change nothing.
    """
    asked = decisions.select("task_id", F.lower(F.trim("action")).alias("_action"), F.col("reason").alias("_reason")).where("_action IN ('promote', 'ignore')")
    taken = tasks.where("status = 'open' AND statement_id IS NOT NULL").join(asked, "task_id").select("task_id", "statement_id", "_action", "_reason")
    by_statement = taken.groupBy("statement_id").agg(F.min(F.struct("task_id", "_action", "_reason")).alias("_d"))
    rows = parsed.join(by_statement, "statement_id", "left")
    hit = F.col("is_quarantined") & F.col("_d").isNotNull()
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    after = rows.withColumn("override_reason", F.when(F.col("_hit"), F.coalesce("_d._reason", F.concat(F.lit("manual_"), F.col("_d._action"))))).withColumn("is_quarantined", F.col("is_quarantined") & ~F.col("_hit"))
    n = rows.where("_hit").groupBy("statement_id").agg(F.count("*").alias("_n"))
    done = tasks.join(taken.select("task_id", "_action"), "task_id", "left").join(n, "statement_id", "left")
    count = lambda action: F.when(F.col("_action").isNotNull(), F.when(F.col("_action") == action, F.coalesce("_n", F.lit(0))).otherwise(0))
    done = done.withColumns({"status": F.when(F.col("_action").isNotNull(), "resolved").otherwise(F.col("status")), "promoted_count": count("promote"), "ignored_count": count("ignore"), "parse_status": F.when(F.col("_action") == "promote", "parsed").when(F.col("_action") == "ignore", "partial")})
    promoted_rows = after.where("_hit AND _d._action = 'promote'").drop("_hit", "_d")
    return Resolved(done.drop("_action", "_n"), after.drop("_hit", "_d"), promoted_rows)


def kin(rows: DataFrame) -> DataFrame:
    """(node, component) of rows that may depend on one another: those that share a fingerprint, a reference, or an amount on days close together.

    Rows of an amount in buckets of days that follow one another stand for their smallest one, so that no chain is left to follow. What the fingerprints and references
    tie together are these alone, each to its group's smallest one: there are a few edges a row at most and never pairs of a group.
    """
    day = F.when(F.col("amount").isNotNull(), F.floor(F.datediff("transaction_date", F.lit("1970-01-01")) / 4))
    slim = rows.select("txn_id", "user_id", "direction", "fingerprint", "reference_number", F.struct("user_id", "direction", money.paise(F.col("amount")).alias("p")).alias("_k"), day.alias("_d"))
    tops = slim.where("_d IS NOT NULL").groupBy("_k", "_d").agg(F.min("txn_id").alias("_least")).withColumn("_run", F.col("_d") - F.row_number().over(W.partitionBy("_k").orderBy("_d")))
    tops = tops.withColumn("_first", F.min("_least").over(W.partitionBy("_k", "_run"))).select("_k", "_d", "_first")
    tied = written(slim.join(tops, ["_k", "_d"], "left").withColumn("_own", F.coalesce("_first", "txn_id")).drop("_k", "_d", "_first"), "kin-rows")
    edges = []
    for own, more in (("fingerprint", ()), ("reference_number", ("direction",))):
        some = tied.where(F.col(own).isNotNull()).select("_own", F.struct("user_id", own, *more).alias("_k"))
        groups = some.groupBy("_k").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last")).where("_first < _last").drop("_last")
        edges.append(some.join(groups, "_k").select("_own", "_first"))
    roots = components(reduce(DataFrame.unionByName, edges).where("_own <> _first").toDF("a", "b")).withColumnRenamed("node", "_own")
    return tied.join(roots, "_own", "left").select(F.col("txn_id").alias("node"), F.coalesce("component", "_own").alias("component"))


def _ledger_fold(similar: bool):
    """Rows of one component in order: each links to the best entry, or becomes one. Entries are remembered by what they are found by."""

    def fold():
        by_print: dict = {}
        by_reference: dict = defaultdict(list)
        by_amount: dict = defaultdict(list)

        def step(row: tuple) -> list[tuple]:
            txn, user, day, cents, direction, account, mark, reference, text, tier, order, other, method, confidence = row
            found = [] if tier < 0 else [(tier, order, False, other, method, confidence)]
            if user is not None:
                if mark is not None and (user, mark) in by_print:
                    found.append((0, 0.0, True, by_print[user, mark], "fingerprint_exact", 0.99))
                if reference is not None and direction is not None:
                    found += [(1, 0.0, True, i, "exact_ref", 1.0) for i, a in by_reference[user, reference, direction] if a is None or account is None or a == account]
            better = bool(found) and min(found)[0] < 2  # whatever texts say
            if cents is not None and day is not None:
                near = by_amount[user, direction, cents]
                near[:] = [x for x in near if (day - x[0]).days <= 3]  # rows come in the order of their days
                for at, i, other_text in near:
                    gap = (day - at).days
                    found.append((3, float(gap), True, i, "fuzzy", max(0.6, 0.8 - gap * 0.2 / 3)))
                    if similar and gap <= 1 and not better:
                        alike = difflib.SequenceMatcher(None, text or "", other_text or "").ratio()
                        if alike > ALIKE:
                            found.append((2, -alike, True, i, "amount_date_desc", min(0.95, 0.8 + (alike - 0.6) * 0.375)))
            if found:
                best = min(found)
                return [(txn, best[3], best[4], best[5])]
            if user is not None and mark is not None:
                by_print[user, mark] = txn
            if user is not None and reference is not None and direction is not None:
                by_reference[user, reference, direction].append((txn, account))
            if cents is not None and day is not None:
                by_amount[user, direction, cents].append((day, txn, text))
            return []

        return step

    return fold


def promoted(rows: DataFrame, existing: DataFrame, similar: bool = True) -> Promoted:
    """Single rows join the ledger: each links to the entry that it repeats, or becomes one, and rows of one batch see those before them.

    Rows and entries are as for matching.duplicates, rows have account_type too; a row comes before those with a larger
    (transaction_date, txn_id), and ids are whole numbers that don't repeat. What rows may repeat of the ledger is found by joins. Among themselves,
    rows fall into components of those that share a key (``kin``), as many rounds as the logarithm of the longest chain, and each component is
    folded in order in one task, which remembers its entries alone: rows of an amount that are days past are forgotten, and pairs are never made.
    """
    columns = ["txn_id", "user_id", "transaction_date", "amount", "direction", "account_masked", "fingerprint", "reference_number", "merchant_raw"]
    new = written(rows.select(*columns), "promotion-rows")
    old = candidates(new, written(existing.select(*columns), "promotion-entries"), similar).groupBy("txn_id").agg(F.min(F.struct("tier", "_order", "match_id", "method", "confidence")).alias("_e"))
    state = new.join(old, "txn_id", "left").join(kin(new).withColumnRenamed("node", "txn_id"), "txn_id", "left")
    state = written(state.withColumn("component", F.coalesce("component", "txn_id")), "promotion-components")
    kind = rows.schema["txn_id"].dataType.simpleString()
    known = [F.coalesce(c, F.lit(d)).alias(n) for n, c, d in (("_tier", F.col("_e.tier"), -1), ("_at", F.col("_e._order"), 0.0))]
    known += [F.coalesce("_e.match_id", "txn_id").alias("_other"), F.col("_e.method").alias("_method"), F.coalesce("_e.confidence", F.lit(0.0)).alias("_sure")]
    slim = state.select(
        "component", "txn_id", F.col("user_id").cast("string").alias("user_id"), "transaction_date", money.paise(F.col("amount")).cast("string").alias("_cents"), "direction", "account_masked", "fingerprint", "reference_number",
        F.upper("merchant_raw").alias("merchant_raw"), *known,
    )
    order = [F.asc_nulls_first("transaction_date"), F.col("txn_id")]
    names = [c for c in slim.columns if c != "component"]
    best = folded(slim, "component", order, _plain_nulls(_ledger_fold(similar)), f"txn_id {kind}, match_id {kind}, method string, confidence double", names)
    best = written(best.withColumn("confidence", F.round("confidence", 4)), "promotion-links")
    single = rows.join(best, "txn_id", "left_anti")
    up = F.col("merchant_raw")
    made = single.withColumn("category_name", classify.category(up)).withColumn("nature", classify.nature(up, F.col("direction"), F.col("account_type")))
    own = single.select("txn_id", F.col("txn_id").alias("match_id"), F.lit("single_source").alias("method"), F.lit(1.0).alias("confidence"))
    return Promoted(best.unionByName(own), made)


def _plain_nulls(fold):
    """``fold`` with None wherever pandas has another null."""

    def started():
        step = fold()
        return lambda row: step(tuple(None if v is None or v != v else v for v in row))

    return started


def split_family(ledger: DataFrame, splits: DataFrame) -> DataFrame:
    """For each entry in a split (source_id, child_id, split_index) its parent and its children in order (a split has few)."""
    kids = splits.groupBy(F.col("source_id").alias("txn_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("split_index", "child_id"))), lambda x: x["child_id"]).alias("children"))
    parent = splits.select(F.col("child_id").alias("txn_id"), F.col("source_id").alias("parent_id"))
    none = F.array().cast("array<bigint>")
    return ledger.join(parent, "txn_id", "left").join(kids, "txn_id", "left").where("parent_id IS NOT NULL OR children IS NOT NULL").withColumn("children", F.coalesce("children", none))


def total_count(rows: DataFrame) -> DataFrame:
    """How many rows a filtered list has beyond the page that is shown."""
    return rows.agg(F.count("*").alias("total"))


def category_list(categories: DataFrame, user_id) -> DataFrame:
    """A user's categories and those of the system: the system's first, then by their order and name."""
    own = categories.where((F.col("user_id") == F.lit(user_id)) | F.col("user_id").isNull())
    return own.orderBy(F.desc("is_system"), "sort_order", "name")


def reclassified(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with every entry's nature inferred anew, and by user how many entries there are and how many changed."""
    new = ledger.withColumn("_new", classify.nature(F.col("merchant_raw"), F.col("direction"), F.col("account_type")))
    counts = new.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~F.col("_new").eqNullSafe(F.col("nature"))).alias("updated"))
    return new.withColumn("nature", F.col("_new")).drop("_new"), counts


def transfers_reclassified(ledger: DataFrame, matches: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """The ledger with all natures inferred anew and both ends of each card payment as internal transfers, and the
    matches (debit_id, credit_id, confidence, resolution_status) with the pairs found: a pair that is known keeps its state."""
    again, _ = reclassified(ledger)
    pairs = written(card_payment_pairs(again, days).select("debit_id", "credit_id", F.col("confidence").cast("double").alias("_found")), "card-payments")
    ends = pairs.select(F.col("debit_id").alias("txn_id")).unionByName(pairs.select(F.col("credit_id").alias("txn_id"))).distinct().withColumn("_hit", F.lit(True))
    after = again.join(ends, "txn_id", "left").withColumn("nature", F.when(F.col("_hit"), "transfer_internal").otherwise(F.col("nature"))).select(ledger.columns)
    both = matches.join(pairs, ["debit_id", "credit_id"], "full_outer")
    return after, both.select("debit_id", "credit_id", F.coalesce("_found", "confidence").alias("confidence"), F.coalesce("resolution_status", F.lit("auto")).alias("resolution_status"))


def planned(actions: DataFrame, ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """What proposed corrections (action_id, txn_id, action, value) would do: field, old and new value, or why one is skipped."""
    names = categories.select(F.lower("name").alias("_key"), F.col("name").alias("_name")).dropDuplicates(["_key"])
    value = F.trim(F.coalesce("value", F.lit("")))
    rows = actions.join(ledger.select("txn_id", "category_name", "nature", "notes", "is_excluded", F.lit(True).alias("_there")), "txn_id", "left").join(names, F.lower(value) == F.col("_key"), "left")
    a = F.col("action")
    empty, low = value == "", F.lower(value)
    exclude = a.isin("exclude_transaction", "include_transaction")
    why = (
        F.when(F.col("_there").isNull(), "Unknown transaction.")
        .when((a == "set_category") & F.col("_name").isNull(), F.when(empty, "Missing category_name.").otherwise(F.concat(F.lit("Unknown category '"), value, F.lit("'."))))
        .when((a == "set_nature") & ~low.isin(*rules.SETTABLE_NATURES), F.when(empty, "Missing transaction_nature.").otherwise(F.concat(F.lit("Disallowed nature '"), low, F.lit("'."))))
        .when((a == "set_notes") & empty, "Empty notes.").when(~a.isin("set_category", "set_nature", "set_notes") & ~exclude, "Unknown action.")
    )
    pick = lambda c, n, t, x: F.when(a == "set_category", c).when(a == "set_nature", n).when(a == "set_notes", t).when(exclude, x)
    field = pick(F.lit("category_name"), F.lit("nature"), F.lit("notes"), F.lit("is_excluded"))
    old = pick(F.col("category_name"), F.col("nature"), F.col("notes"), F.col("is_excluded").cast("string"))
    new = pick(F.col("_name"), low, F.left(value, F.lit(500)), (a == "exclude_transaction").cast("string"))
    ok = lambda x: F.when(F.col("skipped").isNull(), x)
    return rows.withColumn("skipped", why).select("action_id", "txn_id", "action", ok(field).alias("field"), ok(old).alias("old_value"), ok(new).alias("new_value"), "skipped")


def bulk_updated(ledger: DataFrame, ids: DataFrame, changes) -> tuple[DataFrame, DataFrame]:
    """As ledger.updated, for a list of entries that must all be there."""
    lost = ids.select("txn_id").distinct().join(ledger.select("txn_id"), "txn_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("some of the entries don't exist")
    return entries.updated(ledger, ids, changes)


def transfers_resolved(matches: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Pairs (match_id, user_id, resolution_status, matched_at) after their users' decisions (match_id, user_id, decision): confirm, else rejected. An equal state is left alone."""
    told = decisions.select("match_id", "user_id", F.when(F.col("decision") == "confirm", "confirmed").otherwise("rejected").alias("_new")).dropDuplicates(["match_id", "user_id"])
    rows = matches.join(told, ["match_id", "user_id"], "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("resolution_status"))
    return rows.withColumn("matched_at", F.when(changed, now).otherwise(F.col("matched_at"))).withColumn("resolution_status", F.when(changed, F.col("_new")).otherwise(F.col("resolution_status"))).select(matches.columns)


def manual_snapshots(requests: DataFrame) -> DataFrame:
    """Balances entered by hand (user_id, label, entry_kind, asset_type, position_key, currency, balance, as_of_date) as snapshots; those without a label or of another kind are refused."""
    kind, label = F.lower(F.trim("entry_kind")), F.trim("label")
    key = F.coalesce(F.nullif("position_key", F.lit("")), F.concat_ws(":", F.lit("manual"), kind, text.slug(F.col("asset_type")), text.slug(label)))
    rows = requests.where(kind.isin("asset", "liability") & (label != ""))
    return rows.select(
        "user_id", key.alias("position_key"), label.alias("label"), F.lit("manual").alias("source_kind"), kind.alias("entry_kind"), F.lower(F.trim("asset_type")).alias("asset_type"),
        F.coalesce(F.nullif(F.upper(F.trim("currency")), F.lit("")), F.lit("INR")).alias("currency"), F.round("balance", 2).alias("balance"), "as_of_date",
    )


def without_manual(snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    """The snapshots without those in ``ids`` that were entered by hand by the same user (snapshot_id, user_id); others can't be deleted."""
    gone = snapshots.where("source_kind = 'manual'").join(ids.select("snapshot_id", "user_id"), ["snapshot_id", "user_id"], "left_semi").select("snapshot_id")
    return snapshots.join(gone, "snapshot_id", "left_anti")
