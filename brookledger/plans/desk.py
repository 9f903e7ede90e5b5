"""Registered queries on intake, review desks and reconciliation by lines, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import grammars, rules
from ..functions import classify, dates, text
from ..operators import balance, dedup, documents, extract, insights, intake, matching, reconcile, review
from ..operators import cards, filing
from ..operators import statements as statement_texts
from ..operators import ledger as entries
from ..sources import seeds
from ..tables import written
from . import queries as base
from .ledger import ledger, statement_rows, statements, table, transfer_feed
from .oracle import BUCKETS, INCOME, LEDGER, ORACLE_SQL, PORTAL, ROWS, TOTALS, listed, quoted, with_

NAMES: list[str] = []
#: Documents of the events table, by remainder. Fixed values.
KINDS = ("bank_statement", "credit_card_statement", "tax_form", "interest_certificate", "dividend_report", "other")
STATES = ("parsed", "failed", "skipped", "discovered")
MESSAGES = ("No parser configured for it", "Could not identify the bank/statement type", "file is password-protected", "odd row")


def query(sql: str | None = None) -> Callable:
    """Registers a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        base.query(f)
        NAMES.append(f.__name__)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("artifact_id"), (F.col("user_id") % 40).alias("user_id"), F.concat(F.lit("f"), (i % 50).cast("string")).alias("file_name"), _pick(KINDS, i).alias("doc_type"), _pick(STATES, F.floor(i / 3)).alias("status"),
        _pick(MESSAGES, F.floor(i / 7)).alias("parse_message"), F.col("ts").alias("created_at"),
    )


ARTIFACTS = f"""artifacts AS (
    SELECT event_id AS artifact_id, user_id % 40 AS user_id, 'f' || event_id % 50 AS file_name, {listed(KINDS)}[(event_id % 6)::INT + 1] AS doc_type, {listed(STATES)}[(event_id // 3 % 4)::INT + 1] AS status,
        {listed(MESSAGES)}[(event_id // 7 % 4)::INT + 1] AS parse_message, ts AS created_at FROM events)"""


@query(with_(LEDGER, ROWS, "s AS (SELECT statement_id, min(transaction_date) + 60 AS a, max(transaction_date) - 10 AS b FROM stmt_rows GROUP BY ALL)",
    "g AS (SELECT r.*, substr(upper(merchant_raw), 1, 8) AS same, txn_id % 9 <> 0 AND transaction_date >= a - 120 AND transaction_date <= b + 31 AS sane FROM stmt_rows r JOIN s USING (statement_id))",
    select="SELECT statement_id, count(*) AS rows, count(DISTINCT (transaction_date, amount, direction, same)) FILTER (sane) AS kept, count(*) - count(DISTINCT (transaction_date, amount, direction, same)) FILTER (sane) AS dropped FROM g GROUP BY ALL"))
def g5_extracted(spark, sf_dir):
    """Some rows have no amount; descriptions are cut, so that some are alike."""
    rows = statement_rows(ledger(spark, sf_dir)).select("statement_id", F.col("txn_id").alias("line_number"), "transaction_date", F.when(F.col("txn_id") % 9 != 0, F.col("amount")).alias("amount"), "direction", F.substring("merchant_raw", 1, 8).alias("description"), F.lit(1.4).alias("confidence"))
    s = rows.groupBy("statement_id").agg(F.date_add(F.min("transaction_date"), 60).alias("period_start"), F.date_add(F.max("transaction_date"), -10).alias("period_end"))
    return intake.extracted(rows, s).counts


@query(with_(LEDGER, "r AS (SELECT user_id AS doc_id, txn_id // 100 % 5 AS chunk_no, txn_id AS line_no, CASE WHEN txn_id % 4 <> 0 THEN date_trunc('year', transaction_date)::DATE END AS d, direction, floor(amount / 10000) AS amount, trim(merchant_raw) AS description FROM ledger)",
    "c AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY doc_id, chunk_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS day FROM r)",
    select="SELECT doc_id, line_no FROM c WHERE day IS NOT NULL AND amount > 0 AND description <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, day, direction, amount, upper(substr(description, 1, 90)) ORDER BY chunk_no, line_no) = 1"))
def g6_merged_chunks(spark, sf_dir):
    """Entries as rows of five chunks a user, coarse enough that some are alike; every fourth has no date."""
    k = F.col("txn_id")
    rows = ledger(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (F.floor(k / 100) % 5).alias("chunk_no"), k.alias("line_no"), F.when(k % 4 != 0, F.trunc("transaction_date", "year")).alias("transaction_date"), "direction", F.floor(F.col("amount") / 10000).cast("decimal(14,2)").alias("amount"), F.col("merchant_raw").alias("description"))
    return intake.merged_chunks(rows).select("doc_id", "line_no")


@query("SELECT o_custkey AS doc_id, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS bank, arg_min(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 0) AS opening FROM orders GROUP BY ALL")
def g6_merged_metadata(spark, sf_dir):
    k = F.col("o_orderkey")
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("chunk_no"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("bank"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("opening"))
    return intake.merged_metadata(chunks)


@query("""WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, source FROM documents WHERE doc_id % 10 <> 0)
    SELECT source AS table_id, k AS chunk_no, count(*) AS rows, min(doc_id) AS first_row, max(doc_id) AS last_row FROM d, range(0, (SELECT count(*) FROM documents)) t(k) WHERE place >= k * 112 AND place < k * 112 + 120 AND k <= greatest(ceil((n - 120) / 112.0), 0) GROUP BY ALL""")
def e12_row_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("row_no"), F.lit("x").alias("line"), (F.col("doc_id") % 10 == 0).alias("is_header"))
    return base.longs(intake.row_chunks(lines).groupBy(F.col("doc_id").alias("table_id"), "chunk_no").agg(F.count("*").alias("rows"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row")), "chunk_no")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM documents),
    w AS (
        SELECT doc_id, t, -1 AS chunk_no, 0::BIGINT AS first, 240::BIGINT AS last FROM t WHERE t <> ''
        UNION ALL
        SELECT doc_id, t, chunk_no + 1, start, CASE WHEN start + 1800 < length(t) AND length(regexp_extract(win, '^(.*) ', 1)) > 900 THEN start + length(regexp_extract(win, '^(.*) ', 1)) ELSE least(start + 1800, length(t)) END
        FROM (SELECT *, last - 240 AS start, substr(t, last - 239, 1800) AS win FROM w WHERE last < length(t) OR chunk_no < 0))
    SELECT doc_id, chunk_no::BIGINT AS chunk_no, sha256(trim(substr(t, first + 1, last - first))) AS chunk_sha256 FROM w WHERE chunk_no >= 0""")
def e12_word_chunks(spark, sf_dir):
    return base.longs(documents.word_chunks(table(spark, sf_dir, "documents")).drop("chunk"), "chunk_no")


#: What ends a line, and what stands around one, as Python has it.
LINE_ENDS, WHITE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""WITH RECURSIVE l AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {quoted(LINE_ENDS)}), lambda x: regexp_replace(x, {quoted(f"^{WHITE}|{WHITE}$")}, '', 'g')), lambda x: x <> '') AS lines FROM documents),
    c AS (SELECT doc_id, lines, len(lines) AS n, list_transform(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda y: length(y) + 1))) AS ends FROM l WHERE len(lines) > 0),
    w AS (
        SELECT doc_id, 0 AS chunk_no, 0::BIGINT AS first, greatest(1, len(list_filter(ends, lambda x: x <= {rules.LINE_CHUNK}))) AS last FROM c
        UNION ALL
        SELECT doc_id, chunk_no + 1, t, greatest(t + 1, len(list_filter(ends, lambda x: x <= ends[t] + {rules.LINE_CHUNK})))
        FROM (SELECT w.doc_id, chunk_no, greatest(first + 1, last - {rules.LINE_OVERLAP}) AS t, ends FROM w JOIN c USING (doc_id) WHERE last < n AND chunk_no + 1 < {rules.MOST_LINE_CHUNKS}))
    SELECT doc_id, chunk_no::BIGINT AS chunk_no, sha256(array_to_string(lines[first + 1:last], chr(10))) AS chunk_sha256 FROM w JOIN c USING (doc_id)""")
def e12_line_chunks(spark, sf_dir):
    return base.longs(intake.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256")), "chunk_no")


@query(with_(LEDGER, ROWS, "f AS (SELECT *, (user_id * 31 + month(period_start)) % 400 AS file_id FROM statements)", "h AS (SELECT *, CASE WHEN file_id % 5 <> 0 THEN file_id % 150 END AS file_hash FROM f)",
    "n AS (SELECT user_id, file_hash, count(*) AS n FROM h WHERE file_hash IS NOT NULL GROUP BY ALL)", select="SELECT statement_id, coalesce(n, 1) AS reprocess_count FROM h LEFT JOIN n USING (user_id, file_hash) WHERE row_count % 4 <> 0"))
def c4_statement_list(spark, sf_dir):
    """Statements of files of which some have one content, and some are unknown."""
    s = statements(statement_rows(ledger(spark, sf_dir))).withColumn("file_id", (F.col("user_id") * 31 + F.month("period_start")) % 400).withColumn("is_active", F.col("row_count") % 4 != 0)
    files = spark.range(400).select(F.col("id").alias("file_id"), F.lit("x").alias("file_name"), (F.col("id") % 150).alias("file_hash")).where("file_id % 5 <> 0")
    return intake.statement_list(s, files).select("statement_id", "reprocess_count")


@query(with_(LEDGER, "p AS (SELECT txn_id FROM ledger)", select="SELECT txn_id AS parsed_id, CASE WHEN txn_id % 2 = 0 THEN txn_id + 7 END AS txn_id, CASE WHEN txn_id % 6 = 0 THEN 'b,a' ELSE '' END AS notes FROM p"))
def c9_statement_review(spark, sf_dir):
    k = F.col("parsed_id")
    p = ledger(spark, sf_dir).select(F.col("txn_id").alias("parsed_id"))
    sources = p.where(k % 2 == 0).select(k, (k + 7).alias("txn_id"))
    notes = p.where(k % 6 == 0).select(k, F.lit(2).alias("created_at"), F.lit("a").alias("note")).unionByName(p.where(k % 6 == 0).select(k, F.lit(1).alias("created_at"), F.lit("b").alias("note")))
    return review.statement_review(p, sources, notes).withColumn("notes", F.array_join("notes", ","))


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = statement_rows(ledger(spark, sf_dir)).withColumn("is_quarantined", F.col("txn_id") % 3 == 0)
    tasks = rows.select("statement_id", "user_id").distinct().select(F.concat(F.lit("t"), "statement_id").alias("task_id"), "statement_id", F.when(F.col("user_id") % 5 != 0, "open").otherwise("resolved").alias("status"))
    u = F.split("statement_id", "-")[0].cast("int")
    return tasks, rows, tasks.select("task_id", F.when(u % 3 == 0, " Promote").when(u % 3 == 1, "ignore").otherwise("wait").alias("action"), F.when(u % 2 == 0, "checked").alias("reason"))


@query(with_(LEDGER, ROWS, "t AS (SELECT statement_id, user_id, user_id % 5 <> 0 AND user_id % 3 <> 2 AS taken, count(*) FILTER (txn_id % 3 = 0) AS n FROM stmt_rows GROUP BY ALL)",
    select="SELECT 't' || statement_id AS task_id, statement_id, CASE WHEN taken OR user_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN taken THEN CASE WHEN user_id % 3 = 0 THEN n ELSE 0 END END AS promoted_count, CASE WHEN taken THEN CASE WHEN user_id % 3 = 1 THEN n ELSE 0 END END AS ignored_count, CASE WHEN taken THEN CASE WHEN user_id % 3 = 0 THEN 'parsed' ELSE 'partial' END END AS parse_status FROM t"))
def j8_resolved_tasks(spark, sf_dir):
    return base.longs(review.resolved(*_tasks(spark, sf_dir)).tasks, "promoted_count", "ignored_count")


@query(with_(LEDGER, select="SELECT txn_id, txn_id % 3 = 0 AND NOT (user_id % 5 <> 0 AND user_id % 3 <> 2) AS is_quarantined, CASE WHEN txn_id % 3 = 0 AND user_id % 5 <> 0 AND user_id % 3 <> 2 THEN CASE WHEN user_id % 2 = 0 THEN 'checked' WHEN user_id % 3 = 0 THEN 'manual_promote' ELSE 'manual_ignore' END END AS override_reason FROM ledger"))
def j8_resolved_rows(spark, sf_dir):
    return review.resolved(*_tasks(spark, sf_dir)).parsed.select("txn_id", "is_quarantined", "override_reason")


@query()
def j3_promoted(spark, sf_dir):
    """The SMS feed against every second entry: each row links to an entry or an earlier row of the feed, or becomes an entry."""
    from ..operators import dedup
    from .ledger import sms_feed

    rows = ledger(spark, sf_dir)
    keyed = lambda df: df.withColumn("amount", F.floor(F.col("amount") / 20000).cast("decimal(14,2)")).withColumn("fingerprint", dedup.fingerprint()).withColumn("reference_number", F.when(F.col("txn_id") % 13 == 0, F.concat(F.lit("REF"), (F.col("txn_id") % 1000).cast("string"))))
    return review.promoted(keyed(sms_feed(rows)), keyed(rows.where("txn_id % 64 < 32"))).links


@query(with_(LEDGER, select="SELECT user_id, count(*) AS total, count(*) FILTER (nature <> CASE WHEN txn_id % 4 = 0 THEN 'expense' ELSE nature END) AS updated FROM ledger GROUP BY ALL"))
def i21_reclassified(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("nature", F.when(F.col("txn_id") % 4 == 0, "expense").otherwise(F.col("nature")))
    return review.reclassified(rows)[1]


ACTIONS = ("set_category", "set_nature", "set_notes", "exclude_transaction", "include_transaction", "jump")
VALUES = ("1-urgent", "Income", " ", "salary", "5-LOW ")


@query(with_(LEDGER, f"a AS (SELECT txn_id AS action_id, CASE WHEN txn_id % 50 = 0 THEN -1 ELSE txn_id END AS txn_id, {listed(ACTIONS)}[(txn_id % 6)::INT + 1] AS action, trim({listed(VALUES)}[(txn_id // 7 % 5)::INT + 1]) AS v FROM ledger)",
    "n AS (SELECT DISTINCT category_name AS name FROM ledger WHERE category_name IS NOT NULL)",
    f"""w AS (SELECT a.*, l.category_name, l.nature, l.notes, l.is_excluded, n.name, CASE WHEN l.txn_id IS NULL THEN 'Unknown transaction.' WHEN action = 'set_category' AND n.name IS NULL THEN CASE WHEN v = '' THEN 'Missing category_name.' ELSE 'Unknown category ''' || v || '''.' END
        WHEN action = 'set_nature' AND NOT list_contains({listed(rules.SETTABLE_NATURES)}, lower(v)) THEN CASE WHEN v = '' THEN 'Missing transaction_nature.' ELSE 'Disallowed nature ''' || lower(v) || '''.' END
        WHEN action = 'set_notes' AND v = '' THEN 'Empty notes.' WHEN action = 'jump' THEN 'Unknown action.' END AS skipped
        FROM a LEFT JOIN ledger l ON a.txn_id = l.txn_id LEFT JOIN n ON lower(n.name) = lower(v))""",
    select="""SELECT action_id, action, skipped, CASE WHEN skipped IS NULL THEN CASE action WHEN 'set_category' THEN 'category_name' WHEN 'set_nature' THEN 'nature' WHEN 'set_notes' THEN 'notes' ELSE 'is_excluded' END END AS field,
        CASE WHEN skipped IS NULL THEN CASE action WHEN 'set_category' THEN category_name WHEN 'set_nature' THEN nature WHEN 'set_notes' THEN notes ELSE is_excluded::VARCHAR END END AS old_value,
        CASE WHEN skipped IS NULL THEN CASE action WHEN 'set_category' THEN name WHEN 'set_nature' THEN lower(v) WHEN 'set_notes' THEN v ELSE (action = 'exclude_transaction')::VARCHAR END END AS new_value FROM w"""))
def p6_planned_corrections(spark, sf_dir):
    rows, k = ledger(spark, sf_dir), F.col("txn_id")
    actions = rows.select(k.alias("action_id"), F.when(k % 50 == 0, -1).otherwise(k).alias("txn_id"), _pick(ACTIONS, k).alias("action"), _pick(VALUES, F.floor(k / 7)).alias("value"))
    return review.planned(actions, rows, rows.where("category_name IS NOT NULL").select(F.col("category_name").alias("name")).distinct()).drop("txn_id")


@query(with_(LEDGER, "s AS (SELECT txn_id AS source_id, txn_id * 10 + k AS child_id, k AS split_index FROM ledger, range(1, 3) t(k) WHERE txn_id % 50 = 0)", "e AS (SELECT txn_id FROM ledger UNION ALL SELECT child_id FROM s)",
    select="SELECT txn_id, p.source_id AS parent_id, coalesce((SELECT string_agg(child_id, ',' ORDER BY split_index) FROM s c WHERE c.source_id = txn_id), '') AS children FROM e LEFT JOIN s p ON p.child_id = txn_id WHERE p.source_id IS NOT NULL OR txn_id IN (SELECT source_id FROM s)"))
def c7_split_family(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("txn_id")
    splits = rows.where("txn_id % 50 = 0").select(F.col("txn_id").alias("source_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("split_index")).withColumn("child_id", F.col("source_id") * 10 + F.col("split_index"))
    # A key that the ledger and the children share would be two rows of one entry: children are numbered apart.
    everyone = rows.unionByName(splits.select(F.col("child_id").alias("txn_id")))
    return review.split_family(everyone, splits).withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


@query(with_(LEDGER, ROWS, select="SELECT user_id, upper(bank_name) AS institution_name, account_type, account_masked, min(period_start) AS opening_date, max(period_end) AS last_statement_date FROM statements GROUP BY ALL"))
def j12_accounts(spark, sf_dir):
    """The statements in two halves, the second one meeting the accounts that the first one made."""
    s = statements(statement_rows(ledger(spark, sf_dir))).withColumn("bank_name", F.concat(F.lit(" "), F.lower("bank_name")))
    return intake.accounts(s.where("row_count > 1"), intake.accounts(s.where("row_count <= 1")))


@query(with_(LEDGER, ROWS, select="SELECT user_id, bank_name, account_type, account_masked, period_start, period_end, max(statement_id) AS statement_id, arg_max(row_count % 2 = 0, statement_id) AS is_complete FROM statements WHERE user_id % 11 <> 0 GROUP BY ALL"))
def j13_coverage(spark, sf_dir):
    s = statements(statement_rows(ledger(spark, sf_dir))).withColumn("parse_status", F.when(F.col("row_count") % 2 == 0, "parsed").otherwise("partial")).withColumn("period_start", F.when(F.col("user_id") % 11 != 0, F.col("period_start")))
    return intake.coverage(s)


@query(with_(LEDGER, ROWS, select="SELECT user_id, bank_name, account_masked, count(DISTINCT (period_start, period_end)) AS periods, strftime(min(period_start), '%Y-%m-%d') AS first_start FROM statements GROUP BY ALL"))
def c8_covered_accounts(spark, sf_dir):
    s = statements(statement_rows(ledger(spark, sf_dir))).withColumn("parse_status", F.lit("parsed"))
    out = intake.covered_accounts(entries.accounts_tree(s), intake.coverage(s))
    return out.select("user_id", "bank_name", "account_masked", F.size("coverage").cast("long").alias("periods"), F.col("coverage")[0]["start"].cast("string").alias("first_start"))


@query(with_(LEDGER, ROWS, "p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period_end DESC, statement_id DESC) AS place FROM statements)",
    "f AS (SELECT *, (user_id % 4 <> 1 OR bank_name = 'BUILDING') AND (user_id % 3 = 0 OR (user_id % 3 = 1) = (account_type = 'credit_card')) AS fits FROM p WHERE place <= 12)",
    select="SELECT user_id, statement_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS place FROM (SELECT *, bool_or(fits) OVER (PARTITION BY user_id) AS one FROM f) WHERE fits OR NOT one QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) <= 5"))
def c18_recent_summaries(spark, sf_dir):
    u = F.col("user_id")
    s = statements(statement_rows(ledger(spark, sf_dir)))
    hints = s.select(u).distinct().select(u, F.when(u % 4 == 1, "building").alias("bank_hint"), F.when(u % 3 == 1, "credit_card").when(u % 3 == 2, "bank_account").alias("account_type_hint"))
    return base.longs(intake.recent_summaries(s, hints), "place")


@query(with_(LEDGER, "n AS (SELECT user_id, category_name, count(*) AS n FROM ledger WHERE category_name IS NOT NULL GROUP BY ALL)", "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category_name) AS place FROM n)", select="SELECT user_id, place, category_name || ' (' || n || ')' AS shown FROM r WHERE place <= 3"))
def d15_top_counts(spark, sf_dir):
    return base.longs(intake.top_counts(ledger(spark, sf_dir), ["user_id"], "category_name", 3), "place")


@query(with_(ARTIFACTS, f"k AS (SELECT unnest({listed(rules.TAX_DOCUMENTS)}) AS doc_type)", select="SELECT u.user_id, k.doc_type, (SELECT count(*) FROM artifacts a WHERE a.user_id = u.user_id AND a.doc_type = k.doc_type) AS documents FROM (SELECT DISTINCT user_id FROM artifacts) u, k"))
def d6_document_coverage(spark, sf_dir):
    return intake.document_coverage(artifacts(spark, sf_dir))


@query(with_(ARTIFACTS, select="SELECT artifact_id, CASE WHEN event = 0 THEN 'unsupported_bank' WHEN event = 1 THEN 'unknown_format' WHEN event = 2 THEN 'password_required' ELSE 'parse_error' END AS reason FROM (SELECT *, artifact_id // 7 % 4 AS event FROM artifacts) WHERE doc_type IN ('bank_statement', 'credit_card_statement') AND (status = 'failed' OR status = 'skipped' AND event < 2)"))
def b9_unread(spark, sf_dir):
    return intake.unread(artifacts(spark, sf_dir)).select("artifact_id", intake.queue_reason(F.col("parse_message")).alias("reason"))


@query(with_(ARTIFACTS, "f AS (SELECT event_id AS file_id, user_id % 40 AS user_id, 'p' || event_id AS file_name, ts AS created_at FROM events WHERE event_id % 3 = 0)", "f50 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id DESC) <= 20)",
    """s AS (SELECT user_id, file_id AS upload_id, file_name, created_at, CASE WHEN file_id % 2 = 0 THEN ['success', 'review_required', 'error', 'failed', 'reviewing'][(file_id % 5)::INT + 1] WHEN file_id % 7 = 0 THEN ['reviewing', 'duplicate', 'success', 'error', 'review_required'][(file_id % 5)::INT + 1] ELSE 'reviewing' END AS state FROM f50)""",
    "a AS (SELECT user_id, artifact_id + 10000000 AS upload_id, file_name, created_at, CASE status WHEN 'parsed' THEN 'success' WHEN 'failed' THEN 'failed' WHEN 'discovered' THEN 'reviewing' ELSE 'error' END AS state FROM artifacts WHERE doc_type NOT IN ('bank_statement', 'credit_card_statement') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, artifact_id DESC) <= 20)",
    select="SELECT user_id, upload_id, file_name, state, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id DESC) AS place FROM (SELECT * FROM s UNION ALL BY NAME SELECT * FROM a) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id DESC) <= 20"))
def g12_recent_uploads(spark, sf_dir):
    i = F.col("file_id")
    files = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("file_id"), (F.col("user_id") % 40).alias("user_id"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("file_name"), F.col("ts").alias("created_at"))
    s = files.where(i % 2 == 0).select(i, i.alias("statement_id"), _pick(("parsed", "review_required", "partial", "failed", "extracting"), i).alias("parse_status"))
    last = files.where(i % 7 == 0).select((i * 2 + 1).alias("job_id"), i, F.when(i % 5 == 0, "running").otherwise("completed").alias("status"), _pick(("", "duplicate", "Parsed ", "partial", "review_required"), i).alias("result_status"), "created_at")
    old = last.select((i * 2).alias("job_id"), i, F.lit("dlq").alias("status"), F.lit(None).cast("string").alias("result_status"), "created_at")
    return base.longs(intake.recent_uploads(files, s, last.unionByName(old), artifacts(spark, sf_dir).withColumn("artifact_id", F.col("artifact_id") + 10000000), 20).drop("created_at"), "place")


@query(with_("d AS (SELECT doc_id, lower(text) AS t, doc_id % 4 AS h FROM documents)", "m AS (SELECT *, contains(t, 'the') AS a, contains(t, 'and') AS b, contains(t, 'der') AS c FROM d)",
    select="SELECT doc_id, CASE WHEN h = 1 THEN CASE WHEN a THEN 1 WHEN c THEN 3 WHEN b THEN 2 ELSE 1 END WHEN h = 2 THEN CASE WHEN b THEN 2 WHEN a THEN 1 WHEN c THEN 3 ELSE 2 END WHEN h = 3 THEN CASE WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 ELSE 4 END ELSE CASE WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 END END AS parser_id FROM m"))
def i16_parsers(spark, sf_dir):
    """Parsers that common words give away; hints by remainder: a bank and its kind, a bank, a bank that no word tells, none."""
    registry = spark.createDataFrame([(1, "HDFC", "savings", "(?i)the"), (2, "SBI", "credit_card", "(?i)and"), (3, "HDFC", "credit_card", "(?i)der"), (4, "AXIS", "savings", "no such text")], "parser_id int, bank_name string, account_type string, detect string")
    h = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h == 1, "hdfc bank").when(h == 2, "SBI").when(h == 3, "AXIS").alias("bank_hint"), F.when(h == 1, "savings").alias("account_type_hint"))
    return base.longs(intake.parsers(docs, registry), "parser_id")


@query(with_("h AS (SELECT event_id, ['Savings-Statement', 'fixed deposit', ' PNL_statement', 'nothing', 'direct tax ack'][(event_id % 5)::INT + 1] AS hint FROM events)", select="SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'fd_report' WHEN 2 THEN 'demat_tax_report' WHEN 4 THEN 'tax_challan' END AS doc_type FROM h"))
def i24_document_types(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, intake.document_type(_pick(("Savings-Statement", "fixed deposit", " PNL_statement", "nothing", "direct tax ack"), i)).alias("doc_type"))


@query(with_(LEDGER, select=r"SELECT txn_id, regexp_extract(merchant_raw, '(?i)\b([A-Z0-9][A-Z0-9/\-:]{5,})\b', 1) AS reference FROM ledger"))
def h18_references(spark, sf_dir):
    return ledger(spark, sf_dir).select("txn_id", intake.reference(F.col("merchant_raw")).alias("reference"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.none') AS DECIMAL(18,2)), TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(18,2)))::DOUBLE AS value FROM events")
def h26_decimals(spark, sf_dir):
    return base.doubles(table(spark, sf_dir, "events").select("event_id", intake.decimal_of(F.col("props"), "none", "k").alias("value")), "value")


@query(with_(LEDGER, select="SELECT count(*) AS total FROM ledger WHERE user_id = 7 AND direction = 'debit'"))
def d17_total_count(spark, sf_dir):
    return review.total_count(insights.filtered(insights.of_user(ledger(spark, sf_dir), 7), direction="debit"))


@query("SELECT row_number() OVER (ORDER BY n_regionkey = 0 DESC, n_regionkey, n_name) AS place, n_name AS name FROM nation WHERE n_regionkey IN (0, 2, 3)")
def f7_categories(spark, sf_dir):
    """Nations as categories: those of region 0 are the system's, those of 1 another user's."""
    r = F.col("n_regionkey")
    c = table(spark, sf_dir, "nation").where(r != 4).select(F.col("n_name").alias("name"), F.when(r == 1, 8).when(r > 1, 7).alias("user_id"), (r == 0).alias("is_system"), r.alias("sort_order"))
    from pyspark.sql import Window as W  # the list is a user's categories: a short one

    return base.longs(review.category_list(c, 7).withColumn("place", F.row_number().over(W.orderBy(F.desc("is_system"), "sort_order", "name"))).select("place", "name"), "place")


@query("SELECT event_id AS match_id, CASE WHEN event_id % 4 = 0 THEN 'confirmed' WHEN event_id % 4 = 1 THEN 'rejected' ELSE 'pending' END AS resolution_status, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 0 OR event_id % 4 = 1 THEN 9 ELSE 1 END AS matched_at FROM (SELECT event_id FROM events) WHERE event_id % 4 <> 2 OR event_id % 3 <> 0 UNION ALL SELECT event_id, 'confirmed', 1 FROM events WHERE event_id % 4 = 2 AND event_id % 3 = 0"
       .replace("ELSE 'pending' END", "WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'pending' END"))
def j18_transfers_resolved(spark, sf_dir):
    i = F.col("match_id")
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("match_id"), "user_id", F.when(F.col("event_id") % 3 == 0, "confirmed").otherwise("pending").alias("resolution_status"), F.lit(1).alias("matched_at"))
    told = m.where(i % 4 < 2).select(i, "user_id", F.when(i % 4 == 0, "confirm").otherwise("reject").alias("decision")).unionByName(m.where(i % 4 == 3).select(i, (F.col("user_id") + 1).alias("user_id"), F.lit("confirm").alias("decision")))
    return review.transfers_resolved(m, told, F.lit(9)).drop("user_id")


@query("SELECT event_id, 'manual:' || kind || ':cash:my-' || event_type AS position_key, kind AS entry_kind, 'INR' AS currency, round(value, 2) AS balance FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'asset' ELSE 'liability' END AS kind FROM events WHERE event_id % 3 <> 2 AND event_id % 5 <> 0)")
def j17_manual_snapshots(spark, sf_dir):
    i = F.col("event_id")
    asked = table(spark, sf_dir, "events").select(i.alias("user_id"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" My "), "event_type")).alias("label"), _pick(("Asset ", "LIABILITY", "equity"), i).alias("entry_kind"), F.lit("Cash").alias("asset_type"), F.lit("").alias("position_key"), F.lit(None).cast("string").alias("currency"), F.col("value").alias("balance"), F.lit(date(2024, 1, 1)).alias("as_of_date"))
    return review.manual_snapshots(asked).select(F.col("user_id").alias("event_id"), "position_key", "entry_kind", "currency", "balance")


@query("SELECT job_id, min(status) AS status, min(n) AS attempts FROM (SELECT event_id AS job_id, 'running' AS status, 2 AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'queued', 0 FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0) GROUP BY ALL")
def o1_enqueued(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), "user_id", F.col("ts").alias("created_at"))
    queue = e.where("job_id % 2 = 0").withColumn("status", F.lit("running")).withColumn("attempts", F.lit(2))
    asked = e.where("job_id % 3 = 0")
    return base.longs(intake.enqueued(queue, asked.unionByName(asked)).select("job_id", "status", "attempts"), "attempts")


@query("WITH f AS (SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0 ORDER BY ts, event_id LIMIT 1) SELECT event_id AS job_id, CASE WHEN event_id = (FROM f) THEN 'queued' WHEN event_id % 3 = 0 THEN 'dlq' ELSE 'completed' END AS status, CASE WHEN event_id = (FROM f) OR event_id % 5 = 0 THEN 1 ELSE 0 END AS dlq_retry_count, event_id = (FROM f) AS relaxed FROM events")
def o4_dead_retry(spark, sf_dir):
    i = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(i.alias("job_id"), F.lit("parse_statement").alias("job_type"), F.when(i % 3 == 0, "dlq").otherwise("completed").alias("status"), (i % 5 == 0).cast("int").alias("dlq_retry_count"), F.col("ts").alias("finished_at"), F.lit(False).alias("relaxed"))
    return base.longs(intake.dead_retry(jobs).select("job_id", "status", "dlq_retry_count", "relaxed"), "dlq_retry_count")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'small' WHEN event_id % 4 = 1 THEN 'large' ELSE 'base' END AS model FROM events")
def p8_routed_model(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, intake.routed_model(_pick(("document_classification", "statement_extraction", "other"), i), _pick(("low", "high", "medium", "unknown"), i), "base", "small", "large").alias("model"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'review_required' WHEN 2 THEN 'error' WHEN 3 THEN 'failed' ELSE 'reviewing' END AS review, ['sms', 'manual', 'llm_vision', 'llm_text', 'ocr_llm', 'template'][(event_id % 6)::INT + 1] AS source FROM events")
def b12_mappings(spark, sf_dir):
    i = F.col("event_id")
    kind, method = _pick(("sms", "manual", "statement"), F.least(i % 6, F.lit(2))), _pick(("vision", "llm", " Vision", "LLM", "ocr", "template"), i)
    return table(spark, sf_dir, "events").select(i, intake.review_status(_pick((" Parsed", "review_required", "partial", "failed", "extracting"), i)).alias("review"), intake.ledger_source(kind, method).alias("source"))


def _tax_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deductions of a portal and lines of salary forms, from the totals by user."""
    return _tax_lines_of(base.portal(spark, sf_dir))


def _tax_lines_of(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    u = F.col("user_id")
    a = t.where(u % 7 != 0).select(u, _pick(("A", "A1", "B"), u).alias("part"), (F.col("self_paid_tax") / 4).cast("decimal(18,2)").alias("amount_tds"))
    f = t.where(u % 5 != 0).select(u, F.lit("tds").alias("head"), (F.coalesce((F.col("self_paid_tax") / 4).cast("decimal(18,2)"), F.lit(0)) + u % 3).cast("decimal(18,2)").alias("amount"))
    g = t.where(u % 2 == 0).select(u, F.lit("gross_salary").alias("head"), F.coalesce("gross_salary", F.lit(0)).cast("decimal(18,2)").alias("amount"))
    return a, f.unionByName(g)


TAX_LINES = """tds AS (SELECT user_id, ['A', 'A1', 'B'][(user_id % 3)::INT + 1] AS part, round(self_paid_tax / 4, 2)::DECIMAL(18,2) AS tds FROM portal WHERE user_id % 7 <> 0),
forms AS (SELECT user_id, coalesce(round(self_paid_tax / 4, 2), 0)::DECIMAL(18,2) + user_id % 3 AS tds FROM portal WHERE user_id % 5 <> 0),
lined AS (SELECT user_id, coalesce(p.tds, 0) AS p, coalesce(f.tds, 0) AS l FROM (SELECT user_id, sum(tds) AS tds FROM tds WHERE part <> 'B' GROUP BY ALL) p FULL JOIN forms f USING (user_id))"""
KIND = "CASE WHEN abs(p - l) <= 1 AND p > 0 THEN 'matched' WHEN p > 0 AND l = 0 THEN 'missing_in_ledger' WHEN l > 0 AND p = 0 THEN 'missing_in_portal' ELSE 'amount_mismatch' END"


@query(with_(LEDGER, TOTALS, PORTAL, TAX_LINES, select=f"SELECT user_id, p::DOUBLE AS portal_amount, l::DOUBLE AS ledger_amount, {KIND} AS kind FROM lined WHERE p <> 0 OR l <> 0"))
def m6_tds_lines(spark, sf_dir):
    return base.doubles(reconcile.tds_lines(*_tax_lines(spark, sf_dir)).drop("delta"), "portal_amount", "ledger_amount")


@query()
def m8_all_reports(spark, sf_dir):
    """All four reports: by lines for users who have some, else by sums."""
    # Figures by user, and a year's income, are read by several reports.
    p, b = written(base.portal(spark, sf_dir), "portal"), written(reconcile.ledger_buckets(ledger(spark, sf_dir), base.FIRST, base.LAST), "buckets")
    deducted, forms = _tax_lines_of(p)
    year = written(base.income_rows(ledger(spark, sf_dir)).where("fy = '1999-00'").select("txn_id", "user_id", "fy", "bucket", "amount"), "income-year")
    lines = base.portal_lines(year).where("user_id % 3 = 0")
    documented = forms.where("head = 'tds'").select("user_id", "amount")
    summed = p.select("user_id", (F.col("self_paid_tax") / 4).cast("decimal(24,2)").alias("tds_total"))
    reports = (
        ("form16", reconcile.by_lines_or_sums(forms.where("head = 'gross_salary'"), reconcile.form16_lines(forms, b), reconcile.form16(p, b))),
        ("26as_tds", reconcile.by_lines_or_sums(deducted, reconcile.tds_lines(deducted, forms), reconcile.tds(summed, documented))),
        ("26as_self_paid", reconcile.self_paid(p, b)),
        ("ais", reconcile.by_lines_or_sums(lines, reconcile.ais_lines(lines, year, matching.portal_matches(lines, year)), reconcile.ais_buckets(p, b))),
    )
    out = reconcile.all_reports(*(reconcile.report(df, name) for name, df in reports))
    return base.longs(base.doubles(out, "portal_total", "ledger_total"), "matched", "missing_in_ledger", "missing_in_portal", "amount_mismatch")


@query(with_(LEDGER, TOTALS, BUCKETS, PORTAL, "f AS (SELECT user_id, coalesce(gross_salary, 0) AS p FROM portal WHERE user_id % 2 = 0)", "b AS (SELECT user_id, amount AS l FROM buckets WHERE bucket = 'salary')",
    select="SELECT user_id, p::DOUBLE AS portal_amount, l::DOUBLE AS ledger_amount, CASE WHEN l IS NULL THEN 'missing_in_ledger' WHEN abs(p - l) <= 100 OR abs(p - l)::DOUBLE / greatest(p, l)::DOUBLE <= 0.05 THEN 'matched' ELSE 'amount_mismatch' END AS kind FROM f LEFT JOIN b USING (user_id) WHERE p > 0"))
def m8_form16_lines(spark, sf_dir):
    b = reconcile.ledger_buckets(ledger(spark, sf_dir), base.FIRST, base.LAST)
    return base.doubles(reconcile.form16_lines(_tax_lines(spark, sf_dir)[1], b).drop("delta"), "portal_amount", "ledger_amount")


@query(with_(LEDGER, select="SELECT user_id, CASE WHEN a = 0 AND b = 0 THEN 'no_data' WHEN abs(a - b) <= 500 THEN 'matched' ELSE 'review_required' END AS status FROM (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE user_id * 100 END AS a, CASE WHEN user_id % 8 = 0 THEN 0 ELSE user_id * 100 + user_id % 7 * 100 END AS b FROM (SELECT DISTINCT user_id FROM ledger))"))
def m9_linkage(spark, sf_dir):
    u = F.col("user_id")
    return ledger(spark, sf_dir).select(u).distinct().select(u, reconcile.linkage(F.when(u % 4 == 0, None).otherwise(u * 100), F.when(u % 8 == 0, 0).otherwise(u * 100 + u % 7 * 100), 500).alias("status"))


@query(with_(LEDGER, select="SELECT DISTINCT ON (user_id, ym) user_id, ym AS month FROM (SELECT user_id, strftime(transaction_date, '%Y-%m') AS ym FROM ledger WHERE user_id = 7 AND transaction_date >= DATE '1999-03-01' AND transaction_date < DATE '1999-04-01')"))
def b3_month_range(spark, sf_dir):
    """A user's entries of one month, as a half-open range that reaches the scan."""
    rows = insights.of_user(ledger(spark, sf_dir), 7).where((F.col("transaction_date") >= F.lit(date(1999, 3, 1))) & (F.col("transaction_date") < F.lit(date(1999, 4, 1))))
    return rows.select("user_id", dates.month(F.col("transaction_date")).alias("month")).distinct()


@query(with_(LEDGER, "c AS (SELECT DISTINCT category_name, 'Name of ' || category_name AS shown FROM ledger WHERE category_name IS NOT NULL AND category_name <> '5-LOW')", select="SELECT txn_id, coalesce(shown, 'Uncategorized') AS category FROM ledger LEFT JOIN c USING (category_name)"))
def c1_category_names(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    names = rows.where("category_name <> '5-LOW'").select(F.col("category_name").alias("category_id")).distinct().withColumn("name", F.concat(F.lit("Name of "), "category_id"))
    return insights.with_category_names(rows.withColumnRenamed("category_name", "category_id"), names).select("txn_id", "category")


@query("""WITH c AS (SELECT source AS doc_id, doc_id AS row_no, lang || CASE WHEN n_chars % 3 = 0 THEN '' ELSE ' | ' || n_chars % 50 END AS line, doc_id % 4 = 0 AS h FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, h ORDER BY row_no) AS again FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS place FROM k WHERE NOT h OR again = 1)
    SELECT doc_id AS table_id, row_no, line FROM p WHERE place <= 60""")
def a4_stitched_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cells = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("row_no"), F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.when(F.col("n_chars") % 3 == 0, "").otherwise((F.col("n_chars") % 50).cast("string"))).alias("cells"), (F.col("doc_id") % 4 == 0).alias("is_header"))
    return documents.stitched_rows(cells, 60).withColumnRenamed("doc_id", "table_id")


@query(with_(LEDGER, select="SELECT txn_id FROM ledger WHERE txn_id IN (1, 2, 3, 33, 64, 99, 1000000007)"))
def b5_listed(spark, sf_dir):
    return insights.filtered(ledger(spark, sf_dir), ids=[1, 2, 3, 33, 64, 99, 1000000007]).select("txn_id")


@query(with_(LEDGER, select="SELECT txn_id, CASE WHEN txn_id % 3 = 0 THEN 'f' || txn_id % 5 ELSE least('f' || txn_id % 5, 'f' || (txn_id + 7) % 5) || ',' || greatest('f' || txn_id % 5, 'f' || (txn_id + 7) % 5) END AS files FROM ledger"))
def c3_source_files(spark, sf_dir):
    """Two sources an entry (one file for every third), each from a statement of a file."""
    k = F.col("txn_id")
    e = ledger(spark, sf_dir).select(k)
    sources = e.select(k, (k * 2).alias("parsed_id")).unionByName(e.select(k, (k * 2 + 1).alias("parsed_id")))
    parsed = e.select((k * 2).alias("parsed_id"), (k % 5).alias("statement_id")).unionByName(e.select((k * 2 + 1).alias("parsed_id"), F.when(k % 3 == 0, k % 5).otherwise((k + 7) % 5).alias("statement_id")))
    five = spark.range(5)
    out = entries.source_files(sources, parsed, five.select(F.col("id").alias("statement_id"), F.col("id").alias("file_id")), five.select(F.col("id").alias("file_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name")))
    return out.withColumn("files", F.array_join("files", ","))


@query(with_(LEDGER, ROWS, select="SELECT statement_id, CASE WHEN user_id % 3 <> 0 THEN due_date - DATE '2001-08-01' END AS days_until_due FROM statements"))
def h22_days_until_due(spark, sf_dir):
    s = statements(statement_rows(ledger(spark, sf_dir))).withColumn("paid", F.when(F.col("user_id") % 3 == 0, True))
    return base.longs(balance.days_until_due(s, base.AS_OF).select("statement_id", "days_until_due"), "days_until_due")


@query(with_(LEDGER, select="SELECT txn_id, CASE txn_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS expected_rows, txn_id % 4 < 2 AS is_row FROM ledger"))
def h25_expected_rows(spark, sf_dir):
    """Texts of two rows, one row in a table, a total and a row without an amount."""
    k = F.col("txn_id")
    row = F.concat(F.date_format("transaction_date", "dd/MM/yyyy"), F.lit(" "), "merchant_raw", F.lit(" "), F.format_number(F.col("amount"), 2))
    no = F.concat(F.date_format("transaction_date", "dd/MM/yyyy"), F.lit(" Opening balance "), F.format_number(F.col("amount"), 2))
    body = F.when(k % 4 == 0, F.concat(row, F.lit("\n"), row)).when(k % 4 == 2, no).when(k % 4 == 3, F.concat(F.date_format("transaction_date", "dd/MM/yyyy"), F.lit(" no amount here")))
    out = ledger(spark, sf_dir).select(k, text.expected_rows(body, F.when(k % 4 == 1, F.array(row))).alias("expected_rows"), F.coalesce(text.looks_like_row(F.when(k % 4 == 1, row).otherwise(F.split(body, "\n")[0])), F.lit(False)).alias("is_row"))
    return base.longs(out, "expected_rows")


@query(f"SELECT event_id, nullif({listed([*(c for _, c in rules.WEB_RULES), 'none'])}[(event_id % 7)::INT + 1], 'none') AS guess FROM events")
def i5_web_categories(spark, sf_dir):
    words = tuple(f"Its pages call it {w[0].lower()} and more" for w, _ in rules.WEB_RULES)
    return table(spark, sf_dir, "events").select("event_id", classify.category_of_web_text(_pick((*words, "nothing"), F.col("event_id"))).alias("guess"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SBI' WHEN 1 THEN 'HDFC' WHEN 2 THEN 'BOB' END AS bank, CASE event_id % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'bank_account' WHEN 2 THEN 'auto' END AS kind FROM events")
def i15_aliases(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, classify.alias(_pick((" State Bank of India", "hdfc bank", "Baroda", "no bank"), i), rules.BANK_ALIASES).alias("bank"), classify.alias(_pick(("cc", " Savings", "auto_detect", "other"), i), rules.ACCOUNT_TYPE_ALIASES).alias("kind"))


@query("SELECT event_id, ['llm_vision', 'llm_text', 'ocr_llm', 'ocr_llm', 'template'][(event_id % 5)::INT + 1] AS source FROM events")
def i22_extraction_sources(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, classify.extraction_source(_pick(("LLM-Vision", "llm_1", "llm_2", "bank_1", "bank_2"), i), (i % 5).isin(2, 3)).alias("source"))


@query(with_(LEDGER, ROWS, select="SELECT statement_id, closing_balance::DOUBLE + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS balance FROM statements WHERE user_id % 3 <> 0 OR user_id % 4 = 0"))
def j11_upserted(spark, sf_dir):
    """Snapshots of two users in three; those of one in four come again, one rupee higher."""
    s = statements(statement_rows(ledger(spark, sf_dir))).select("statement_id", "user_id", F.col("closing_balance").alias("balance"))
    new = s.where("user_id % 4 = 0").withColumn("balance", (F.col("balance") + 1).cast("decimal(16,2)"))
    return base.doubles(entries.merged(s.where("user_id % 3 <> 0"), new, ["statement_id"]).select("statement_id", "balance"), "balance")


@query(with_(LEDGER, select="SELECT txn_id FROM ledger WHERE user_id <> 7"))
def j14_without_user(spark, sf_dir):
    return entries.without_user(ledger(spark, sf_dir), 7).select("txn_id")


@query("WITH f AS (" + ORACLE_SQL["e7_anomalies"] + ") SELECT f.txn_id, f.user_id, row_number() OVER (PARTITION BY f.user_id ORDER BY o_orderdate DESC, o_totalprice DESC, f.txn_id) AS place FROM f JOIN orders ON o_orderkey = txn_id QUALIFY place <= 5")
def f3_anomaly_list(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return base.longs(insights.anomaly_list(insights.anomalies(rows, base.AS_OF, 60, 1500, 1.6), rows, 5).select("txn_id", "user_id", "place"), "place")


@query(with_(LEDGER, select="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, category_name) AS place FROM (SELECT user_id, coalesce(category_name, 'Uncategorized') AS category_name, sum(amount)::DOUBLE AS amount FROM active WHERE direction = 'debit' GROUP BY ALL)"))
def d20_cashflow_categories(spark, sf_dir):
    return base.longs(base.doubles(insights.cashflow_categories(ledger(spark, sf_dir)), "amount"), "place")


@query(with_(LEDGER, ROWS, select="SELECT statement_id, coalesce(sum(amount) FILTER (direction = 'debit'), 0)::DOUBLE AS debits, coalesce(sum(amount) FILTER (direction = 'credit'), 0)::DOUBLE AS credits FROM stmt_rows WHERE account_type = 'credit_card' AND txn_id % 6 <> 0 GROUP BY ALL"))
def d16_unquarantined_totals(spark, sf_dir):
    rows = statement_rows(ledger(spark, sf_dir)).withColumn("is_quarantined", F.when(F.col("txn_id") % 3 == 0, F.col("txn_id") % 6 == 0))
    return base.doubles(entries.card_totals(rows), "debits", "credits")


@query(with_(LEDGER, ROWS, select="SELECT user_id, count(*) FILTER (row_count = 1) AS pending FROM statements GROUP BY ALL"))
def d21_pending_reviews(spark, sf_dir):
    return entries.pending_reviews(statements(statement_rows(ledger(spark, sf_dir))).withColumn("status", F.when(F.col("row_count") == 1, "open").otherwise("resolved")))


@query(with_(LEDGER, INCOME, select="SELECT user_id, amount::DOUBLE AS portal_amount, CASE WHEN txn_id % 4 = 0 THEN amount::DOUBLE END AS ledger_amount, CASE WHEN txn_id % 4 = 0 THEN 'matched' ELSE 'missing_in_ledger' END AS kind FROM income WHERE txn_id % 5 <> 0 UNION ALL SELECT user_id, NULL, amount::DOUBLE, 'missing_in_portal' FROM income WHERE (txn_id % 4 <> 0 OR txn_id % 5 = 0) AND (bucket <> 'interest' OR amount >= 100)"))
def c15_line_outcomes(spark, sf_dir):
    """Entries of which the portal lacks every fifth, every fourth of its lines matched beforehand."""
    rows = base.income_rows(ledger(spark, sf_dir))
    lines = rows.where("txn_id % 5 <> 0").select(F.col("txn_id").alias("line_id"), "user_id", "fy", "bucket", "amount")
    return base.doubles(reconcile.ais_lines(lines, rows, lines.where("line_id % 4 = 0").select("line_id", F.col("line_id").alias("txn_id"))), "portal_amount", "ledger_amount")


@query()
def j16_unmatched(spark, sf_dir):
    """Transfers of each user's newest 300 that no pair holds."""
    rows = transfer_feed(ledger(spark, sf_dir)).withColumn("nature", F.lit("transfer_internal"))
    return matching.unmatched_transfers(rows, matching.transfer_pairs(insights.active(rows), 7)).select("txn_id", "user_id")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_event_windows(spark, sf_dir):
    """Extension: counts of events by hour, as the stream's windows keep them."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return base.longs(e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n"), "n")


def _category_sql() -> str:
    rows = ", ".join(f"({quoted(p)}, [{', '.join(map(quoted, c))}]::VARCHAR[], {k})" for k, (p, c) in enumerate(seeds.CATEGORIES.items()))
    return f"WITH t(name, children, place) AS (VALUES {rows}) SELECT name AS category_id, NULL AS parent_id, name, place AS sort_order FROM t UNION ALL SELECT t.name || ' > ' || children[k], t.name, children[k], k - 1 FROM t, range(1, len(children) + 1) r(k)"


@query(_category_sql())
def a13_categories(spark, sf_dir):
    return base.longs(seeds.categories(spark).drop("is_system"), "sort_order")


@query(with_(LEDGER, TOTALS, BUCKETS, PORTAL, "o AS (SELECT user_id, CASE WHEN gross_salary IS NULL THEN 'x' WHEN l IS NULL THEN 'y' WHEN abs(gross_salary - l) <= 100 THEN 'matched' ELSE 'z' END AS kind FROM portal FULL JOIN (SELECT user_id, amount AS l FROM buckets WHERE bucket = 'salary') b USING (user_id) WHERE gross_salary IS NOT NULL OR l IS NOT NULL)",
    "e AS (SELECT user_id, count(*) AS entries, coalesce(sum(amount) FILTER (direction = 'credit'), 0)::DOUBLE AS credits, coalesce(sum(amount) FILTER (direction = 'debit'), 0)::DOUBLE AS debits FROM active GROUP BY ALL)",
    select="SELECT e.*, count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind <> 'matched') AS open, (SELECT count(*) FROM events WHERE events.user_id % 40 = e.user_id) AS documents FROM e LEFT JOIN o USING (user_id) GROUP BY ALL"))
def a11_pack_summary(spark, sf_dir):
    """The summary of the packs of all users; the other frames are those of their own queries."""
    rows = ledger(spark, sf_dir)
    found = reconcile.form16(base.portal(spark, sf_dir), reconcile.ledger_buckets(rows, base.FIRST, base.LAST))
    people = rows.select("user_id").distinct()
    frames = seeds.pack_frames(rows, people, people, {"Form-16": found}, artifacts(spark, sf_dir).select("user_id", "file_name", "doc_type", "status"), ["amounts are the ledger's"])
    return base.doubles(frames["summary"], "credits", "debits")


TAX_KINDS = ("interest_certificate", "fd_report", "tax_challan", "ppf_statement", "tax_form")


@query(f"""WITH e AS (SELECT event_id AS doc_id, event_id % 5 AS k, (event_id * 10)::DOUBLE AS a FROM events), r AS (
    SELECT doc_id, unnest(CASE k WHEN 0 THEN [{{'field': 'interest_amount', 'amount': a, 'value': NULL}}, {{'field': 'tds_amount', 'amount': a + 1.5, 'value': NULL}}]
        WHEN 1 THEN [{{'field': 'principal_total', 'amount': a + 100, 'value': NULL}}, {{'field': 'interest_total', 'amount': 0, 'value': NULL}}, {{'field': 'maturity_total', 'amount': 7, 'value': NULL}}, {{'field': 'fd_count', 'amount': 2, 'value': NULL}}]
        WHEN 2 THEN [{{'field': 'tax_paid_amount', 'amount': a, 'value': NULL}}, {{'field': 'cin', 'amount': NULL, 'value': 'AB12345678'}}, {{'field': 'bsr_code', 'amount': NULL, 'value': '1234567'}}, {{'field': 'challan_serial_no', 'amount': NULL, 'value': '00123'}}, {{'field': 'challan_date', 'amount': NULL, 'value': '2000-02-03'}}]
        WHEN 3 THEN [{{'field': 'opening_balance', 'amount': a, 'value': NULL}}, {{'field': 'closing_balance', 'amount': a + 5, 'value': NULL}}, {{'field': 'interest_amount', 'amount': 5, 'value': NULL}}, {{'field': 'contribution_amount', 'amount': 0, 'value': NULL}}, {{'field': 'ppf_account_masked', 'amount': NULL, 'value': 'XXXX5678'}}]
        ELSE [{{'field': 'gross_salary', 'amount': a, 'value': NULL}}, {{'field': 'tds_amount', 'amount': 0, 'value': NULL}}, {{'field': 'financial_year', 'amount': NULL, 'value': '2024-25'}}] END) AS s FROM e)
    SELECT doc_id, s.field, s.amount::DOUBLE AS amount, s.value FROM r""")
def m16_tax_document_fields(spark, sf_dir):
    i = F.col("event_id")
    a = F.format_number(i * 10, 0)
    body = (
        F.when(i % 5 == 0, F.concat(F.lit("Total interest paid: Rs. "), a, F.lit(" and total TDS Rs. "), F.format_number(i * 10 + 1.5, 2)))
        .when(i % 5 == 1, F.concat(F.lit("FD no 1 of this fixed deposit: principal amount "), a, F.lit("; principal amount 100; maturity value 7")))
        .when(i % 5 == 2, F.concat(F.lit("Challan No. 00123 BSR Code: 1234567 CIN: AB12345678 Challan Date: 03/02/2000 Tax paid Rs "), a))
        .when(i % 5 == 3, F.concat(F.lit("PPF Account No. 12345678 opening balance "), a, F.lit(" interest credited 5 closing balance "), F.format_number(i * 10 + 5, 0)))
        .otherwise(F.concat(F.lit("Form of FY: 2024 / 25 with gross salary of "), a))
    )
    docs = table(spark, sf_dir, "events").select(i.alias("doc_id"), _pick(TAX_KINDS, i).alias("doc_type"), body.alias("text"))
    return extract.tax_document_fields(docs, base.AS_OF)


def _statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as texts of savings statements, one a user and year: every fifth row goes on in a second line, and a page break follows every seventh.
    Such statements print no negative balances, so a document opens with a thousand million beyond all of its debits."""
    rows = ledger(spark, sf_dir).select("txn_id", "user_id", "transaction_date", "amount", "direction", "merchant_raw").withColumn("_doc", F.col("user_id") * 10000 + F.year("transaction_date"))
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    debits = F.coalesce(F.sum(F.when(F.col("direction") == "debit", F.col("amount"))).over(W.partitionBy("_doc")), F.lit(0))
    rows = rows.withColumn("_opening", (debits + F.lit(1_000_000_000)).cast("decimal(16,2)"))
    rows = rows.withColumn("_sum", (F.sum(signed).over(W.partitionBy("_doc").orderBy("transaction_date", "txn_id")) + F.col("_opening")).cast("decimal(16,2)"))
    sides = [F.when(F.col("direction") == d, F.col("amount").cast("string")).otherwise("0.00") for d in ("debit", "credit")]
    line = F.concat_ws(" ", F.date_format("transaction_date", "dd/MM/yyyy"), "merchant_raw", *sides, F.col("_sum").cast("string"))
    line = F.concat(line, F.when(F.col("txn_id") % 5 == 0, F.concat(F.lit("\n  ref of "), F.lower("direction"))).otherwise(""), F.when(F.col("txn_id") % 7 == 0, "\n\nPage 2\n").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("transaction_date", "txn_id", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.concat(F.lit("HDFC Bank\nSavings Account\nOpening Balance: "), F.format_number(F.max("_opening"), 2), F.lit("\nDate Narration Withdrawal Deposit Balance\n"))
    foot = F.lit("\nStatement Summary\n01/01/2024 NOT A ROW 1.00 0.00 1.00")
    return rows.groupBy(F.col("_doc").alias("doc_id")).agg(F.concat(head, body, foot).alias("text"))


@query(with_(LEDGER, "d AS (SELECT *, user_id * 10000 + year(transaction_date) AS doc_id FROM ledger)",
    "o AS (SELECT *, 1000000000 + coalesce(sum(amount) FILTER (direction = 'debit') OVER (PARTITION BY doc_id), 0) AS opening FROM d)", select="""
    SELECT doc_id, transaction_date, merchant_raw || CASE WHEN txn_id % 5 = 0 THEN ' ref of ' || direction ELSE '' END AS description, amount, direction,
        (opening + sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY doc_id ORDER BY transaction_date, txn_id))::DECIMAL(14,2) AS balance FROM o"""))
def k_statement_rows(spark, sf_dir):
    docs = statement_texts.detected(_statement_texts(spark, sf_dir), grammars.HDFC_SAVINGS)
    return statement_texts.rows(docs, grammars.HDFC_SAVINGS).drop("line_no", "posting_date")


def _papers(spark: SparkSession, sf_dir: str, line: Column, head: Column, foot: str, newest_first: bool = False) -> DataFrame:
    """The ledger, twenty years on, as texts of one user and year: a line or more an entry between head (an aggregate) and foot."""
    rows = ledger(spark, sf_dir).select("txn_id", "user_id", F.date_add("transaction_date", 7305).alias("day"), "amount", "direction", "merchant_raw").withColumn("doc_id", F.col("user_id") * 10000 + F.year("day"))
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    rows = rows.withColumn("balance", (F.sum(signed).over(W.partitionBy("doc_id").orderBy("day", "txn_id")) + F.lit(1_000_000_000)).cast("decimal(14,2)"))
    lines = F.sort_array(F.collect_list(F.struct("day", "txn_id", line.alias("line"))))
    lines = F.reverse(lines) if newest_first else lines
    return rows.groupBy("doc_id").agg(F.concat(head, F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit(foot)).alias("text"))


PAPERS = "papers AS (SELECT txn_id, user_id, transaction_date + 7305 AS day, amount, direction, merchant_raw, user_id * 10000 + year(transaction_date + 7305) AS doc_id FROM ledger)"
AS_OF = date(2024, 1, 1)


def _every(n: int, text: str) -> Column:
    return F.when(F.col("txn_id") % n == 0, text).otherwise("")


def _hdfc_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits by a plus sign; two lines go on with every fifth entry, and a page break follows every seventh."""
    line = F.concat(F.date_format("day", "dd/MM/yyyy | 10:45 "), "merchant_raw", F.when(F.col("direction") == "credit", " +").otherwise(""), F.lit(" C "), F.col("amount").cast("string"), F.lit(" l"), _every(5, "\n  more\n of it"), _every(7, "\n\nPage 2\n"))
    year, total = (F.col("doc_id") % 10000).cast("string"), F.sum("amount").cast("decimal(14,2)")
    head = F.concat(
        F.lit("HDFC Bank\nCredit Card Statement\nCard No: 5268 12XX XXXX "), F.lpad((F.floor(F.col("doc_id") / 10000) % 10000).cast("string"), 4, "0"), F.lit("\nStatement Date: 15/06/"), year, F.lit("\nTotal Dues: Rs. "), total.cast("string"),
        F.lit("\nMinimum Amount Due: "), F.max("amount").cast("string"), F.lit("\nPayment Due Date: 05 July, "), year, F.lit("\nDomestic Transactions\n"),
    )
    return statement_texts.detected(_papers(spark, sf_dir, line, head, "\nRewards Program\n01/01/2024 NOT A ROW 1.00"), grammars.HDFC_CARD)


@query(with_(LEDGER, PAPERS, select="SELECT doc_id, day AS transaction_date, merchant_raw || CASE WHEN txn_id % 5 = 0 THEN ' more of it' ELSE '' END AS description, amount, direction FROM papers"))
def k_hdfc_card_rows(spark, sf_dir):
    return cards.rows(_hdfc_cards(spark, sf_dir), grammars.HDFC_CARD, AS_OF).drop("line_no")


@query(with_(LEDGER, PAPERS, "d AS (SELECT doc_id, any_value(user_id) AS u, doc_id % 10000 AS y, sum(amount) AS total, max(amount) AS most, min(day) AS a, max(day) AS b FROM papers GROUP BY doc_id)", select="""
    SELECT doc_id, 'XXXX XXXX XXXX ' || lpad((u % 10000)::VARCHAR, 4, '0') AS account_masked, least(make_date(y, 6, 15) - 30, a) AS period_start, greatest(make_date(y, 6, 15), b) AS period_end, make_date(y, 7, 5) AS due_date,
        total::DECIMAL(14,2) AS total_due, most::DECIMAL(14,2) AS minimum_due FROM d"""))
def k_hdfc_card_summary(spark, sf_dir):
    """Only the day of the statement is told, so its period is thirty days, widened to its rows."""
    docs = written(_hdfc_cards(spark, sf_dir), "papers")
    meta = cards.metadata(docs, grammars.HDFC_CARD, AS_OF)
    return cards.widened(meta, cards.rows(docs, grammars.HDFC_CARD, AS_OF)).select("doc_id", "account_masked", "period_start", "period_end", "due_date", "total_due", "minimum_due")


@query(with_(LEDGER, PAPERS, select="SELECT doc_id, day AS transaction_date, merchant_raw || CASE WHEN txn_id % 5 = 0 THEN ' more' ELSE '' END AS description, amount, direction FROM papers"))
def k_sbi_card_rows(spark, sf_dir):
    """A second line goes on with every fifth entry, a third one doesn't; after every eleventh the section ends, and another begins."""
    line = F.concat(F.date_format("day", "dd MMM yy "), "merchant_raw", F.lit(" "), F.col("amount").cast("string"), F.when(F.col("direction") == "credit", " Cr").otherwise(""), _every(5, "\nmore\nthan one"), _every(7, "\nSBI Card Page 2"), _every(11, "\nReward Summary\n01 Jan 24 NOT A ROW 1.00\nNew Transactions"))
    docs = statement_texts.detected(_papers(spark, sf_dir, line, F.lit("SBI Card Statement\nTransaction Details\n"), "\nAccount Summary\n01 Jan 24 NOT A ROW 1.00"), grammars.SBI_CARD)
    return cards.rows(docs, grammars.SBI_CARD, AS_OF).drop("line_no")


@query(with_(LEDGER, PAPERS, select="SELECT doc_id, day AS transaction_date, merchant_raw || CASE WHEN txn_id % 5 = 0 THEN ' more' ELSE '' END AS description, amount, direction FROM papers"))
def k_axis_card_rows(spark, sf_dir):
    """Every third entry has a cashback of its own."""
    mark = F.when(F.col("direction") == "credit", " Cr").otherwise(" Dr")
    line = F.concat(F.date_format("day", "dd-MMM-yyyy "), "merchant_raw", F.lit(" "), F.col("amount").cast("string"), mark, _every(3, " 1.00 Cr"), _every(5, "\nmore\nthan one"), _every(7, "\n\nPage 2"))
    docs = statement_texts.detected(_papers(spark, sf_dir, line, F.lit("Axis Bank\nCard Statement\n"), "\nEnd of Statement\nno more"), grammars.AXIS_CARD)
    return cards.rows(docs, grammars.AXIS_CARD, AS_OF).drop("line_no")


def _passbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first; neither sides nor an opening balance are told. An overdrawn balance is printed as a passbook does, without a sign and as a debit."""
    balance = F.concat(F.abs("balance").cast("string"), F.when(F.col("balance") < 0, "Dr").otherwise("Cr"))
    line = F.concat(F.date_format("day", "dd-MM-yyyy dd-MM-yyyy "), "merchant_raw", F.lit(" "), F.col("amount").cast("string"), F.lit(" "), balance, _every(5, "\nmore"), _every(7, "\n\nPage 2"))
    head = F.lit("Bank of Baroda\nTRAN DATE VALUE DATE NARRATION CHQ.NO. WITHDRAWAL(DR) DEPOSIT(CR) BALANCE(INR)\n")
    return statement_texts.detected(_papers(spark, sf_dir, line, head, "\nTotal 1", newest_first=True), grammars.BOB_SAVINGS)


#: Rows in the order in which the extractor takes them for chronological: as written (newest first) where all are of one day, else turned round.
PASSBOOKS = f"""{PAPERS}, p AS (SELECT *, merchant_raw || CASE WHEN txn_id % 5 = 0 THEN ' more' ELSE '' END AS description, (1000000000 + sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY doc_id ORDER BY day, txn_id))::DECIMAL(14,2) AS balance,
        row_number() OVER (PARTITION BY doc_id ORDER BY day, txn_id) * CASE WHEN min(day) OVER (PARTITION BY doc_id) < max(day) OVER (PARTITION BY doc_id) THEN 1 ELSE -1 END AS place FROM papers),
    q AS (SELECT *, balance - lag(balance) OVER (PARTITION BY doc_id ORDER BY place) AS moved FROM p),
    found AS (SELECT doc_id, place, day AS transaction_date, description, amount, balance, CASE WHEN CASE WHEN abs(abs(moved) - amount) <= 0.02 THEN moved > 0 ELSE regexp_matches(upper(description), 'INT[.]PD|INTEREST|CLOSURE PROCEEDS|SALARY|GIFT|REFUND') END THEN 'credit' ELSE 'debit' END AS direction FROM q)"""


@query(with_(LEDGER, PASSBOOKS, select="SELECT doc_id, transaction_date, transaction_date AS posting_date, description, amount, direction, balance FROM found"))
def k_passbook_rows(spark, sf_dir):
    return cards.passbook_rows(_passbooks(spark, sf_dir), grammars.BOB_SAVINGS).drop("line_no", "place", "reference")


@query(with_(LEDGER, PASSBOOKS, select="SELECT doc_id, arg_min(balance - CASE WHEN direction = 'credit' THEN amount ELSE -amount END, place)::DECIMAL(14,2) AS opening_balance, arg_max(balance, place) AS closing_balance FROM found GROUP BY doc_id"))
def k_passbook_balances(spark, sf_dir):
    docs = _passbooks(spark, sf_dir)
    return cards.passbook_metadata(docs, grammars.BOB_SAVINGS, cards.passbook_rows(docs, grammars.BOB_SAVINGS)).select("doc_id", "opening_balance", "closing_balance")


def _said(text: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in phrases) + ")"


def _points(text: str, phrases: Sequence[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quoted(p)}) THEN {3 if len(p.split()) >= 3 else 2} ELSE 0 END" for p in phrases) + ")"


#: A user's months as uploads: what the shop names and banks say is their text, every second from behind the fortieth line on.
UPLOADS = """m AS (SELECT user_id, strftime(transaction_date, '%Y-%m') AS ym, transaction_date, txn_id, merchant_raw, bank_name, account_type FROM ledger),
u AS (SELECT user_id || '-' || ym AS upload_id, user_id, count(*) AS n, replace(max(account_type), '_', '-') || ' statement_' || ym || ['.pdf', '.PDF', '.csv', '.doc'][(count(*) % 4)::INT + 1] AS file_name, CASE WHEN count(*) % 5 < 3 THEN max(bank_name) END AS bank_hint,
    CASE WHEN count(*) % 2 = 1 THEN repeat(chr(10), 45) ELSE '' END || string_agg(merchant_raw, chr(10) ORDER BY transaction_date, txn_id) || CASE WHEN count(*) % 3 = 0 THEN chr(10) || 'Card Number' || chr(10) || 'Total Amount Due' || chr(10) || 'Payment due_date' ELSE '' END AS text FROM m GROUP BY user_id, ym),
t AS (SELECT *, regexp_replace(lower(file_name || ' ' || text), '[-_/\\\\]', ' ', 'g') AS t FROM u),
l AS (SELECT *, string_split(t, chr(10)) AS lines FROM t)"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("ym", F.date_format("transaction_date", "yyyy-MM"))
    n = F.count("*")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("transaction_date", "txn_id", "merchant_raw"))), lambda x: x["merchant_raw"]), "\n")
    return rows.groupBy("user_id", "ym").agg(
        F.concat_ws("-", "user_id", "ym").alias("upload_id"), F.concat(F.translate(F.max("account_type"), "_", "-"), F.lit(" statement_"), F.col("ym"), F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".csv", ".doc"))), (n % 4 + 1).cast("int"))).alias("file_name"),
        F.when(n % 5 < 3, F.max("bank_name")).alias("bank_hint"), F.concat(F.when(n % 2 == 1, "\n" * 45).otherwise(""), said, F.when(n % 3 == 0, "\nCard Number\nTotal Amount Due\nPayment due_date").otherwise("")).alias("text"),
    ).withColumns({"document_type_hint": F.lit(None).cast("string"), "account_type_hint": F.lit(None).cast("string")})


def _kinds() -> str:
    """The rules as SQL, first to last."""
    h, r = "h", rules
    invests = f"({_said(h, r.INVESTMENT_PHRASES)} OR regexp_matches(h, {quoted(r.INVESTMENT_WORDS)}))"
    cases = [
        ("suffix NOT IN ('pdf', 'csv')", "unsupported"), (f"suffix = 'csv' AND {_said('t', r.SHEET_TRADES)}", "demat_trade_report"), (f"suffix = 'csv' AND {_said('t', r.SHEET_GAINS)}", "demat_tax_report"),
        (f"suffix = 'csv' AND {_said('t', r.SHEET_HOLDINGS)}", "demat_holdings"), ("suffix = 'csv'", "spreadsheet"), (_said(h, r.PPF_PHRASES), "ppf_statement"), (_said(h, r.CHALLAN_PHRASES), "tax_challan"),
        (f"{_said(h, r.FORM16_PHRASES)} OR {_said(h, r.FORM12BB_PHRASES)}", "tax_form"), (r"contains(h, 'fixed deposit') OR regexp_matches(h, '\bfd\b')", "fd_report"),
        (f"{_said(h, r.CERTIFICATE_PHRASES)} OR (contains(h, 'certificate') AND {_said(h, r.CERTIFICATE_WORDS)})", "interest_certificate"), (f"{invests} AND {_said(h, r.HOLDING_PHRASES)}", "demat_holdings"),
        (f"{invests} AND {_said(h, r.GAIN_PHRASES)}", "demat_tax_report"), (f"{invests} AND {_said(h, r.TRADE_PHRASES)}", "demat_trade_report"), (f"{invests} AND contains(h, 'dividend')", "dividend_report"), (invests, "demat_holdings"),
        (_said(h, r.BARE_GAIN_PHRASES), "demat_tax_report"), (_said(h, r.BARE_HOLDING_PHRASES), "demat_holdings"), ("card >= 8 AND card >= acct + 2", "credit_card_statement"), ("acct >= 8 AND acct >= card + 2", "bank_statement"),
        ("bank_hint IS NOT NULL AND card >= 6 AND card > acct", "credit_card_statement"), ("bank_hint IS NOT NULL AND acct >= 6", "bank_statement"),
        (f"bank_hint IS NOT NULL AND {_said(h, r.CARD_NAMES)}", "credit_card_statement"), (f"bank_hint IS NOT NULL AND {_said(h, r.BANK_NAMES)}", "bank_statement"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(k)}" for c, k in cases) + " ELSE 'unknown_pdf' END"


@query(with_(LEDGER, UPLOADS,
    "e AS (SELECT *, list_position(list_transform(lines, lambda x: " + _said("trim(regexp_replace(x, '\\s+', ' ', 'g'))", rules.HEADING_ENDS) + "), true) AS ends FROM l)",
    "h AS (SELECT *, lower(regexp_extract(file_name, '[.]([^.]+)$', 1)) AS suffix, substr(array_to_string(lines[1:CASE WHEN ends > 0 THEN least(ends - 1, 40) ELSE 40 END], chr(10)), 1, 2500) AS h, "
    + _points("t", rules.CARD_PHRASES) + " AS card, " + _points("t", rules.BANK_PHRASES) + " + CASE WHEN contains(t, 'statement') THEN 1 ELSE 0 END AS acct FROM e)",
    select="SELECT upload_id, file_name, " + _kinds() + " AS doc_type FROM h"))
def i12_upload_kinds(spark, sf_dir):
    return filing.classified(_uploads(spark, sf_dir)).select("upload_id", "file_name", "doc_type")


CHECKS = (
    ("NOT has_ais", "MISSING_AIS", "'block_filing'", "NULL"), ("NOT has_26as", "MISSING_26AS", "'block_filing'", "NULL"), ("NOT has_form16", "MISSING_FORM_16", "CASE WHEN salary > 0 THEN 'block_filing' ELSE 'warning' END", "NULL"),
    ("sections > 0", "MISSING_FORM_16A", "'warning'", "sections"), ("sold > 0", "MISSING_CG_DOC", "'warning'", "NULL"), ("interest > 0", "MISSING_INTEREST_CERT", "'info'", "interest"),
    ("covered = 0", "MISSING_BANK_STATEMENTS", "'warning'", "NULL"), ("covered > 0 AND entries < 10", "LOW_LEDGER_COVERAGE", "'warning'", "NULL"),
)


@query(with_(LEDGER, ROWS, INCOME, """i AS (SELECT * FROM income WHERE fy = '1999-00'),
    f AS (SELECT p.user_id,
        EXISTS (FROM i WHERE i.user_id = p.user_id AND (amount > 300000 OR bucket = 'dividend' AND amount > 250000)) AS has_ais,
        EXISTS (FROM i WHERE i.user_id = p.user_id AND (bucket <> 'salary' AND amount > 350000 OR bucket = 'interest' AND amount > 250000)) AS has_26as,
        EXISTS (FROM i WHERE i.user_id = p.user_id AND bucket = 'salary' AND amount > 250000) AS has_form16,
        (SELECT count(*) FROM i WHERE i.user_id = p.user_id AND bucket = 'salary' AND amount > 300000) AS salary, (SELECT count(*) FROM i WHERE i.user_id = p.user_id AND bucket = 'dividend' AND amount > 400000) AS sold,
        (SELECT count(*) FROM i WHERE i.user_id = p.user_id AND bucket = 'interest' AND amount > 300000) AS interest, (SELECT count(DISTINCT bucket) FROM i WHERE i.user_id = p.user_id AND bucket <> 'salary' AND amount > 350000) AS sections,
        (SELECT count(*) FROM statements s WHERE s.user_id = p.user_id AND row_count >= 9) AS covered, (SELECT count(*) FROM active a WHERE a.user_id = p.user_id AND a.transaction_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31') AS entries
    FROM (SELECT DISTINCT user_id FROM ledger) p)""",
    select=" UNION ALL ".join(f"SELECT user_id, {quoted(n)} AS kind, {v} AS severity, {e} AS evidence FROM f WHERE {c}" for c, n, v, e in CHECKS)))
def d19_checklist(spark, sf_dir):
    """The checklist with its facts counted from lines: income by its amount is on the portal, in forms and in summaries."""
    rows = ledger(spark, sf_dir)
    income, over = base.income_rows(rows), lambda n: F.col("amount") > n
    kind = F.when(F.col("bucket") == "dividend", F.when(over(400000), "securities_sold").otherwise("dividend")).otherwise(F.col("bucket"))
    summary = F.when(F.col("bucket") == "salary", "form_16").when(F.col("bucket") == "interest", "form_26as").otherwise("ais")
    section = F.when(F.col("bucket") == "interest", "194A").when(F.col("bucket") == "dividend", "194K").otherwise("192")
    facts = reconcile.checklist_facts(
        rows, income.where(over(300000)).withColumn("category", kind), income.where(over(350000) & (F.col("bucket") != "salary")).withColumn("section", section), income.where(over(350000) & (F.col("bucket") == "salary")),
        income.where(over(250000)).withColumn("document_type", summary), statements(statement_rows(rows)).where("row_count >= 9"), rows, "1999-00", base.FIRST, base.LAST,
    )
    return base.longs(reconcile.checklist(facts), "evidence")


@query("""SELECT conv_id, count(*) AS pages, count(*) FILTER (t = '') AS empty_pages, count(*) FILTER (low) AS low_pages, count(*) FILTER (t = '') = count(*) OR count(*) FILTER (low) >= greatest(1, count(*) // 2) AS needs_scan FROM (
    SELECT conv_id, t, length(t) < 60 OR length(regexp_replace(t, '[^\\p{L}]', '', 'g')) / greatest(length(t), 1) < 0.15 AS low FROM (SELECT conv_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations)) GROUP BY conv_id""")
def h23_unreadable(spark, sf_dir):
    """Conversations as documents, a page a turn."""
    return documents.unreadable(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")).withColumnRenamed("doc_id", "conv_id")


@query(with_(LEDGER, ROWS, select="SELECT statement_id, txn_id AS char_offset, strftime(transaction_date, '%d/%m/%Y') AS date_raw, amount::VARCHAR AS amount_raw, direction AS txn_type_raw, greatest(0, least(1, length(merchant_raw) / 20 - 1))::DOUBLE AS confidence FROM stmt_rows"))
def j1_raw_rows(spark, sf_dir):
    """Confidences by the length of the text, some below 0 or above 1."""
    rows = statement_rows(ledger(spark, sf_dir)).withColumns({"line_number": F.col("txn_id"), "description": F.col("merchant_raw"), "confidence": F.length("merchant_raw") / 20 - 1})
    return base.longs(entries.raw_rows(rows, "template").select("statement_id", "char_offset", "date_raw", "amount_raw", "txn_type_raw", "confidence"), "char_offset")


@query(with_(LEDGER, "v AS (SELECT *, nature <> 'transfer_internal' AND amount >= 20000 AS good FROM ledger)", "n AS (SELECT DISTINCT user_id, category_name, direction FROM v WHERE good AND year(transaction_date) >= 1998)",
    "o AS (SELECT DISTINCT user_id, category_name, direction FROM ledger WHERE year(transaction_date) = 1996)", "k AS (SELECT count(*) AS a FROM n WHERE NOT EXISTS (FROM o WHERE o.user_id = n.user_id AND o.category_name IS NOT DISTINCT FROM n.category_name AND o.direction = n.direction))",
    select="SELECT a AS inserted, count(*) FILTER (good) - a AS skipped_duplicate, count(*) FILTER (good IS NOT TRUE) AS skipped_invalid FROM v, k WHERE year(transaction_date) >= 1998 GROUP BY a"))
def g7_line_counts(spark, sf_dir):
    """Lines of later years meet those of 1996; transfers and small amounts aren't valid."""
    rows = ledger(spark, sf_dir)
    year = F.year("transaction_date")
    return dedup.line_counts(rows.where(year >= 1998), rows.where(year == 1996), ["user_id", "category_name", "direction"], ["txn_id"], (F.col("nature") != "transfer_internal") & (F.col("amount") >= 20000))[1]


@query()
def f6_subscription_order(spark, sf_dir):
    return base.longs(insights.subscription_order(insights.subscriptions(base.e4_patterns(spark, sf_dir), base.AS_OF)).select("user_id", "merchant", "place"), "place")


ORACLE_SQL["f6_subscription_order"] = f"SELECT user_id, merchant, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'overdue' THEN 0 ELSE 1 END, days_left, merchant) AS place FROM ({ORACLE_SQL['j15_subscriptions']})"


@query("SELECT user_id, coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS INT)) FILTER (event_type <> 'click'), 0)::BIGINT AS pending FROM events GROUP BY user_id")
def d21_pending_messages(spark, sf_dir):
    """Events as threads; clicks are closed."""
    e = table(spark, sf_dir, "events")
    return entries.pending_messages(e.select("user_id", F.col("props").alias("context"), (F.col("event_type") != "click").alias("is_active")), "$.k")
