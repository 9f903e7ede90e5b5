"""What arrives: extracted rows, chunks of one document, uploads, accounts and their periods, parsers, queues."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, money, text
from .dedup import first_of


class Extracted(NamedTuple):
    rows: DataFrame
    counts: DataFrame


def _first_non_null(column: str, order: str) -> Column:
    """The value of the first row in order that has one."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(order, column)))[column].alias(column)


def extracted(rows: DataFrame, statements: DataFrame) -> Extracted:
    """Sane rows of an extractor, the first of those that are alike, and for each statement how many went.

    rows: statement_id, line_number, transaction_date, amount, direction, description,
    confidence; statements: statement_id, period_start, period_end.
    """
    c = F.col
    whole = rows.join(statements.select("statement_id", "period_start", "period_end"), "statement_id", "left").withColumn("description", text.collapse(c("description")))
    in_period = F.coalesce(c("transaction_date") >= F.date_sub("period_start", rules.DAYS_BEFORE_PERIOD), F.lit(True)) & F.coalesce(c("transaction_date") <= F.date_add("period_end", rules.DAYS_AFTER_PERIOD), F.lit(True))
    sane = (F.coalesce("description", F.lit("")) != "") & (c("amount") > 0) & c("direction").isin("debit", "credit") & in_period
    good = whole.where(F.coalesce(sane, F.lit(False))).withColumn("_same", F.upper(F.left("description", F.lit(rules.EXTRACTED_SAME)))).withColumn("_paise", money.paise(c("amount")))
    kept = first_of(good, ["statement_id", "transaction_date", "_paise", "direction", "_same"], ["line_number"])
    kept = kept.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).drop("_same", "_paise", "period_start", "period_end")
    n = rows.groupBy("statement_id").agg(F.count("*").alias("rows")).join(kept.groupBy("statement_id").agg(F.count("*").alias("kept")), "statement_id", "left")
    return Extracted(kept, n.select("statement_id", "rows", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("dropped")))


def merged_chunks(rows: DataFrame) -> DataFrame:
    """Rows of a document's overlapping chunks (doc_id, chunk_no, line_no, transaction_date, direction, amount, description) as one list.

    A row without a date takes the last one before it in its chunk; of rows that are alike the first one stays.
    """
    before = W.partitionBy("doc_id", "chunk_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    dated = rows.withColumn("transaction_date", F.last("transaction_date", ignorenulls=True).over(before)).withColumn("description", F.trim("description"))
    good = dated.where("transaction_date IS NOT NULL AND amount > 0 AND description <> ''").withColumn("_same", F.upper(F.left("description", F.lit(rules.CHUNK_SAME)))).withColumn("_paise", money.paise(F.col("amount")))
    return first_of(good, ["doc_id", "transaction_date", "direction", "_paise", "_same"], ["chunk_no", "line_no"]).drop("_same", "_paise")


def merged_metadata(chunks: DataFrame) -> DataFrame:
    """What the first chunk that knows it says of each field of a document (doc_id, chunk_no, any further columns)."""
    return chunks.groupBy("doc_id").agg(*(_first_non_null(c, "chunk_no") for c in chunks.columns if c not in ("doc_id", "chunk_no")))


def _line_chunks(lines: list[str], size: int, overlap: int, most: int) -> list[str]:
    out, start = [], 0
    while start < len(lines) and len(out) < most:
        end, n = start + 1, len(lines[start]) + 1
        while end < len(lines) and n + len(lines[end]) + 1 <= size:
            n += len(lines[end]) + 1
            end += 1
        out.append("\n".join(lines[start:end]))
        start = len(lines) if end == len(lines) else max(start + 1, end - overlap)
    return out


def line_chunks(documents: DataFrame, size: int = rules.LINE_CHUNK, overlap: int = rules.LINE_OVERLAP, most: int = rules.MOST_LINE_CHUNKS) -> DataFrame:
    """Chunks of whole lines, which share the last lines of the one before; each one's start depends on the last, hence an Arrow UDF."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_line_chunks([s for x in (t or "").splitlines() if (s := x.strip())], size, overlap, most) for t in texts], dtype=object)

    return documents.select("doc_id", F.posexplode(of("text")).alias("chunk_no", "chunk"))


def row_chunks(lines: DataFrame, size: int = rules.ROW_CHUNK, overlap: int = rules.ROW_OVERLAP) -> DataFrame:
    """Table rows (doc_id, row_no, line, is_header) in chunks of ``size`` that share ``overlap`` rows: (doc_id, chunk_no, row_no, line). Headers and empty lines go."""
    step = size - overlap
    rows = lines.where("NOT is_header AND line <> ''")
    w = W.partitionBy("doc_id")
    placed = rows.withColumn("_at", F.row_number().over(w.orderBy("row_no")) - 1).withColumn("_n", F.count("*").over(w))
    # Chunk k holds rows [k * step, k * step + size); the last chunk is the first that reaches the end.
    last = F.greatest(F.ceil((F.col("_n") - size) / step), F.lit(0))
    first_of_row = F.greatest(F.ceil((F.col("_at") - size + 1) / step), F.lit(0))
    chunks = F.sequence(first_of_row, F.least(F.floor(F.col("_at") / step), last))
    return placed.select("doc_id", F.explode(chunks).alias("chunk_no"), "row_no", "line").withColumn("chunk_no", F.col("chunk_no").cast("int"))


def statement_list(statements: DataFrame, files: DataFrame) -> DataFrame:
    """Active statements (statement_id, user_id, file_id, is_active) with their file's name and how many statements its content gave, one at least."""
    named = statements.join(files.select("file_id", "file_name", "file_hash"), "file_id", "left")
    n = named.where("file_hash IS NOT NULL").groupBy("user_id", "file_hash").agg(F.count("*").alias("_n"))
    return named.where("is_active").join(n, ["user_id", "file_hash"], "left").withColumn("reprocess_count", F.coalesce("_n", F.lit(1))).drop("_n")


def review_status(parse_status: Column) -> Column:
    """What a statement's state means for who uploaded it."""
    low = F.lower(F.trim(F.coalesce(parse_status, F.lit(""))))
    return F.when(low == "parsed", "success").when(low == "review_required", "review_required").when(low == "partial", "error").when(low == "failed", "failed").otherwise("reviewing")


def job_review_status(status: Column, result_status: Column) -> Column:
    """What a job's state and its result mean for who uploaded the file."""
    low = F.lower(F.trim(F.coalesce(result_status, F.lit(""))))
    done = F.when(low == "duplicate", "duplicate").when(low.isin("parsed", "success"), "success").when(low == "review_required", "review_required").when(low == "partial", "error").otherwise("failed")
    return F.when(status.isin("queued", "running"), "reviewing").when(status == "completed", done).otherwise("failed")


def artifact_status(status: Column) -> Column:
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when(low == "parsed", "success").when(low == "failed", "failed").when(low == "discovered", "reviewing").otherwise("error")


def queue_reason(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(low.contains(rules.NO_PARSER), "unsupported_bank").when(low.contains(rules.NO_FORMAT), "unknown_format").when(low.contains(rules.LOCKED), "password_required").otherwise("parse_error")


def ledger_source(source_type: Column, method: Column) -> Column:
    """How an entry was extracted, by the kind of its source and the method."""
    low = F.lower(F.trim(F.coalesce(method, F.lit(""))))
    by_method = F.when(low == "vision", "llm_vision").when(low == "llm", "llm_text").when(low == "ocr", "ocr_llm")
    return F.when(source_type.isin("sms", "manual"), source_type).otherwise(F.coalesce(by_method, F.when(source_type == "statement", "template").otherwise("manual")))


def unread(artifacts: DataFrame) -> DataFrame:
    """Statements that failed, or were skipped because no parser knew them."""
    low = F.lower(F.coalesce("parse_message", F.lit("")))
    skipped = (F.col("status") == "skipped") & (low.contains(rules.NO_PARSER) | low.contains(rules.NO_FORMAT))
    return artifacts.where(F.col("doc_type").isin(*rules.STATEMENT_TYPES) & ((F.col("status") == "failed") | skipped))


def recent_uploads(files: DataFrame, statements: DataFrame, jobs: DataFrame, artifacts: DataFrame, most: int = 50) -> DataFrame:
    """The newest uploads of each user: files with the state of their statement, or else of their latest job, and other artifacts.

    files: file_id, user_id, file_name, created_at; statements: file_id, statement_id, parse_status;
    jobs: job_id, file_id, status, result_status, created_at; artifacts: artifact_id, user_id, file_name, doc_type, status, created_at.
    """
    def newest(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("_place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc(key)))).where(F.col("_place") <= most).drop("_place")

    s = statements.groupBy("file_id").agg(F.max(F.struct("statement_id", "parse_status")).alias("s"))
    j = jobs.groupBy("file_id").agg(F.max(F.struct("created_at", "job_id", "status", "result_status")).alias("j"))
    shown = newest(files, "file_id").join(s, "file_id", "left").join(j, "file_id", "left")
    state = F.when(F.col("s").isNotNull(), review_status(F.col("s.parse_status"))).when(F.col("j").isNotNull(), job_review_status(F.col("j.status"), F.col("j.result_status"))).otherwise("reviewing")
    shown = shown.select("user_id", F.col("file_id").alias("upload_id"), "file_name", state.alias("state"), "created_at")
    other = newest(artifacts.where(~F.coalesce(F.col("doc_type").isin(*rules.STATEMENT_TYPES), F.lit(False))), "artifact_id")
    both = shown.unionByName(other.select("user_id", F.col("artifact_id").alias("upload_id"), "file_name", artifact_status(F.col("status")).alias("state"), "created_at"))
    return both.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("upload_id")))).where(F.col("place") <= most)


def accounts(statements: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """An account for each bank, kind and number of a user, with its first and last day; ``known`` accounts (the same columns) widen or stay."""
    names = ["user_id", "institution_name", "account_type", "account_masked"]
    bank, kind = F.upper(F.trim("bank_name")), F.lower(F.trim("account_type"))
    rows = statements.select("user_id", bank.alias("institution_name"), kind.alias("account_type"), F.nullif("account_masked", F.lit("")).alias("account_masked"), F.col("period_start").alias("opening_date"), F.col("period_end").alias("last_statement_date"))
    rows = rows.where("institution_name <> '' AND account_type <> ''")
    if known is not None:
        rows = rows.unionByName(known.select(rows.columns))
    return rows.groupBy(*names).agg(F.min("opening_date").alias("opening_date"), F.max("last_statement_date").alias("last_statement_date"))


def coverage(statements: DataFrame) -> DataFrame:
    """A row for each account and period that a statement covers; the last statement tells whether it is complete."""
    keys = ["user_id", "bank_name", "account_type", "account_masked", "period_start", "period_end"]
    rows = statements.where("period_start IS NOT NULL AND period_end IS NOT NULL")
    return rows.groupBy(*keys).agg(F.max(F.struct("statement_id", "parse_status")).alias("m")).select(*keys, "m.statement_id", (F.col("m.parse_status") == "parsed").alias("is_complete"))


def covered_accounts(tree: DataFrame, periods: DataFrame) -> DataFrame:
    """Accounts (as ledger.accounts_tree gives them) with the list of the periods they cover. An account has as many as it has statements."""
    keys = ["user_id", "bank_name", "account_masked"]
    listed = periods.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end")))).alias("coverage"))
    none = F.array().cast(listed.schema["coverage"].dataType)
    return tree.join(listed, keys, "left").withColumn("coverage", F.coalesce("coverage", none))


def document_type(value: Column) -> Column:
    """The document type that a hint names, else null."""
    key = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    return F.coalesce(*(F.when(key.isin(*names), F.lit(kind)) for kind, names in rules.DOCUMENT_TYPES.items()))


def recent_summaries(statements: DataFrame, hints: DataFrame, newest: int = 12, shown: int = 5) -> DataFrame:
    """Of each user's newest statements those that fit the user's hints (user_id, bank_hint, account_type_hint), five at most; the newest five where none does."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("period_end"), F.desc("statement_id")))
    rows = statements.withColumn("_place", place).where(F.col("_place") <= newest).join(hints, "user_id", "left")
    card = F.col("account_type") == "credit_card"
    kind = F.coalesce("account_type_hint", F.lit("auto"))
    fits = F.coalesce(F.upper("bank_name") == F.upper("bank_hint"), F.lit(True)) & ((kind == "auto") | ((kind == "credit_card") & card) | ((kind == "bank_account") & ~card))
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    any_fits = F.max("_fits").over(W.partitionBy("user_id"))
    rows = rows.withColumn("_any", any_fits).where("_fits OR NOT _any")
    again = F.row_number().over(W.partitionBy("user_id").orderBy("_place"))
    return rows.withColumn("place", again).where(F.col("place") <= shown).select("user_id", "statement_id", "place")


def top_counts(rows: DataFrame, by: Sequence[str], value: str, most: int) -> DataFrame:
    """The commonest values of each group as ``value (n)``."""
    n = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), value))
    return n.withColumn("place", place).where(F.col("place") <= most).select(*by, "place", F.format_string("%s (%d)", F.col(value), F.col("n")).alias("shown"))


def document_coverage(artifacts: DataFrame) -> DataFrame:
    """How many documents of each kind that a return needs a user has; 0 where there is none."""
    known = artifacts.groupBy("user_id").agg(*(F.count_if(F.col("doc_type") == k).alias(k) for k in rules.TAX_DOCUMENTS))
    rows = F.array(*(F.struct(F.lit(k).alias("doc_type"), F.col(k).alias("documents")) for k in rules.TAX_DOCUMENTS))
    return known.select("user_id", F.explode(rows).alias("s")).select("user_id", "s.*")


def reference(narration: Column) -> Column:
    """The first token that looks like a reference; empty if there is none."""
    return F.regexp_extract(F.coalesce(narration, F.lit("")), rules.REFERENCE_TOKEN, 1)


def decimal_of(payload: Column, *keys: str) -> Column:
    """The first of some keys of a JSON object whose value is a number."""
    return F.coalesce(*(F.get_json_object(payload, f"$.{k}").try_cast("decimal(18,2)") for k in keys))


def parsers(documents: DataFrame, registry: DataFrame, strict_bank: bool = False, strict_kind: bool = False) -> DataFrame:
    """The parser that fits each document (doc_id, text, bank_hint, account_type_hint), in the order of ``registry``.

    registry: parser_id (its order), bank_name, account_type, detect (a pattern), a rule table of bounded size. Parsers whose
    pattern fits are narrowed by the hinted kind, then the hinted bank, as far as any is left (strictly: even then); where none
    fits, one of the hinted bank is taken, of the hinted kind, or else a card's or an account's by the words of the text.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    bank, kind = classify.alias(F.col("bank_hint"), rules.BANK_ALIASES), classify.alias(F.col("account_type_hint"), rules.ACCOUNT_TYPE_ALIASES)
    rows = documents.select("doc_id", "text", F.coalesce(bank, F.upper(F.trim("bank_hint"))).alias("_bank"), F.coalesce(kind, F.lower(F.trim("account_type_hint"))).alias("_kind"), (low.contains("credit card") | low.contains("card statement")).alias("_card"))
    table = F.array_sort(F.collect_list(F.struct("parser_id", "bank_name", "account_type", "detect"))).alias("_all")
    rows = rows.join(F.broadcast(registry.agg(table)))  # one row
    asked = F.coalesce(F.col("_kind") != "auto", F.lit(False))
    of_kind = lambda p: F.when(~asked, True).when(F.col("_kind") == "bank_account", p["account_type"] != "credit_card").otherwise(p["account_type"] == F.col("_kind"))
    of_bank = lambda p: F.upper(p["bank_name"]) == F.col("_bank")

    def narrowed(all_: Column, fits, strict: Column) -> Column:
        some = F.filter(all_, fits)
        return F.when((F.size(some) > 0) | strict, some).otherwise(all_)

    rows = rows.withColumn("_met", F.filter("_all", lambda p: F.regexp_like(F.coalesce("text", F.lit("")), p["detect"])))
    rows = rows.withColumn("_left", narrowed(F.col("_met"), of_kind, F.lit(strict_kind) & asked))
    rows = rows.withColumn("_left", F.when(F.col("_bank").isNotNull(), narrowed(F.col("_left"), of_bank, F.lit(strict_bank))).otherwise(F.col("_left")))
    rows = rows.withColumn("_hinted", narrowed(F.filter("_all", of_bank), of_kind, F.lit(strict_kind) & asked))
    card = F.when(F.col("_kind") == "credit_card", True).when(F.col("_kind") == "bank_account", False).otherwise(F.col("_card"))
    wanted = F.filter("_hinted", lambda p: F.when(F.col("_kind") == "bank_account", p["account_type"] != "credit_card").otherwise(p["account_type"] == F.when(card, "credit_card").otherwise("savings")))
    by_hint = F.coalesce(F.get(wanted, F.lit(0)), F.get("_hinted", F.lit(0)))
    refused = (F.size("_met") > 0) & F.lit(strict_bank or strict_kind)
    return rows.select("doc_id", F.coalesce(F.get("_left", F.lit(0)), F.when(F.col("_bank").isNotNull() & ~refused, by_hint))["parser_id"].alias("parser_id"))


def enqueued(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue with the requests (job_id, user_id, created_at, and what else the queue has) as queued jobs of no attempts; a job that is there stays as it is."""
    new = requests.join(queue.select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"])
    return queue.unionByName(new.withColumn("status", F.lit("queued")).withColumn("attempts", F.lit(0)), allowMissingColumns=True)


def dead_retry(jobs: DataFrame) -> DataFrame:
    """The jobs after one automatic retry: of the parse jobs that were given up and not retried yet, the one that ended first is queued again under relaxed rules.

    jobs: job_id, job_type, status, dlq_retry_count, finished_at, relaxed.
    """
    open_ = jobs.where("status = 'dlq' AND job_type = 'parse_statement' AND dlq_retry_count < 1")
    first = open_.agg(F.min(F.struct(F.col("finished_at").isNull(), "finished_at", "job_id"))["job_id"].alias("_first"))
    marked = jobs.join(F.broadcast(first))  # one row
    hit = F.col("job_id").eqNullSafe(F.col("_first"))
    return marked.withColumns({"status": F.when(hit, "queued").otherwise(F.col("status")), "dlq_retry_count": F.col("dlq_retry_count") + hit.cast("int"), "relaxed": F.col("relaxed") | hit}).drop("_first")


def routed_model(task: Column, difficulty: Column, base: str, small: str | None = None, large: str | None = None) -> Column:
    """The model for a task: the small one for simple tasks and documents, the large one for hard ones, else the usual one."""
    return F.when(task.isin(*rules.SMALL_MODEL_TASKS), small or base).when(difficulty == "high", large or base).when(difficulty == "low", small or base).otherwise(base)
