"""Job queue queries, retries, and mailbox sender discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..tables import written

MOST_ATTEMPTS, LONGEST_WAIT = 3, 300


def claim_order(jobs: DataFrame) -> DataFrame:
    """The queued job that each user would be served next, in fair order: fewest running jobs, then oldest.

    jobs: job_id, user_id, status, priority, created_at. Counts and each user's first
    job are grouped aggregates. The one row a user is sorted by ranges; its place is its
    own in its range and how many rows the ranges before have, so no task sees all users.
    """
    running = jobs.where("status = 'running'").groupBy("user_id").agg(F.count("*").alias("running"))
    first = F.min(F.struct((-F.col("priority")).alias("p"), "created_at", "job_id")).alias("m")
    queued = jobs.where("status = 'queued'").groupBy("user_id").agg(first, F.min("created_at").alias("oldest"))
    out = queued.join(running, "user_id", "left").select("user_id", "m.job_id", F.coalesce("running", F.lit(0)).alias("running"), "oldest")
    order = ["running", "oldest", "user_id"]
    row = F.monotonically_increasing_id()
    ranked = written(out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(row, 33)).withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1))), "claims")
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(before, "_part").select("user_id", "job_id", (F.col("_row") + F.col("_before") + 1).cast("int").alias("place"))


def retried(failed: DataFrame) -> DataFrame:
    """What becomes of failed jobs by their attempts: queued again after min(300, 2^attempts) seconds, else given up."""
    again = F.col("attempts") < MOST_ATTEMPTS
    wait = F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), F.greatest("attempts", F.lit(1))).cast("int"))
    return failed.withColumn("next_status", F.when(again, "queued").otherwise("dlq")).withColumn("wait_seconds", F.when(again, wait))


def sender_discovery(mails: DataFrame, known_domains: Sequence[str], keywords: Sequence[str], top: int = 50) -> DataFrame:
    """The senders that most look like banks (message_id, from_address, subject, has_attachment)."""
    sender = F.lower(F.trim("from_address"))
    domain = F.substring_index(sender, "@", -1)
    hit = contains_any(F.lower(F.coalesce("subject", F.lit(""))), keywords)
    g = mails.groupBy(sender.alias("sender"), domain.alias("domain")).agg(F.count("*").alias("messages"), F.count_if("has_attachment").alias("attachments"), F.count_if(hit).alias("keyword_subjects"))
    c = F.col
    score = F.least(F.lit(0.4), 0.3 * c("attachments")) + F.least(F.lit(0.35), 0.25 * c("keyword_subjects")) + F.when(c("domain").isin(*known_domains), 0.25).otherwise(0.0) + F.least(F.lit(0.15), F.log(c("messages") + 1) / F.log(F.lit(20.0)))
    out = g.withColumn("score", F.round(F.least(F.lit(1.0), score), 3))
    best = out.orderBy(F.desc("score"), F.desc("messages"), "domain", "sender").limit(top)
    best = best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), F.desc("messages"), "domain", "sender")))
    # The three first subjects of these few senders only: one of each by a grouped minimum, then ranked.
    theirs = mails.select(sender.alias("sender"), "message_id", "subject").where("subject IS NOT NULL").join(best.select("sender"), "sender", "left_semi")
    first = theirs.groupBy("sender", "subject").agg(F.min("message_id").alias("_at"))
    place = F.row_number().over(W.partitionBy("sender").orderBy("_at", "subject"))
    shown = first.withColumn("_p", place).where(F.col("_p") <= 3).groupBy("sender").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "subject"))), lambda x: x["subject"]).alias("subjects"))
    return best.join(shown, "sender", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def domain_histogram(mails: DataFrame) -> DataFrame:
    return mails.groupBy(F.lower(F.substring_index(F.trim("from_address"), "@", -1)).alias("domain")).agg(F.count("*").alias("messages"))


def parser_support_queue(failures: DataFrame, samples: int = 5) -> DataFrame:
    """Failures (bank_name, account_type, reason, file_name, message, seen_at) by kind: how many, the newest distinct files, the newest message."""
    newest = F.max(F.struct("seen_at", "file_name", "message")).alias("m")
    files = failures.groupBy("bank_name", "account_type", "reason", "file_name").agg(F.count("*").alias("_n"), F.max("seen_at").alias("_seen"), newest)
    place = F.row_number().over(W.partitionBy("bank_name", "account_type", "reason").orderBy(F.desc("_seen"), "file_name"))
    ranked = files.withColumn("_place", place)
    return ranked.groupBy("bank_name", "account_type", "reason").agg(
        F.sum("_n").alias("failures"), F.array_sort(F.collect_list(F.when(F.col("_place") <= samples, F.struct("_place", "file_name")))).alias("_files"),
        F.max("_seen").alias("last_seen"), F.max("m").getField("message").alias("message"),
    ).withColumn("files", F.transform("_files", lambda x: x["file_name"])).drop("_files")


def health(counters: DataFrame) -> DataFrame:
    """Success and yield rates (attempts, successes, extracted_rows, expected_rows); null without a base."""
    rate = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return counters.withColumn("success_rate", rate("successes", "attempts")).withColumn("yield_rate", rate("extracted_rows", "expected_rows"))
