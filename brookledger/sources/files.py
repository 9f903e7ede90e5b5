"""Sources and sinks of ledger data, by Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXPORT = ("transaction_date", "description", "merchant", "category", "amount", "direction", "nature", "bank", "account")


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: path, size, changed_at, content and its SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"), "content", F.sha2("content", 256).alias("file_hash"))


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose hash isn't in ``seen``; of equal ones the first path."""
    fresh = files.join(seen.select("file_hash").distinct(), "file_hash", "left_anti")
    first = fresh.groupBy("file_hash").agg(F.min("path").alias("path"))
    return fresh.join(first, ["file_hash", "path"])


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files as lines, cells joined by `` | ``; what a document classifier reads. Lines keep their file's order."""
    rows = spark.read.option("header", "false").csv(path)
    cells = F.filter(F.array(*(F.trim(c) for c in rows.columns)), lambda c: c.isNotNull() & (c != ""))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), F.array_join(cells, " | ").alias("line")).where("line <> ''")


def page_texts(pages: DataFrame) -> DataFrame:
    """Texts of documents from those of their pages (doc_id, page_no, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("pages"))


def exported(ledger: DataFrame) -> DataFrame:
    """What an export holds, newest first."""
    return ledger.where(~F.col("is_excluded")).orderBy(F.desc("transaction_date"), "txn_id").select(
        "transaction_date", F.col("merchant_raw").alias("description"), F.coalesce("merchant_normalized", F.lit("")).alias("merchant"), F.coalesce("category_name", F.lit("")).alias("category"),
        F.format_string("%.2f", F.col("amount").cast("double")).alias("amount"), "direction", "nature", F.col("bank_name").alias("bank"), F.coalesce("account_masked", F.lit("")).alias("account"),
    )


def export_csv(ledger: DataFrame, path: str) -> None:
    exported(ledger).write.mode("overwrite").option("header", "true").csv(path)


def write_pack(frames: Mapping[str, DataFrame], path: str) -> None:
    """A hand-off pack: each frame as CSV in a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path.rstrip('/')}/{name}")


def write_by_month(ledger: DataFrame, path: str, date_col: str = "transaction_date") -> None:
    """The ledger as Parquet by user and month; readers of one user or month skip the rest.

    Rows are dealt by user, month and a hash of the row, so one user's month may fill several files and none is one task's alone.
    """
    out = ledger.withColumn("month", F.date_format(date_col, "yyyy-MM"))
    out.repartition(F.col("user_id"), F.col("month"), F.pmod(F.xxhash64("txn_id"), F.lit(8))).write.mode("overwrite").partitionBy("user_id", "month").parquet(path)


def read_user(spark: SparkSession, path: str, user_id) -> DataFrame:
    """One user's rows; the predicate prunes folders."""
    return spark.read.parquet(path).where(F.col("user_id") == F.lit(user_id))


def repeated_headers_dropped(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line, is_header) without the header lines that repeat an earlier one."""
    again = F.row_number().over(W.partitionBy("doc_id", "line").orderBy("line_no"))
    return lines.withColumn("_n", again).where("NOT is_header OR _n = 1").drop("_n")
