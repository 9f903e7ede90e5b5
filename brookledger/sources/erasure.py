"""A user's rows leave all tables, in the order of their references, with a journal from which it goes on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written


class Table(NamedTuple):
    """A Parquet table ``<folder>/<name>``. Its rows are the user's by ``user_id``, or by ``key`` if they refer by it to the user's rows of the table
    ``parent``, in whose column ``parent_key`` it is. ``parts``: the columns that its files are partitioned by."""

    name: str
    parts: tuple[str, ...] = ()
    key: str = ""
    parent: str = ""
    parent_key: str = ""


#: Rows that refer to others go before them.
TABLES = (
    Table("user_overrides"), Table("transfer_matches"), Table("transaction_splits"), Table("review_tasks"), Table("annotations"), Table("portal_lines"), Table("bills"), Table("budgets"),
    Table("snapshots"), Table("sms"), Table("sources", (), "txn_id", "ledger", "txn_id"), Table("parsed"), Table("ledger", ("year_month",)), Table("statements"), Table("accounts"), Table("files"), Table("categories"),
)
STAGED, DONE = "staged", "done"


def _there(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Journal:
    """What was done, as lines of JSON in a folder: user, table, state and what else is needed to go on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, user: str, table: str, state: str, copy: str = "", gone: list[str] = ()) -> None:
        row = (user, table, state, copy, list(gone))
        self.spark.createDataFrame([row], "user string, table string, state string, copy string, gone array<string>").coalesce(1).write.mode("append").json(self.path)

    def states(self, user: str) -> dict[str, dict[str, tuple]]:
        """By table and state: the copy and the partitions that are to go."""
        files, at = _there(self.spark, self.path)
        if not files.exists(at):
            return {}
        out: dict[str, dict[str, tuple]] = {}
        for r in self.spark.read.schema("user string, table string, state string, copy string, gone array<string>").json(self.path).where(F.col("user") == user).collect():  # two lines a table
            out.setdefault(r["table"], {})[r["state"]] = r["copy"], r["gone"]
        return out


def _own(spark: SparkSession, folder: str, table: Table, rows: DataFrame, user_id) -> Column | DataFrame:
    """``rows`` with ``_own``, whether they are the user's."""
    if not table.key:
        return rows.withColumn("_own", F.col("user_id").eqNullSafe(F.lit(user_id)))
    theirs = spark.read.parquet(f"{folder}/{table.parent}").where(F.col("user_id").eqNullSafe(F.lit(user_id))).select(F.col(table.parent_key).alias("_key")).distinct()
    return rows.join(theirs, rows[table.key] == F.col("_key"), "left").withColumn("_own", F.col("_key").isNotNull()).drop("_key")


def erase_user(spark: SparkSession, folder: str, user_id, journal: str, tables: tuple[Table, ...] = TABLES) -> int:
    """Takes a user's rows out of all ``tables`` that are in ``folder``; how many tables were rewritten by this call.

    Only partitions that have some of the user's rows are read as a whole. What stays of them is first written beside, then the journal tells
    that it is, then it takes their place (a partition of which nothing stays is removed), and the journal tells that too. Whatever
    stops it in between, the next call goes on: a table that is done is left alone, one whose copy is whole is put in place again from the
    copy. Children go before the tables that they refer to, so whose they are can still be told. One call at a time may write these tables.
    """
    log, rewritten = Journal(spark, journal), 0
    known = log.states(str(user_id))
    for table in tables:
        path, states = f"{folder}/{table.name}", known.get(table.name, {})
        files, at = _there(spark, path)
        if DONE in states or (STAGED not in states and not files.exists(at)):
            continue
        if STAGED not in states:
            rows = _own(spark, folder, table, spark.read.parquet(path), user_id)
            if table.parts:
                touched = rows.where("_own").select(*(F.col(c).alias(f"_{c}") for c in table.parts)).distinct()
                same = F.lit(True)
                for c in table.parts:
                    same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
                rows = rows.join(F.broadcast(touched), same, "left_semi")  # a row a partition
            kept = written(rows.where("NOT _own").drop("_own"), f"erasure-{table.name}")
            gone = []
            if table.parts:
                stay = kept.select(*table.parts).distinct()
                same = F.lit(True)
                for c in table.parts:
                    same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
                gone = ["/".join(f"{c}={r[f'_{c}']}" for c in table.parts) for r in touched.join(stay, same, "left_anti").collect()]
            states = {STAGED: (kept.inputFiles()[0].rsplit("/", 1)[0] if kept.inputFiles() else "", gone)}
            log.add(str(user_id), table.name, STAGED, *states[STAGED])
        copy, gone = states[STAGED]
        if copy:
            writer = spark.read.parquet(copy).write.mode("overwrite")
            (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*table.parts) if table.parts else writer).parquet(path)
        for part in gone:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}"), True)
        log.add(str(user_id), table.name, DONE)
        rewritten += 1
    return rewritten
