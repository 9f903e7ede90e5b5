"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest estimated size of anything these operators broadcast on purpose.
BROADCAST_BYTES = 64 << 20
#: Files of a written table.
FILES_A_CORE, ROWS_A_FILE = 8, 50_000
#: Rows and bytes of a batch that goes to a Python worker, where the session has Spark's own values.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


class Recent(dict):
    """Remembers what ``of`` gave for the keys met lately: ``most`` of them and as many that were met before these."""

    def __init__(self, of: Callable, most: int):
        self.of, self.most, self.before = of, most, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.of(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of our own in local
    mode, as in tests, and an error on a cluster, whose executors couldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="brookledger-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches of texts bounded by bytes too, so that a few very long ones don't meet in one batch.
    What the session sets itself is left alone."""
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(key)).removesuffix("b") == default:
            spark.conf.set(key, str(value))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse_clash(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{name} is a column already: name another one")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back: lineage ends here,
    lost executors lose nothing, and several readers don't compute it again.

    As each file costs processes and requests of its own, there are no more than
    ``FILES_A_CORE`` a core, and fewer where there are known to be few ``rows``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    files = FILES_A_CORE * spark.sparkContext.defaultParallelism
    df.coalesce(files if rows is None else min(files, 1 + rows // ROWS_A_FILE)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` as a table that is range-sorted by ``order``, with ``_part``, the range of a row, and ``_row``, its place there from 0."""
    row = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(rows.withColumns({"_part": F.shiftright(row, 33).cast("int"), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))}), name)


def numbered(df: DataFrame, order: list[Column], name: str, out: str) -> DataFrame:
    """Adds ``out``, the place of a row from 0 in ``order``: its place in its range and the rows of the ranges before."""
    rows = dealt(df, order, name)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on ``fold``; a null id never does."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class outside the held-out fold.

    Ids are taken in the order of a hash, so the choice doesn't depend on how
    the table is partitioned. Rows with a null id or label are left out; if an
    id has several labels the largest counts. The result is bounded by
    ``2 * per_class`` rows and may be broadcast.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    return rows.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(
        rows.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    )
