"""Written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch of texts that goes to a Python worker, where the session has Spark's own values.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def written(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """``df`` written in the folder that spark.checkpoint.dir names and read back. Only in local mode, as in
    tests, is a folder of our own made where that is unset.

    Iterative operators cut their lineage with this; a lost executor loses
    nothing, and what is read several times is computed once. ``options`` go to the writer.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brookledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Batches to Python bounded by rows and bytes that suit whole texts. What the session sets itself is left alone."""
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(key)).removesuffix("b") == default:
            spark.conf.set(key, str(value))
