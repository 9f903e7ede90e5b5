"""Streams: SMS intake, event windows, job retries and stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import classify
from ..operators.jobs import LONGEST_WAIT, MOST_ATTEMPTS
from ..tables import written

#: Stages are forgotten after a day.
STAGE_TTL_MS = 24 * 3600 * 1000
#: Seconds after which rules are read again.
PATTERN_AGE_S = 300
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; the query's checkpoint is the cursor."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def sms_entries(messages: DataFrame, late: str = "3 days") -> DataFrame:
    """Transaction messages (user_id, address, body, sent timestamp) as parsed rows, each once a user, for a batch or a stream.

    A stream forgets hashes once they are ``late`` behind the newest message.
    """
    rows = messages.withColumns(classify.sms_parsed(F.col("address"), F.col("body"), F.col("sent"))).withColumn("sms_class", classify.sms_class(F.col("address"), F.col("body")))
    rows = rows.where(F.col("sms_class").startswith("transaction_")).where("amount IS NOT NULL").withColumn("direction", F.substring_index("sms_class", "_", -1))
    if rows.isStreaming:
        return rows.withWatermark("sent", late).dropDuplicatesWithinWatermark(["user_id", "sms_hash"])
    return rows.dropDuplicates(["user_id", "sms_hash"])


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts timestamp, event_type, value) by window, for a batch or a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: runs of events no further than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def retries(outcomes: DataFrame) -> DataFrame:
    """Decisions for a stream of job outcomes (job_id, ok): a failed job is queued again after min(300, 2^attempts) seconds, up to three attempts, then given up. A job's state is its attempts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, out = (state.get[0] if state.exists else 0), []
        for pdf in batches:
            for ok in pdf["ok"]:
                attempts += 1
                if ok:
                    out.append((key[0], attempts, "completed", None))
                elif attempts < MOST_ATTEMPTS:
                    out.append((key[0], attempts, "queued", min(LONGEST_WAIT, 2 ** max(1, attempts))))
                else:
                    out.append((key[0], attempts, "dlq", None))
        if out and out[-1][2] != "queued":
            state.remove()
        else:
            state.update((attempts,))
        yield pd.DataFrame(out, columns=["job_id", "attempts", "status", "wait_seconds"]).astype({"wait_seconds": "Int64"})

    return outcomes.groupBy("job_id").applyInPandasWithState(step, "job_id long, attempts long, status string, wait_seconds long", "attempts long", "append", GroupStateTimeout.NoTimeout)


class _LastStage(StatefulProcessor):
    """A job's newest stage, by the time of the update; state that isn't updated for ``ttl`` goes by itself."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, stage string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        newest = max(((at, stage) for pdf in rows for at, stage in zip(pdf.iloc[:, 2].tolist(), pdf.iloc[:, 1].tolist())), default=None)
        if newest is not None and (known is None or newest > (known[0], known[1])):
            self.last.update(newest)
            yield pd.DataFrame({"job_id": [key[0]], "stage": [newest[1]]})

    def close(self) -> None:
        pass


def stages(updates: DataFrame, ttl_ms: int = STAGE_TTL_MS) -> DataFrame:
    """The newest stage of each job (job_id, stage, at timestamp) whenever it changes, as updates come in any order: an update that is older than what
    is known of its job changes nothing, and of equal times the stage greater as text is newer. Updates without a time or stage are left out. A job
    without changes for ``ttl_ms`` is forgotten, and begins anew with its next update. State of this kind needs Spark's RocksDB store, which the session is set to."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = updates.schema["job_id"].dataType.simpleString()
    rows = updates.select("job_id", "stage", F.unix_micros("at").alias("_at")).where("stage IS NOT NULL AND _at IS NOT NULL")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_LastStage(ttl_ms), outputStructType=f"job_id {kind}, stage string", outputMode="Update", timeMode="ProcessingTime")


def pattern_cache(read: Callable[[], tuple[object, DataFrame]], most_age: float = PATTERN_AGE_S, now: Callable[[], float] = time.monotonic) -> Callable[[], DataFrame]:
    """Gives a versioned rule table, for use by ``each_batch``: within one micro-batch, and until it is ``most_age`` seconds old, it is
    one version. ``read`` gives the version there is now and its table, of which a copy is written when the version has changed, so a
    table that is replaced meanwhile changes nothing for the batches before."""
    held: dict = {}

    def current() -> DataFrame:
        if "at" not in held or now() - held["at"] >= most_age:
            version, table = read()
            if held.get("version", held) != version:
                held.update(version=version, table=written(table, "patterns"))
            held["at"] = now()
        return held["table"]

    return current


def sink(stream: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "1 second"):
    """Appends a stream to Parquet, exactly once by its checkpoint; ``once`` works off what there is and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "1 second"):
    """Calls ``act`` with each micro-batch: publishing events, refreshing broadcast rules, upserts."""
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
