"""Streams give what batches give; sources and sinks round-trip."""

import time
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from brookledger.sources import files
from brookledger.streaming import jobs


def work_off(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_event_windows_stream_as_batch(spark, tmp_path):
    e = spark.range(400).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 97)).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") % 7).cast("double").alias("value"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(datetime(2024, 3, 1), "0", 0.0)], "ts timestamp, event_type string, value double")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.source(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double", 1)
    work_off(jobs.sink(jobs.event_windows(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    want = {tuple(r) for r in jobs.event_windows(e).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_sms_are_taken_once(spark, tmp_path):
    body = "Rs.500 debited from a/c XX1234"
    df = spark.createDataFrame([(1, "AD-HDFCBK", body, datetime(2024, 1, 1)), (1, "AD-HDFCBK", body, datetime(2024, 1, 1)), (2, "AD-HDFCBK", body, datetime(2024, 1, 1)), (1, "AD-HDFCBK", "482913 is your OTP", datetime(2024, 1, 1))], "user_id long, address string, body string, sent timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.source(spark, str(tmp_path / "in"), df.schema)
    work_off(jobs.sink(jobs.sms_entries(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["user_id"], r["amount"], r["direction"]) for r in got.collect()) == [(1, Decimal("500.00"), "debit"), (2, Decimal("500.00"), "debit")] == sorted((r["user_id"], r["amount"], r["direction"]) for r in jobs.sms_entries(df).collect())


def test_retries(spark, tmp_path):
    df = spark.createDataFrame([(1, False), (1, False), (1, False), (2, False), (2, True)], "job_id long, ok boolean").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    work_off(jobs.each_batch(jobs.retries(jobs.source(spark, str(tmp_path / "in"), df.schema)), lambda b, _: seen.extend(b.collect()), str(tmp_path / "cp")))
    assert sorted((r["job_id"], r["attempts"], r["status"], r["wait_seconds"]) for r in seen) == [(1, 1, "queued", 2), (1, 2, "queued", 4), (1, 3, "dlq", None), (2, 1, "queued", 2), (2, 2, "completed", None)]


def stage_batches(spark, tmp_path, batches, ttl=jobs.STAGE_TTL_MS, waits=()):
    """What ``stages`` gives for each batch, worked off one by one with the same checkpoint."""
    out = []
    for k, part in enumerate(batches):
        spark.createDataFrame(part, "job_id long, stage string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in waits:
            time.sleep(waits[k])
        seen = []
        stream = jobs.source(spark, str(tmp_path / "in"), "job_id long, stage string, at timestamp")
        query = jobs.stages(stream, ttl).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        for _ in range(120):  # state that ages keeps a query going, so it is stopped once it has read the rows
            if query.exception() or sum(p["numInputRows"] for p in query.recentProgress) >= len(part):
                break
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None
        out.append({r["job_id"]: r["stage"] for r in seen})
    return out


def test_last_stage_of_each_job(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    got = stage_batches(spark, tmp_path, [
        [(1, "parsing", at(5)), (2, "queued", at(1)), (1, "queued", at(1)), (4, None, at(1)), (4, "queued", None)],
        [(1, "started", at(3)), (3, "queued", at(9)), (2, "parsing", at(1)), (2, "done", at(0))],
        [(3, "done", at(11)), (3, "parsing", at(10)), (1, "done", at(6))],
    ])
    # Reordered updates within a batch, late ones between batches, and equal times.
    assert got == [{1: "parsing", 2: "queued"}, {3: "queued"}, {1: "done", 3: "done"}]


def test_stages_are_forgotten(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    batches = [[(1, "done", at(9))], [(1, "queued", at(1))]]
    assert stage_batches(spark, tmp_path / "a", batches) == [{1: "done"}, {}]
    assert stage_batches(spark, tmp_path / "b", batches, 2000, {1: 4}) == [{1: "done"}, {1: "queued"}]


def test_rules_are_read_again_by_age(spark, tmp_path):
    """A new version takes effect with the first batch after the age, and not before."""
    table, clock, reads = {"v": 1}, [0.0], []

    def read():
        reads.append(table["v"])
        return table["v"], spark.createDataFrame([(f"rule {table['v']}",)], "rule string")

    rules = jobs.pattern_cache(read, 300, lambda: clock[0])
    for k in range(5):
        spark.createDataFrame([(k,)], "n long").coalesce(1).write.parquet(str(tmp_path / "in" / f"d={k}"))
    seen = []

    def act(batch, number):
        seen.extend((number, r["rule"]) for r in batch.crossJoin(F.broadcast(rules())).collect())
        clock[0], table["v"] = clock[0] + 150, 2 if number == 0 else table["v"]

    work_off(jobs.each_batch(jobs.source(spark, str(tmp_path / "in" / "*"), "n long", 1), act, str(tmp_path / "cp")))
    assert [r for _, r in sorted(seen)] == ["rule 1", "rule 1", "rule 2", "rule 2", "rule 2"] and reads == [1, 2, 2]


def test_files(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.csv").write_text("x, y\n,\n1,2\n")
    (tmp_path / "d" / "sub" / "b.csv").write_text("x, y\n,\n1,2\n")
    found = files.folder(spark, str(tmp_path / "d"))
    assert found.count() == 2 and found.select("file_hash").distinct().count() == 1
    assert files.new_files(found, spark.createDataFrame([], "file_hash string")).count() == 1
    assert files.new_files(found, found.select("file_hash")).count() == 0
    assert [r["line"] for r in files.csv_lines(spark, str(tmp_path / "d" / "a.csv")).orderBy("line_no").collect()] == ["x | y", "1 | 2"]
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None)], "doc_id string, page_no int, text string")
    assert files.page_texts(pages).first()["text"] == "a\nb\n"


def test_ledger_round_trip(spark, tmp_path):
    led = spark.createDataFrame([(i, i % 3, date(2024, 1 + i % 2, 1), Decimal(i), "debit", "expense", None, "raw", None, "HDFC", None, i == 5) for i in range(12)], "txn_id long, user_id long, transaction_date date, amount decimal(14,2), direction string, nature string, category_name string, merchant_raw string, merchant_normalized string, bank_name string, account_masked string, is_excluded boolean")
    files.write_by_month(led, str(tmp_path / "led"))
    assert sorted(r["txn_id"] for r in files.read_user(spark, str(tmp_path / "led"), 1).collect()) == [1, 4, 7, 10]
    files.export_csv(led, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == files.EXPORT and back.count() == 11 and back.where("amount = '3.00'").count() == 1
    files.write_pack({"ledger": led, "empty": led.limit(0)}, str(tmp_path / "pack"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "pack" / "ledger")).count() == 12
