"""Retries as a stream against the rules for one row at a time."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.lexicon import MAX_ATTEMPTS
from millrace.operators import stages
from millrace.streaming import retries

START = datetime(2024, 5, 1)


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state"


def put(spark, folders, rows):
    spark.createDataFrame(rows, retries.EVENT).coalesce(1).write.mode("append").parquet(folders[0])


def run(spark, folders, **options):
    q = retries.retry_stream(spark, *folders, **options)
    q.awaitTermination()
    assert q.exception() is None


def test_delays_are_those_of_the_columns(spark):
    rows = [(a, s) for a in range(0, 14) for s in (0, 16, 17, 1000)]
    got = spark.createDataFrame(rows, "a int, s long").select("a", "s", stages.delay_seconds(F.col("a"), F.col("s")).alias("d")).collect()
    assert all(r["d"] == retries.delay_seconds(r["a"], r["s"]) for r in got)


def test_rows_wait_are_due_and_are_given_up(spark, folders):
    def failed(i, at, text="x"):
        return (i, "failed", START + timedelta(seconds=at), text)

    def tick(at):
        return (-1, "tick", START + timedelta(seconds=at), None)

    put(spark, folders, [failed(1, 0, "y" * 600), failed(2, 0), failed(3, 5), (4, "done", START, None), (None, "failed", START, "no id"), (5, "failed", None, "no time")])
    run(spark, folders)
    assert {(r["id"], r["state"], r["attempts"]) for r in retries.queue_now(spark, folders[1]).collect()} == {(1, "waiting", 1), (2, "waiting", 1), (3, "waiting", 1), (4, "done", 0)}
    put(spark, folders, [tick(63)])
    run(spark, folders)  # a restart: timers are kept
    now = {r["id"]: r for r in retries.queue_now(spark, folders[1]).collect()}
    assert (now[1]["state"], now[2]["state"], now[3]["state"]) == ("due", "due", "waiting") and now[1]["due"] == START + timedelta(seconds=61) and len(now[1]["error"]) == 500
    put(spark, folders, [failed(1, 100), (3, "done", START + timedelta(seconds=70), None), *[failed(2, 200 + i) for i in range(MAX_ATTEMPTS)]])
    run(spark, folders)
    put(spark, folders, [tick(10_000_000)])
    run(spark, folders)
    now = {r["id"]: (r["state"], r["attempts"]) for r in retries.queue_now(spark, folders[1]).collect()}
    # the second row was given up at its last attempt, and the failure after that began anew
    assert now[1] == ("due", 2) and now[3] == ("done", 1) and now[2] == ("due", 1)
    seen = [(r["id"], r["change"]) for r in retries.changes(spark, folders[1]).collect()]
    assert seen.count((2, "given up")) == 1 and seen.count((3, "due")) == 1 and seen.count((1, "due")) == 2


def test_by_the_clock(spark, folders):
    put(spark, folders, [(1, "failed", START, None)])
    q = retries.retry_stream(spark, *folders, by_clock=True)
    try:
        for _ in range(120):
            if q.lastProgress and q.lastProgress["batchId"] > 0 or not q.isActive:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    (row,) = retries.queue_now(spark, folders[1]).collect()
    assert row["state"] == "waiting" and row["due"] > datetime.now() - timedelta(days=1)
