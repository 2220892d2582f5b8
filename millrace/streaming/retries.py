"""A queue of rows that failed, as a stream: state and a timer for each row, until it is due again, done or given up.

A failure makes a row wait, twice as long each time, and sets a timer; when the timer runs out the row is due. After the
last attempt it is given up. With event time the clock is the events' own, so a run over stored events is the same
whenever it is made; with processing time it is the cluster's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.lexicon import MAX_ATTEMPTS
from millrace.operators.stages import FIRST_DELAY, LONGEST_DELAY
from millrace.ship import ship

#: What happens to a row: kind is failed or done; others only move the clock.
EVENT = "id long, kind string, at timestamp, error string"
#: What becomes of it: waiting (until due), due, done or given up.
#: Rows go to and from Python with times in milliseconds; as frames of pandas each key took many times as long.
_TOLD = "id long, change string, attempts int, at long, due long, error string"
_ROW = Row("id", "change", "attempts", "at", "due", "error")
CHANGE = "id long, change string, attempts int, at timestamp, due timestamp, error string"


def delay_seconds(attempts: int, seed: int) -> int:
    """stages.delay_seconds() of one row."""
    return min(FIRST_DELAY * 2 ** min(max(0, attempts - 1), 30), LONGEST_DELAY) + seed % 17


class Retrier(StatefulProcessor):
    """Of a row: how often it failed, when it is due, and the last error. A row that is done or given up has no state."""

    def __init__(self, most: int, by_clock: bool) -> None:
        self.most, self.by_clock = most, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("row", "attempts int, due long, error string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(((r["ms"], r["kind"] is None, r["kind"] or "", r["error"]) for r in rows), key=lambda e: e[:3])
        attempts, due, last = self.state.get() or (0, None, None)
        before, out = due, []
        for at, _, kind, error in events:
            if due is not None and due <= at and not self.by_clock:  # its time came before this, though its timer did not run out yet
                out.append((key[0], "due", attempts, due, due, last))
                due = None
            if kind == "failed":
                attempts += 1
                now = int(timerValues.getCurrentProcessingTimeInMs()) if self.by_clock else at
                due = None if attempts >= self.most else now + 1000 * delay_seconds(attempts, key[0])
                out.append((key[0], "waiting" if due else "given up", attempts, at, due, error and error[:500]))
                last = error and error[:500]
                self.state.update((attempts, due, last)) if due else self.state.clear()
                attempts = attempts if due else 0
            elif kind == "done":
                out.append((key[0], "done", attempts, at, None, None))
                self.state.clear()
                attempts, due = 0, None
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        for x in out:
            yield _ROW(*x)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is not None:
            attempts, due, error = held
            if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((attempts, None, error))
                yield _ROW(key[0], "due", attempts, due, due, error)

    def close(self) -> None:
        pass


def retry_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, most: int = MAX_ATTEMPTS, by_clock: bool = False, per_batch: int = 1000) -> StreamingQuery:
    """A query over all Parquet files of events in the folder that no run has seen, oldest first; out gets the changes of each batch.

    by_clock: timers go by the cluster's clock, and the query goes on until it is stopped. Else the query ends, and timers
    go by the latest event of earlier batches, so the last ones run out when a later event, of any row, comes in.
    """
    ship(spark)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).parquet(folder).filter("id is not null and at is not null").withWatermark("at", "0 seconds")
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = events.withColumn("ms", F.unix_millis("at")).groupBy("id").transformWithState(statefulProcessor=Retrier(most, by_clock), outputStructType=_TOLD, outputMode="Update", timeMode="ProcessingTime" if by_clock else "EventTime")
        changes = told.select("id", "change", "attempts", F.timestamp_millis("at").alias("at"), F.timestamp_millis("due").alias("due"), "error")
        run = changes.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        # timers by the clock may run out at any time, so such a query goes on until it is stopped
        return run.option("checkpointLocation", checkpoint).trigger(**({"processingTime": "1 second"} if by_clock else {"availableNow": True})).start()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)


def changes(spark: SparkSession, out: str) -> DataFrame:
    """All changes so far, and batch, in which they were written."""
    return spark.read.schema(f"{CHANGE}, batch long").option("basePath", out).parquet(out)


def queue_now(spark: SparkSession, out: str) -> DataFrame:
    """(id, attempts, state, due, error): the last change of each row; of one batch the last by its time."""
    rank = F.struct("batch", "at", F.col("change") != "due")
    return changes(spark, out).groupBy("id").agg(F.max_by(F.struct("attempts", F.col("change").alias("state"), "due", "error"), rank).alias("last")).select("id", "last.*")
