"""Replies to sent messages as a stream, and what they write back.

Sent and inbound messages come in any order. Each message is an event for every key that it could be matched by: its own
message id and recipient if it was sent, what it answers, what it refers to and its sender if it came in. State is kept
for each key: the first sent message that has it, and the inbound ones that named it. So a pair is found whichever of
the two comes first. Matches only ever get better, by the order (rule, place, first sent), so what the batches wrote is
reduced to the best of each inbound message when it is read, and neither the order of files, nor a batch that runs
again, nor a message that comes twice changes it. State goes when event time has passed its last event by the look-back.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import extract_address, message_id
from millrace.ship import ship

#: A message as it is read: ord tells messages apart and says which is first; sent ones have sent_to, inbound ones sender.
MESSAGE = "ord long, sent boolean, message_id string, in_reply_to string, references array<string>, sent_to string, sender string, at timestamp"
LOOK_BACK = timedelta(days=14)
#: The rules in order of precedence.
RULES = ["in-reply-to", "references", "sender"]
_TOLD = "ord long, rule int, place int, ref_ord long, ms long"  # rows go to and from Python with times in milliseconds; as frames of pandas each key took many times as long
_ROW = Row("ord", "rule", "place", "ref_ord", "ms")
_FOUND = "ord long, rule int, place int, ref_ord long, replied_at timestamp"


def key_events(messages: DataFrame) -> DataFrame:
    """(key, sent, ord, rule, place, at): an event for each key of each message; empty keys are none."""
    def event(kind: str, value: Column, rule: int, place: Column) -> Column:
        return F.struct(F.when(value != "", F.concat(F.lit(kind), value)).alias("key"), F.lit(rule).alias("rule"), place.cast("int").alias("place"))

    thread = F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r, i: event("id:", message_id(r), 1, -i))
    sent = F.array(event("id:", message_id(F.col("message_id")), 0, F.lit(0)), event("to:", extract_address(F.col("sent_to")), 2, F.lit(0)))
    inbound = F.concat(F.array(event("id:", message_id(F.col("in_reply_to")), 0, F.lit(0)), event("to:", extract_address(F.col("sender")), 2, F.lit(0))), thread)
    return messages.select("ord", "sent", "at", F.explode(F.when(F.col("sent"), sent).otherwise(inbound)).alias("e")).filter("e.key is not null").select("e.key", "sent", "ord", "e.rule", "e.place", "at")


class Matcher(StatefulProcessor):
    """Of a key: the first sent message, the inbound messages that named it, and when the key was last heard of."""

    def __init__(self, look_back: timedelta) -> None:
        self.keep_ms = int(look_back.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ord long")
        self.last = handle.getValueState("last", "ms long")
        self.waiting = handle.getListState("waiting", "ord long, rule int, place int, ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, heard = self.first.get(), self.last.get()
        before = held[0] if held is not None else None
        came, first, last = [], before, heard[0] if heard is not None else 0
        for r in rows:
            last = max(last, r["ms"] or 0)
            if not r["sent"]:
                came.append((r["ord"], r["rule"], r["place"], r["ms"]))
            elif first is None or r["ord"] < first:
                first = r["ord"]
        if first != before:  # those that came before meet the sent message now, or an earlier one
            self.first.update((first,))
            found = [*map(tuple, self.waiting.get()), *came]
        else:
            found = came if first is not None else []
        if came:
            self.waiting.appendList(came)
        self.last.update((last,))
        self.handle.registerTimer(last + self.keep_ms)
        for o, rule, place, ms in found:
            yield _ROW(o, rule, place, first, ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        heard = self.last.get()
        if heard is not None and heard[0] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            for state in (self.first, self.last, self.waiting):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


def best_of(found: DataFrame) -> DataFrame:
    """The best match of each inbound message: (ord, rule, place, ref_ord, replied_at)."""
    return found.groupBy("ord").agg(F.min(F.struct("rule", "place", "ref_ord", "replied_at")).alias("m")).select("ord", "m.*")


def watch_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, look_back: timedelta = LOOK_BACK, per_batch: int = 1000) -> StreamingQuery:
    """A query that matches all Parquet files of messages in the folder that no run has seen, and ends. out gets a folder a batch.

    An event is late, and left out, if it is older than the look-back behind the latest of earlier batches.
    """
    ship(spark)
    arriving = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_batch).parquet(folder)
    events = key_events(arriving).withWatermark("at", f"{int(look_back.total_seconds())} seconds")
    told = events.withColumn("ms", F.unix_millis("at")).groupBy("key").transformWithState(statefulProcessor=Matcher(look_back), outputStructType=_TOLD, outputMode="Update", timeMode="EventTime")
    found = told.select("ord", "rule", "place", "ref_ord", F.timestamp_millis("ms").alias("replied_at"))

    def write(rows: DataFrame, batch: int) -> None:
        best_of(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # a query keeps what it was started with
    try:
        return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)


def matches(spark: SparkSession, out: str) -> DataFrame:
    """(ord, ref_ord, matched_by, replied_at) of all batches so far, as replies.match_replies has the first three."""
    best = best_of(spark.read.schema(_FOUND).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(out))
    return best.select("ord", "ref_ord", F.get(F.array(*map(F.lit, RULES)), F.col("rule")).alias("matched_by"), "replied_at")


def write_back(sent: DataFrame, found: DataFrame, ord_col: str = "ord") -> DataFrame:
    """sent after its replies: a row that is sent and unanswered gets the status responded, the time of its first reply and no next follow-up.

    An answered row stays as it is, so a later message never moves responded_at. weak: whether the reply was told by its
    sender alone, which is worth a look; null where nothing was written. sent has status, responded_at and next_follow_up_at.
    """
    first = found.groupBy(F.col("ref_ord").alias(ord_col)).agg(F.min(F.struct("ord", "replied_at", "matched_by")).alias("reply"))
    joined = sent.join(first, ord_col, "left")
    answered = F.col("reply").isNotNull() & (F.col("status") == "sent") & F.col("responded_at").isNull()
    return joined.withColumns({
        "weak": F.when(answered, F.col("reply.matched_by") == "sender"), "next_follow_up_at": F.when(~F.coalesce(answered, F.lit(False)), F.col("next_follow_up_at")),
        "responded_at": F.when(answered, F.col("reply.replied_at")).otherwise(F.col("responded_at")), "status": F.when(answered, "responded").otherwise(F.col("status")),
    }).select(*sent.columns, "weak")
