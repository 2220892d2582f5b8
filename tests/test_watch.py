"""Replies as a stream against the batch operators, whatever the order of files, with restarts, repeats and late messages."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import replies
from millrace.streaming import watch

START = datetime(2024, 5, 1)


def messages(seed, n=90):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(minutes=r.randint(0, 3000))
        thread = [f"<m{r.randint(0, n)}@x>" for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            out.append((i, True, r.choice([f"<m{i}@x>", f" <<M{i}@X>> ", None, f"<m{r.randint(0, n)}@x>"]), None, None, r.choice([None, f"P{r.randint(0, 5)} <p{r.randint(0, 5)}@Y.org>"]), None, at))
        else:
            out.append((i, False, f"<m{i}@x>", r.choice([None, "", f"<m{r.randint(0, n)}@x>"]), r.choice([None, thread]), None, r.choice([None, f"p{r.randint(0, 9)}@y.org"]), at))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, watch.MESSAGE)


def batch(all_of):
    sent, inbound = all_of.filter("sent"), all_of.filter("not sent")
    found = replies.match_replies(sent.select("ord", "message_id", "sent_to"), inbound.select("ord", "in_reply_to", F.coalesce("references", F.array().cast("array<string>")).alias("references"), "sender"))
    return sorted(map(tuple, found.select("ord", "ref_ord", "matched_by").collect())), sorted(map(tuple, replies.first_reply(found).select("ref_ord", "ord").collect()))


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state"


def put(spark, rows, folder):
    table(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folders, **options):
    q = watch.watch_stream(spark, *folders, **options)
    q.awaitTermination()
    assert q.exception() is None
    return watch.matches(spark, folders[1])


def test_any_order_of_files_and_restarts(spark, folders):
    rows = messages(1)
    want, first = batch(table(spark, rows))
    random.Random(2).shuffle(rows)
    for part in (rows[:40], rows[40:60], rows[55:], rows[:10]):  # some come twice
        put(spark, part, folders[0])
        got = run(spark, folders, per_batch=1)  # each run starts from the state that the one before left
    assert sorted((r["ord"], r["ref_ord"], r["matched_by"]) for r in got.collect()) == want and len(want) > 20
    assert sorted((r["ref_ord"], r["o"]) for r in got.groupBy("ref_ord").agg(F.min("ord").alias("o")).collect()) == first
    times = {r[0]: r[-1] for r in rows}
    assert all(r["replied_at"] == times[r["ord"]] for r in got.collect())


def test_late_messages_are_left_out_and_state_goes(spark, folders):
    def sent(i, day):
        return (i, True, f"<s{i}@x>", None, None, None, None, START + timedelta(days=day))

    def reply(i, to, day):
        return (i, False, f"<r{i}@x>", f"<s{to}@x>", None, None, None, START + timedelta(days=day))

    for rows in ([sent(1, 0), sent(2, 0), reply(10, 1, 1)], [sent(3, 40)], [sent(4, 41)], [reply(11, 2, 2), reply(12, 3, 41)], [reply(13, 1, 41), reply(14, 4, 42)]):
        put(spark, rows, folders[0])
        got = run(spark, folders)
    # 11 is older than the look-back behind the fortieth day; 13 is not, but what it answers is forgotten
    assert {(r["ord"], r["ref_ord"]) for r in got.collect()} == {(10, 1), (12, 3), (14, 4)}


def test_write_back_happens_once(spark):
    rows = [(1, "sent", None, START), (2, "sent", START, START), (3, "draft", None, START), (4, "sent", None, None), (5, "sent", None, START), (6, None, None, START)]
    sent = spark.createDataFrame(rows, "ord long, status string, responded_at timestamp, next_follow_up_at timestamp")
    later = START + timedelta(1)
    found = spark.createDataFrame([(20, 1, "references", later), (19, 1, "sender", START + timedelta(3)), (21, 2, "sender", later), (22, 3, "sender", later), (23, 4, "in-reply-to", later), (24, 6, "sender", later)], "ord long, ref_ord long, matched_by string, replied_at timestamp")
    once = watch.write_back(sent, found)
    want = {(1, "responded", START + timedelta(3), None, True), (2, "sent", START, START, None), (3, "draft", None, START, None), (4, "responded", later, None, False), (5, "sent", None, START, None), (6, None, None, START, None)}
    assert set(map(tuple, once.collect())) == want
    again = watch.write_back(once.drop("weak"), found.withColumn("ord", F.col("ord") - 10))
    assert set(map(tuple, again.drop("weak").collect())) == {x[:4] for x in want}
