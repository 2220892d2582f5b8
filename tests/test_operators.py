"""Merging, snapshots, replies, stages and the streaming ingest: properties and small cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import merging, ranking, replies, stages
from millrace.sources.feeds import POSTING
from millrace.streaming import ingest

NOW = datetime(2024, 6, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merging_does_not_depend_on_partitions(spark):
    r = random.Random(1)
    rows = [(f"k{r.randint(0, 9)}", i, f"s{r.randint(0, 3)}", r.choice([None, "", " ", "text", "longer text", "<b>text</b>"]), r.choice([None, "", f"e{i}"]), None) for i in range(200)]
    table = spark.createDataFrame(rows, "fingerprint string, ord long, source string, description string, apply_email string, salary_text string")
    want = None
    for n in (1, 3, 8):
        got = rows_of(merging.merge_batch(table.repartition(n), "fingerprint", "ord").withColumn("sources", F.array_join("sources", ",")))
        assert want in (None, got)
        want = got
    k = want[0][0]
    own = [x for x in rows if x[0] == k]
    assert want[0][1] == own[0][1] and want[0][-1] == ",".join(dict.fromkeys(x[2] for x in own))
    assert merging.merge_batch(table.limit(0), "fingerprint", "ord").count() == 0


def test_markup_alone_is_kept_and_ties_keep_the_first(spark):
    rows = [("a", 1, "s", None), ("a", 2, "s", "<p>&nbsp;</p>"), ("b", 1, "s", "same"), ("b", 2, "s", "SAME"), ("c", 1, "s", "apply now apply now apply now"), ("c", 2, "s", "real text")]
    table = spark.createDataFrame(rows, "fingerprint string, ord long, source string, description string").withColumns({"apply_email": F.lit(None).cast("string"), "salary_text": F.lit(None).cast("string")})
    got = {r["fingerprint"]: r["description"] for r in merging.merge_batch(table, "fingerprint", "ord").collect()}
    assert got == {"a": "<p>&nbsp;</p>", "b": "same", "c": "real text"}


def test_ids_are_dense_and_stable(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string")
    a, b = ({r["k"]: r["id"] for r in merging.assign_ids(rows.repartition(n), ["k"], 11).collect()} for n in (1, 7))
    assert a == b and sorted(a.values()) == list(range(11, 311))


def test_revoking_and_owners(spark):
    table = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("a", 3, NOW)], "email string, id int, revoked_at timestamp")
    new = spark.createDataFrame([("a", 9, None)], "email string, id int, revoked_at timestamp")
    got = {r["id"]: r["revoked_at"] for r in merging.revoke_then_insert(table, new, ["email"], "revoked_at", F.lit(NOW + timedelta(1))).collect()}
    assert got == {1: NOW + timedelta(1), 2: None, 3: NOW, 9: None}
    assert rows_of(merging.fill_owner(spark.createDataFrame([(None,), (2,)], "user_id int"), 7)) == [(2,), (7,)]


def test_everything_is_in_exactly_one_pile(spark):
    states = [None, "found", "matched", "applied", "rejected", "closed", "mystery"]
    dates = [None, NOW, NOW - timedelta(10), NOW - timedelta(10, 1), NOW - timedelta(10) + timedelta(seconds=1)]
    table = spark.createDataFrame([(s, d) for s in states for d in dates], "s string, d timestamp")
    got = table.select("s", "d", ranking.derived_bucket(F.col("s"), F.col("d"), NOW, 10).alias("b"), ranking.listed_bucket(F.col("s"), F.col("d"), NOW, 10).alias("l")).collect()
    assert all(r["b"] in ranking.BUCKETS for r in got)
    assert all((r["l"] is None) == (r["s"] == "mystery") for r in got)
    at_cutoff = next(r for r in got if r["s"] is None and r["d"] == NOW - timedelta(10))
    assert (at_cutoff["l"], at_cutoff["b"]) == ("inbox", "archive")


def test_views_are_sound():
    assert ranking.parse_view({"bucket": "x", "page": "-1", "q": " "}) == {"bucket": "inbox", "query": None, "page": 1}
    assert ranking.parse_view({"bucket": "archive", "page": "3", "q": "go"}) == {"bucket": "archive", "query": "go", "page": 3}


def test_pages_past_the_end_are_empty(spark):
    table = spark.range(25)
    assert [r["id"] for r in ranking.page(table, [F.desc("id")], 3, 10).collect()] == [4, 3, 2, 1, 0]
    assert ranking.page(table, [F.desc("id")], 4, 10).count() == 0


def test_reply_precedence(spark):
    sent = spark.createDataFrame([(1, "<a@x>", "p@y.org"), (2, "<b@x>", "q@y.org"), (3, "<a@x>", "p@y.org"), (4, "", "")], "ord long, message_id string, sent_to string")
    inbound = spark.createDataFrame([
        (1, "<A@X>", ["b@x"], "q@y.org"), (2, "", ["a@x", "b@x", "zz"], "p@y.org"), (3, None, [], "Q <q@y.org>"), (4, None, None, "nobody"), (5, "zz", ["a@x"], "q@y.org"), (6, None, [], "p@y.org"),
    ], "ord long, in_reply_to string, references array<string>, sender string")
    got = replies.match_replies(sent, inbound)
    assert rows_of(got) == [(1, 1, "in-reply-to"), (2, 2, "references"), (3, 2, "sender"), (5, 1, "references"), (6, 1, "sender")]
    assert rows_of(replies.first_reply(got).select("ref_ord", "ord")) == [(1, 1), (2, 2)]
    assert replies.match_replies(sent.limit(0), inbound).count() == 0


def test_backoff_is_monotone_and_capped(spark):
    table = spark.range(1, 40).select(F.col("id").alias("n"))
    waits = [r["w"] for r in table.select(stages.delay_seconds(F.col("n").cast("int"), F.lit(34)).alias("w")).orderBy("n").collect()]
    assert waits[:4] == [60, 120, 240, 480] and waits == sorted(waits) and waits[-1] == 6 * 3600
    assert [r["w"] for r in table.select(stages.delay_seconds(F.lit(1), F.col("n")).alias("w")).orderBy("n").collect()] == [60 + i % 17 for i in range(1, 40)]


def test_the_last_attempt_ends_a_row(spark):
    rows = spark.createDataFrame([(1, 3, "score"), (2, 4, "score")], "id long, attempts int, stage string").withColumns({"next_attempt_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")})
    got = {r["id"]: r for r in stages.failed(rows, F.lit("x" * 900), NOW).collect()}
    assert (got[1]["stage"], got[2]["stage"], got[2]["next_attempt_at"], len(got[1]["last_error"])) == ("score", "done", None, 500)
    assert got[1]["next_attempt_at"] == NOW + timedelta(seconds=480 + 1)


def test_follow_ups_count_from_the_first_message(spark):
    rows = spark.createDataFrame([(0, NOW), (1, NOW), (2, NOW)], "n int, sent timestamp")
    assert [r["d"] for r in rows.select(stages.next_follow_up(F.col("n"), F.col("sent")).alias("d")).orderBy("d").collect()] == [None, NOW + timedelta(4), NOW + timedelta(10)]


def test_ranking_is_one_pruned_pass(spark):
    from millrace.plans.catalogue import QUERIES

    plan = QUERIES["ranked_inbox"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def posting(key, title, company, description, ord_, source="s"):
    row = dict.fromkeys(POSTING) | {"source": source, "source_id": key, "title": title, "company": company, "url": "u", "location": "Remote", "remote": True, "tags": [], "description": description}
    return (*row.values(), ord_)


SCHEMA = ", ".join(f"{c} {t}" for c, t in POSTING.items()) + ", ord bigint"


@pytest.fixture
def drop(spark, tmp_path):
    folder = tmp_path / "drop"

    def put(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    return put, str(folder), str(tmp_path / "snapshots"), str(tmp_path / "state")


def test_stream_of_postings(spark, drop):
    put, folder, out, state = drop

    def run():
        query = ingest.ingest_stream(spark, folder, out, state)
        assert query.awaitTermination(120)
        return {r["fingerprint"]: r.asDict() for r in ingest.current(spark, out).collect()}

    put(posting("1", "Go Dev", "Acme Inc", None, 1), posting("2", "go dev", "ACME", "short", 2, "t"), posting("3", "Ops", "Beta", "d", 3))
    first = run()
    assert {k: (r["id"] in (1, 2), r["sources"], r["stage"], r["description"]) for k, r in first.items()} == {"acme|go dev|remote": (True, ["s", "t"], "score", "short"), "beta|ops|remote": (True, ["s"], "score", "d")}
    put(posting("9", "Go Dev", "Acme", "a much longer description, 5+ years of work", 1, "u"), posting("3", "Ops", "Beta", "changed by its own source", 2), posting("4", "New", "Gamma", None, 3))
    second = run()
    merged = second["acme|go dev|remote"]
    assert (merged["id"], merged["sources"], merged["description_source"], merged["stage"], merged["min_years"]) == (first["acme|go dev|remote"]["id"], ["s", "t", "u"], "merged:u", "score", 5)
    assert second["beta|ops|remote"]["description"] == "d" and second["gamma|new|remote"]["stage"] == "enrich" and second["gamma|new|remote"]["id"] == 3
    assert run().keys() == second.keys() and len(ingest.snapshots(spark, out)) == 2


def test_a_batch_may_run_twice(spark, drop):
    _, _, out, _ = drop
    rows = spark.createDataFrame([posting("1", "Go Dev", "Acme", "x", 1)], SCHEMA)
    for _ in range(2):
        ingest.ingest_batch(spark, rows, out, 0)
    assert ingest.current(spark, out).count() == 1 and ingest.current(spark, out, 0).count() == 0


def test_a_batch_writes_only_its_buckets(spark, drop):
    _, _, out, _ = drop
    for n, rows in enumerate([[posting(str(i), f"Dev {i}", "Acme", "x", i) for i in range(40)], [posting("new", "Dev 7", "Acme", "a longer text about the work", 1, "u"), posting("3", "Elsewhere", "Beta", "x", 2)], []]):
        ingest.ingest_batch(spark, spark.createDataFrame(rows, SCHEMA), out, n)
    assert ingest.snapshots(spark, out) == [0, 1, 2]
    first, last = [{r["fingerprint"]: r.asDict() for r in ingest.current(spark, out, n).collect()} for n in (1, None)]
    changed = {k for k in last if last[k] != first.get(k)}
    assert len(first) == 40 and last.keys() == first.keys() and sorted(r["id"] for r in last.values()) == list(range(1, 41))
    assert changed == {"acme|dev 7|remote"} and last["acme|dev 7|remote"]["sources"] == ["s", "u"]
    assert len([n for n in ingest._listed(spark, f"{out}/batch=1") if n.startswith("bucket=")]) <= 2


def test_buckets_are_dealt_anew_and_old_folders_go(spark, drop):
    """The table is the same however many buckets it has, and keys stored under another fingerprint stay out."""
    _, _, out, _ = drop
    parts = [[posting(f"{k}-{i}", f"Dev {i}", f"Firm {k}", "x", i) for i in range(30)] for k in range(3)] + [[posting("0-5", "Renamed", "Firm 9", "x", 1), posting("z", "Dev 1", "Firm 0", "a longer text about the work", 2, "u")]]
    for n, rows in enumerate(parts):
        ingest.ingest_batch(spark, spark.createDataFrame(rows, SCHEMA), out, n, bucket_rows=0 if n == 2 else 1000)
    last = ingest.manifest(spark, out)
    assert (last.batch, last.total, last.top, last.buckets) == (3, 90, 90, 2 * ingest.BUCKETS) and {n for n in last.rows.values()} == {2, 3}
    rows = {r["fingerprint"]: r["sources"] for r in ingest.current(spark, out).collect()}
    assert len(rows) == 90 and rows["firm 0|dev 1|remote"] == ["s", "u"] and "firm 9|renamed|remote" not in rows
    assert ingest.current(spark, out, 2).count() == 60
    assert ingest.expire(spark, out, keep=2) > 50
    assert ingest.snapshots(spark, out) == [2, 3] and ingest.current(spark, out).count() == 90 and ingest.current(spark, out, 3).count() == 90


def test_rows_without_a_page_do_not_meet_in_one_task(spark):
    """Only alert cards have a page to look up; all other rows stay where they are."""
    from millrace.operators import backfill

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        key = F.col("id")
        rows = spark.range(0, 4000, 1, 4).select(
            key, F.when(key % 100 == 0, "linkedin_alert").otherwise("x").alias("source"), F.lit("Unknown").alias("company"), F.lit("found").alias("status"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), key.cast("string")).alias("url"),
            F.lit("score").alias("stage"), F.lit(3).alias("attempts"), F.lit("e").alias("last_error"), F.lit(None).cast("timestamp").alias("next_attempt_at"),
        )
        got = backfill.requeued(rows, spark.createDataFrame([("100",), ("7",)], "job_id string"))
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= 1000
        assert sorted(r["id"] for r in got.filter("requeued").collect()) == [i for i in range(0, 4000, 100) if i != 100]
        assert got.count() == 4000 and got.filter("requeued and stage = 'enrich' and attempts = 0 and last_error is null").count() == 39
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_merge_measures_each_text_once(spark):
    """However many columns follow from the richer text."""
    kinds = "fingerprint string, source string, source_id string, sources array<string>, title string, description string, apply_email string"
    batch = spark.createDataFrame([("a", "n", "1", ["n"], "Dev", "At least 5 years of work", ""), ("b", "n", "2", ["n"], None, None, "x@y.z"), ("c", "n", "3", ["n"], "Dev", "same", None), ("d", "n", "4", ["n"], "Dev", "new", None)], kinds)
    stored = spark.createDataFrame([(1, "a", "o", "1", ["o"], "Dev", "short", None), (2, "b", "o", "2", ["o"], "Dev", "longer text", ""), (3, "c", "o", "3", ["o"], "Dev", "same", None)], f"id long, {kinds}")
    found = merging.reconcile(batch, stored)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(script|style)") == 2
    got = {r["fingerprint"]: (r["action"], r["description"], r["stage"], r["min_years"], r["sources"]) for r in found.collect()}
    assert got == {"a": ("merge", "At least 5 years of work", "score", 5, ["o", "n"]), "b": ("merge", "longer text", None, None, ["o", "n"]), "c": ("merge", "same", None, None, ["o", "n"]), "d": ("insert", "new", "score", None, ["n"])}
