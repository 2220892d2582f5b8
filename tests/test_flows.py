"""Sifted payloads, settings, caps over groups of any size, backfills and versions: small cases and properties."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import facts, scoring, settings
from millrace.operators import backfill, stages
from millrace.sources import sifting

NOW = datetime(2024, 6, 1)


def test_what_comes_in_adds_up(spark, tmp_path):
    bodies = ["", None, "  ", "{", "[1, 2", "[]", "{}", '"x"', '{"jobs": 3}', '[{"id": 1}]', '{"jobs": [{"id": "a"}, {"id": null}, {"id": {}}, 5, null, [{"id": 1}]]}', '[{"id": "é\\n"}]trailing', "null"]
    table = spark.createDataFrame([(f"p{i:02}", "src" if i % 2 else "other", b) for i, b in enumerate(bodies)], "payload string, source string, body string")
    found = sifting.sift(table, ("$", "$.jobs"), ("id",))
    rows = [(r["payload"], r["pos"], r["reason"]) for r in found.drop("entry").orderBy("payload", "pos").collect()]
    assert rows == [
        ("p00", None, "empty"), ("p01", None, "empty"), ("p02", None, "empty"), ("p03", None, "not JSON"), ("p04", None, "not JSON"), ("p05", None, "no entries"), ("p06", None, "no list"), ("p07", None, "no list"), ("p08", None, "no list"),
        ("p09", 0, None), ("p10", 0, None), ("p10", 1, "no id"), ("p10", 2, "no id"), ("p10", 3, "not an object"), ("p10", 4, "not an object"), ("p10", 5, "not an object"), ("p11", None, "not JSON"), ("p12", None, "no list"),
    ]
    counts = sifting.tally(found, []).first()
    assert tuple(counts) == (13, 3, 10, 2, 5)
    entries, refused = sifting.route(found, str(tmp_path / "out"))
    assert sorted(json.loads(r["entry"])["id"] for r in entries.collect() if r["payload"] == "p09") == [1] and entries.count() == 2
    assert refused.count() == 16 and {r["head"] for r in refused.collect() if r["payload"] == "p04"} == {"[1, 2"}
    assert sifting.sift(table.limit(0)).count() == 0


def test_texts_of_one_or_many(spark):
    rows = spark.createDataFrame([('{"a": ["x", "", null, 3]}',), ('{"a": "x"}',), ('{"a": ""}',), ("{}",), ('{"a": 5}',)], "j string").select(sifting.texts_of(F.parse_json("j"), "$.a").alias("t"))
    assert [r["t"] for r in rows.collect()] == [["x", "3"], ["x"], [], [], ["5"]]


def test_each_key_falls_back_by_itself(spark):
    asked, want = [None, "", "{", "[]", "3", "null"], []
    defaults = {s.name: s.default for s in settings.SETTINGS}
    want += [defaults] * len(asked)
    for s in settings.SETTINGS:
        wrong = {"boolean": [1, "true", None, []], "long": [s.low is not None and s.low - 1, (s.high or 0) + 1, "7", 1.5, None, True], "string": [1, "", None, {}]}[s.kind]
        for value in wrong:
            good = {"MATCH_THRESHOLD": 55} if s.name == "DRY_RUN" else {"DRY_RUN": True}
            asked.append(json.dumps({s.name: value} | good))
            want.append(defaults | good)
    good = {s.name: (not s.default) if s.kind == "boolean" else s.high if s.kind == "long" else "other" for s in settings.SETTINGS}
    got = spark.createDataFrame([(i, d) for i, d in enumerate([*asked, json.dumps(good)])], "i int, d string").select("i", settings.parse_settings(F.col("d")).alias("s")).orderBy("i").collect()
    assert [r["s"].asDict() for r in got] == [*want, good]
    both = spark.createDataFrame([('{"FOLLOWUP_FIRST_DAYS": 10}',), ('{"DRY_RUN": true}',)], "d string").select(settings.parse_settings(F.col("d")).alias("s"))
    assert [len(r[0]) for r in both.select(settings.problems(F.col("s"))).collect()] == [1, 0]
    assert [tuple(r) for r in both.select(settings.dry_run(F.col("s")), settings.dry_run(F.col("s"), True)).collect()] == [(False, True), (True, True)]


@pytest.mark.parametrize("by", [[], ["owner"], ["owner", "day"]])
@pytest.mark.parametrize("stretch", [10, 10_000])
def test_spread_cap_is_the_plain_cap(spark, by, stretch):
    """One owner has most rows, some have none, owners may be null; orders tie and are null."""
    r = random.Random(7)
    rows = [(i, r.choice(["hot"] * 8 + ["b", None]), r.randint(0, 2), r.choice([None, r.randint(0, 50), r.random() * 1e6]), r.choice([True, True, False, None]), r.choice([0, 3])) for i in range(3000)]
    table = spark.createDataFrame([(a, b, c, None if d is None else float(d), e, f) for a, b, c, d, e, f in rows], "id long, owner string, day int, price double, ok boolean, used int").repartition(5)
    got = stages.within_cap_spread(table, by, "price", "id", F.col("ok"), F.col("used"), 40, stretch)
    assert got.columns == [*table.columns, "allowed"]
    want = stages.within_cap(table.withColumn("one", F.lit(1)), by or ["one"], [F.col("price"), F.col("id")], F.coalesce("ok", F.lit(False)), F.col("used"), 40)
    assert sorted(map(tuple, got.select("id", "allowed").collect())) == sorted(map(tuple, want.select("id", "allowed").collect()))
    assert stages.within_cap_spread(table.limit(0), by, "price", "id", F.col("ok"), F.col("used"), 40).count() == 0


def test_no_task_orders_a_whole_group(spark):
    table = spark.range(50_000).select("id", (F.col("id") * 7 % 50_000).cast("double").alias("price"))
    got = stages.within_cap_spread(table, [], "price", "id", F.lit(True), F.lit(0), 20_000, stretch=1000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window ")]
    assert len(windows) == 2 and all("__s" in x for x in windows)
    assert sum("[__all" in x and "__s" in x.split("], [")[1] for x in windows) == 1  # rows by stretch; the other window adds up stretches
    assert got.filter("allowed").agg(F.count("*"), F.max("price")).first()[:] == (20_000, 19_999.0)


STORED = "id long, source string, title string, company string, description string, url string, location string, tags array<string>, remote boolean, easy_apply boolean, sparse boolean, arrangement string, geo_eligibility string, geo_regions array<string>, min_years int, max_years int, experience_text string, facts_version int, score int, score_reasons array<string>, status string, stage string, attempts int, last_error string, next_attempt_at timestamp"


def stored(spark, rows):
    base = dict(source="remoteok", title="Engineer", company="Acme", tags=[], status="found", stage="done", attempts=2, experience_text="stale", arrangement="onsite", min_years=9)
    names = [c.split()[0] for c in STORED.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], STORED)


def test_backfill_reports_and_switches_at_once(spark, tmp_path):
    rows = stored(spark, [
        dict(id=1, location="Remote, Worldwide", description="at least 3 years of experience", status="rejected"), dict(id=2, facts_version=facts.DERIVED_VERSION), dict(id=3, status="applied", facts_version=0),
        dict(id=4, source="linkedin_alert", title="Data Engineer · Pune, India Easy Apply"),
    ])
    folder = backfill.Versions(spark, f"file://{tmp_path}/table")
    with pytest.raises(ValueError):
        folder.read()
    folder.switch(folder.stage(rows))
    options = (facts.DERIVED_VERSION, scoring.Profile(), NOW, ["arrangement", "status"])
    report = {tuple(r) for r in backfill.run(folder, *options).collect()}
    assert report == {("arrangement", "onsite", 3, 0), ("arrangement", "remote", 0, 1), ("arrangement", "null", 0, 2), ("status", "found", 1, 2), ("status", "rejected", 1, 0), ("status", "applied", 1, 1)}
    assert folder.numbers() == [1] and folder.read().filter("arrangement = 'onsite'").count() == 4  # nothing is written unless asked for
    after = backfill.backfilled(folder.read(), *options[:3])
    assert folder.stage(after.drop("changed")) == 2  # a writer that dies here
    assert folder.read().filter("arrangement = 'onsite'").count() == 4
    assert {tuple(r) for r in backfill.run(folder, *options, write=True).collect()} == report
    got = {r["id"]: r for r in folder.read().collect()}
    assert folder.numbers() == [1, 2] and folder.read(1).filter("arrangement = 'onsite'").count() == 4
    assert (got[1]["arrangement"], got[1]["remote"], got[1]["geo_eligibility"], got[1]["min_years"], got[1]["stage"], got[1]["attempts"], got[1]["sparse"]) == ("remote", True, "worldwide", 3, "score", 0, False)
    assert (got[2]["arrangement"], got[2]["experience_text"], got[2]["stage"], got[2]["attempts"]) == ("onsite", "stale", "done", 2)
    assert (got[3]["status"], got[3]["stage"], got[3]["experience_text"], got[3]["sparse"]) == ("applied", "done", None, True)
    assert (got[4]["title"], got[4]["location"], got[4]["easy_apply"]) == ("Data Engineer", "Pune, India", True)
    assert backfill.run(folder, *options).count() == 0  # all rows are of the version now
    with pytest.raises(Exception):
        folder.switch(2)


def test_cards_are_fetched_again_once(spark):
    card = dict(source="linkedin_alert", company="Unknown", last_error="x", next_attempt_at=NOW)
    page = "https://www.linkedin.com/jobs/view/"
    rows = stored(spark, [dict(card, id=1, url=page + "11"), dict(card, id=2, url=page + "12"), dict(card, id=3, url="https://x.org"), dict(card, id=4, url=page + "14", status="applied"), dict(card, id=5, url=page + "15", company="Acme"), dict(card, id=6, url=None)])
    cache = spark.createDataFrame([("12",), ("12",)], "job_id string")
    got = {r["id"]: (r["requeued"], r["stage"], r["attempts"], r["last_error"]) for r in backfill.requeued(rows, cache).collect()}
    assert got[1] == (True, "enrich", 0, None) and all(got[i] == (False, "done", 2, "x") for i in range(2, 7))
    again = backfill.requeued(backfill.requeued(rows, cache).drop("requeued"), cache.union(spark.createDataFrame([("11",)], "job_id string")))
    assert not again.filter("requeued").count()
