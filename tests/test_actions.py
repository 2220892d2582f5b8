"""Marks, run logs, drifted schemas, stored buckets, views and sources read side by side."""

from __future__ import annotations

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import actions, ranking, schemas
from millrace.sources import registry

NOW = datetime(2024, 6, 1)


def test_last_mark_counts_and_mail_is_history(spark):
    jobs = spark.createDataFrame([(1, "found", None), (2, "found", None), (3, "found", None)], "id long, status string, updated_at timestamp")
    applications = spark.createDataFrame([(1, "manual_portal", "draft", None), (1, "auto", "sent", datetime(2024, 1, 1)), (2, "manual_portal", "sent", NOW), (None, "manual_portal", "x", None)], "job_id long, send_mode string, status string, sent_at timestamp")
    marks = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, None), (4, 2, True), (5, 99, True), (6, 0, True), (7, None, None)], "ord long, job_id long, undo boolean")
    after, sent, refused = actions.mark_applied(jobs, applications, marks, NOW)
    assert sorted(map(tuple, after.collect())) == [(1, "applied", NOW), (2, "ready_for_review", NOW), (3, "found", None)]
    assert sorted(map(tuple, sent.collect()), key=repr) == sorted([(1, "manual_portal", "sent", NOW), (1, "auto", "sent", datetime(2024, 1, 1)), (2, "manual_portal", "ready_for_review", None), (None, "manual_portal", "x", None)], key=repr)
    assert sorted(map(tuple, refused.collect())) == [(5, 99, "job not found"), (6, 0, "a positive id is needed"), (7, None, "a positive id is needed")]


def test_reports_show_the_first_lines_and_count_all(spark):
    lines = [(1, i, "error", f"e{i}") for i in range(41)] + [(1, i, "notice", f"n{i}") for i in range(20)] + [(2, 5, "notice", "only")]
    got = {r["run_id"]: r for r in actions.run_log(spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "run_id int, jobs int"), spark.createDataFrame(lines, "run_id int, ord int, kind string, text string").repartition(3)).collect()}
    first = got[1]["report"].split("\n")
    assert (got[1]["n_errors"], got[1]["n_notices"], got[1]["jobs"]) == (41, 20, 7) and first[0] == "errors (41):" and first[40] == "- e39" and first[41] == "- and 1 more" and first[42] == "notices (20):" and first[-1] == "- n19"
    assert got[2]["report"] == "no errors\nnotices (1):\n- only" and (got[3]["n_errors"], got[3]["report"]) == (0, "no errors")


def test_first_admin(spark):
    users = spark.createDataFrame([(3, "admin", True), (1, "admin", False), (2, "member", True), (9, "admin", True)], "id long, role string, active boolean")
    assert [r[0] for r in actions.first_admin(users).collect()] == [3] and actions.first_admin(users.filter("id < 3")).count() == 0


def test_drifted_schemas_come_together(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 2.5)], "id int, tags string, price float")
    new = spark.createDataFrame([(2**40, ["b", "c"], 3.5, "score")], "ID bigint, tags array<string>, price double, stage string")
    for name, table in (("v1", old), ("v2", new)):
        table.write.parquet(f"{tmp_path}/{name}")
    (tmp_path / "_temporary").mkdir()
    stored = schemas.stored_versions(spark, f"file://{tmp_path}")
    steps = {(s.version, s.column): s.action for s in schemas.plan({v: t.schema for v, t in stored.items()})}
    assert steps == {("v1", "id"): "widen", ("v1", "tags"): "wrap", ("v1", "price"): "widen", ("v1", "stage"): "add", ("v2", "id"): "keep", ("v2", "tags"): "keep", ("v2", "price"): "keep", ("v2", "stage"): "keep"}
    rows = schemas.reconciled(stored, ["id"], {"stage": F.lit("done")})
    assert sorted(map(tuple, rows.collect())) == [(1, ["a"], 2.5, "done"), (2**40, ["b", "c"], 3.5, "score")]
    with pytest.raises(ValueError, match="one id"):
        schemas.reconciled(stored | {"v3": old}, ["id"])
    with pytest.raises(ValueError, match="v3.price is string"):
        schemas.reconciled(stored | {"v3": spark.createDataFrame([("x",)], "price string")}, ["id"])


def test_catalog_is_listed(spark):
    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("listed_view")
    got = [tuple(r) for r in schemas.catalog_columns(spark).filter("table_name = 'listed_view'").orderBy("position").collect()]
    assert got == [("listed_view", 0, "a", "int"), ("listed_view", 1, "b", "string")]
    spark.catalog.dropTempView("listed_view")


def test_stored_buckets_meet_without_an_exchange(spark, tmp_path):
    pool = spark.range(500).selectExpr("id", "concat('t', id) as title")
    state = spark.range(900).selectExpr("id % 3 as user_id", "id div 3 * 2 as job_id", "concat('s', id) as status")
    ranking.store_by_id(pool, "pool_test", f"file://{tmp_path}/pool", "id", 4)
    ranking.store_by_id(state, "state_test", f"file://{tmp_path}/state", "job_id", 4)
    got = ranking.stored_with_viewer_state(spark.table("pool_test"), spark.table("state_test"), 1)
    assert sorted(map(tuple, got.select("id", "title", "status").collect()), key=repr) == sorted(map(tuple, ranking.with_viewer_state(pool, state, 1).select("id", "title", "status").collect()), key=repr)
    for viewer in (1, None):
        plan = ranking.stored_with_viewer_state(spark.table("pool_test"), spark.table("state_test"), viewer)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    for t in ("pool_test", "state_test"):
        spark.sql(f"DROP TABLE {t}")


def test_views_go_to_parameters_and_back():
    for params in ({}, {"bucket": "archive", "q": "react", "page": "3"}, {"bucket": "nonsense", "page": "x"}):
        view = ranking.parse_view(params)
        assert ranking.parse_view(ranking.serialize_view(view)) == view
    view = ranking.parse_view({"page": "4", "q": "x"})
    assert ranking.with_view(view, bucket="archive")["page"] == 1 and ranking.with_view(view, query=None)["page"] == 1 and ranking.with_view(view, bucket="inbox")["page"] == 4 and ranking.with_view(view, query="y", page=2)["page"] == 2
    assert ranking.serialize_view(ranking.parse_view({})) == {}


def test_sources_are_read_side_by_side_in_order(spark):
    def slow(n):
        def read():
            time.sleep(1.0)
            if n == 2:
                raise RuntimeError("down")
            return spark.createDataFrame([("p", 0, f"t{n}")], "payload string, pos int, title string")

        return read

    sources = [registry.Source(f"s{i}", "job", None) for i in range(5)]
    began = time.time()
    found = registry.read_sources(spark, sources, {}, lambda n: None, {f"s{i}": slow(i) for i in range(5)})
    assert time.time() - began < 4.5
    assert [r["title"] for r in found.rows.orderBy("ord").collect()] == ["t0", "t1", "t3", "t4"] and found.errors == {"s2": "s2: down"}


def test_marks_are_one_row_a_job_before_they_are_joined(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from millrace.operators import actions

    jobs = spark.createDataFrame([(1, "found"), (2, "found")], "id long, status string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    applications = spark.createDataFrame([(1, "manual_portal", "old"), (3, "manual_portal", "old")], "job_id long, send_mode string, status string").withColumn("sent_at", F.lit(None).cast("timestamp"))
    marks = spark.createDataFrame([(1, 1, None), (2, 1, True), (3, 3, None), (4, None, None)], "ord long, job_id long, undo boolean")
    after, sent, refused = actions.mark_applied(jobs, applications, marks, datetime(2024, 5, 1))
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r["id"], r["status"]) for r in after.collect()) == [(1, "ready_for_review"), (2, "found")]
    assert sorted((r["job_id"], r["status"]) for r in sent.collect()) == [(1, "ready_for_review"), (3, "old")]
    assert sorted((r["ord"], r["reason"]) for r in refused.collect()) == [(3, "job not found"), (4, "a positive id is needed")]
