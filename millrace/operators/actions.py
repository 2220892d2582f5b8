"""What viewers do to rows, and what a run writes about itself."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of each kind that a report shows.
SHOWN = {"error": 40, "notice": 20}


def mark_applied(jobs: DataFrame, applications: DataFrame, marks: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, applications, refused) after viewers marked postings as applied to, or took that back.

    marks: ord, job_id, undo; of several for a job the last counts, and undo counts only if true. Applications made by hand
    (send_mode manual_portal) follow; those that were mailed keep their status and time, as these record what happened.
    refused: (ord, job_id, reason) of marks without a positive id or whose job is not there.
    """
    bad = F.col("job_id").isNull() | (F.col("job_id") <= 0)
    unknown = marks.filter(~bad).join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")
    refused = marks.filter(bad).select("ord", "job_id", F.lit("a positive id is needed").alias("reason")).unionByName(unknown.select("ord", "job_id", F.lit("job not found").alias("reason")))
    # one row a job before any join, so that a job with very many marks is one row there
    marked = marks.filter(~bad).groupBy("job_id").agg(F.max_by(F.coalesce("undo", F.lit(False)), "ord").alias("undone"))
    last = marked.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    done = jobs.join(marked.withColumnRenamed("job_id", "id"), "id", "left")
    new = F.when(F.col("undone"), "ready_for_review").otherwise("applied")
    after = done.withColumns({"status": F.when(F.col("undone").isNotNull(), new).otherwise(F.col("status")), "updated_at": F.when(F.col("undone").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))}).select(*jobs.columns)
    joined = applications.join(last, "job_id", "left")
    moves = F.coalesce((F.col("send_mode") == "manual_portal") & F.col("undone").isNotNull(), F.lit(False))
    status = F.when(moves, F.when(F.col("undone"), "ready_for_review").otherwise("sent")).otherwise(F.col("status"))
    sent = F.when(moves, F.when(~F.col("undone"), F.lit(now))).otherwise(F.col("sent_at"))
    return after, joined.withColumns({"status": status, "sent_at": sent}).select(*applications.columns), refused


def run_log(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """runs with n_errors, n_notices, report: a row for each run to append to the log.

    runs has run_id and counters; lines has run_id, ord, kind (error or notice) and text. A report shows the first lines of
    each kind in their order, as many as SHOWN allows, and says how many more there are; all are counted. Only the shown
    lines of a run meet in one task, since Spark cuts the rest before it shuffles.
    """
    rank = F.row_number().over(Window.partitionBy("run_id", "kind").orderBy("ord"))
    most = max(SHOWN.values())
    first = lines.select("run_id", "kind", "ord", "text", rank.alias("n")).filter(F.col("n") <= most)
    limit = F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv])
    shown = first.filter(F.col("n") <= F.try_element_at(limit, F.col("kind"))).groupBy("run_id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: F.concat(F.lit("- "), s["text"])).alias("shown"))
    counts = lines.groupBy("run_id", "kind").agg(F.count("*").alias("n"))
    both = counts.join(shown, ["run_id", "kind"]).groupBy("run_id").agg(*[F.max(F.when(F.col("kind") == k, F.struct("n", "shown"))).alias(k) for k in SHOWN])

    def part(kind: str, head: str) -> Column:
        n, own = F.col(f"{kind}.n"), F.col(f"{kind}.shown")
        more = F.when(n > F.size(own), F.array(F.concat(F.lit("- and "), (n - F.size(own)).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
        return F.when(n > 0, F.array_join(F.concat(F.array(F.concat(F.lit(f"{head} ("), n.cast("string"), F.lit("):"))), own, more), "\n"))

    text = F.concat_ws("\n", F.coalesce(part("error", "errors"), F.lit("no errors")), part("notice", "notices"))
    joined = runs.join(both, "run_id", "left")
    return joined.select(*runs.columns, *[F.coalesce(f"{k}.n", F.lit(0)).cast("long").alias(f"n_{k}s") for k in SHOWN], text.alias("report"))


def first_admin(users: DataFrame) -> DataFrame:
    """(id) of the first active administrator, or no row."""
    return users.filter((F.col("role") == "admin") & F.col("active")).agg(F.min("id").alias("id")).filter("id is not null")
