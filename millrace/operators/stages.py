"""The stage machine over snapshots: claim, advance, back off, cap, follow up, report."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import lexicon as L

#: Seconds of the first delay and of the longest.
FIRST_DELAY, LONGEST_DELAY = 60, 6 * 3600


def claimable(stage: str, now: datetime, closed: list[str] = L.TERMINAL_JOB_STATUSES) -> Column:
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now))
    return (F.col("stage") == stage) & due & ~F.col("status").isin(closed)


def claim(rows: DataFrame, stage: str, now: datetime, limit: int | None = 25, closed: list[str] = L.TERMINAL_JOB_STATUSES) -> DataFrame:
    """The first rows by id that the stage may work on; all of them without a limit."""
    due = rows.filter(claimable(stage, now, closed))
    return due if limit is None else due.orderBy("id").limit(limit)


def delay_seconds(attempts: Column, seed: Column) -> Column:
    """Doubling from a minute to six hours, and up to 16 seconds by the row's id."""
    steps = F.greatest(F.lit(0), attempts - 1)
    base = F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(2.0), F.least(steps, F.lit(30))), F.lit(float(LONGEST_DELAY))).cast("long")
    return base + F.pmod(seed, F.lit(17))


def failed(rows: DataFrame, error: Column, now: datetime) -> DataFrame:
    """Rows after a failure: one attempt more, and a later time or, at the last attempt, the end."""
    tries = F.col("attempts") + 1
    over = tries >= L.MAX_ATTEMPTS
    due = F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) + delay_seconds(tries, F.col("id")))
    return rows.withColumns({"next_attempt_at": F.when(~over, due), "stage": F.when(over, "done").otherwise(F.col("stage")), "last_error": F.substring(error, 1, 500), "attempts": tries})


def advanced(rows: DataFrame, next_stage: dict[str, str] = L.NEXT_JOB_STAGE) -> DataFrame:
    """Rows after success: the next stage, no attempts, no error. A stage that nobody knows stays."""
    table = F.create_map(*[F.lit(x) for pair in next_stage.items() for x in pair])
    return rows.withColumns({"stage": F.coalesce(F.try_element_at(table, F.col("stage")), "stage"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "next_attempt_at": F.lit(None).cast("timestamp")})


def within_cap(rows: DataFrame, by: list[str], order: list[Column], eligible: Column, used: Column, cap: int) -> DataFrame:
    """allowed: whether an eligible row is among the first that the cap leaves in its group. Give the group a date, so windows stay small."""
    running = F.sum(eligible.cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("allowed", eligible & (running <= F.greatest(F.lit(0), F.lit(cap) - used)))


#: Groups of more than a thousandth of all rows, and of more than so many, are cut into stretches of the order.
STRETCH_ROWS, STRETCHES = 1_000_000, 256


def within_cap_spread(rows: DataFrame, by: list[str], order: str, tie: str, eligible: Column, used: Column, cap: int, stretch: int = STRETCH_ROWS) -> DataFrame:
    """within_cap() for groups of any size, and for all rows as one group where by is empty; rows come in the order of a number, then of tie.

    A large group is cut into STRETCHES stretches at its quantiles. Eligible rows are added up over stretches, of which a
    group has a few hundred, and then inside each, so no task orders a whole group. Only the quantiles of large groups,
    fewer than a thousand, are broadcast. Rows of one order value are in one stretch, so order should tell most apart.
    A null order comes first, as in within_cap().
    """
    keys = by or ["__all"]
    base = rows if by else rows.withColumn("__all", F.lit(0))
    cuts = [i / STRETCHES for i in range(1, STRETCHES)]
    sizes = base.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx(F.col(order).cast("double"), cuts, 10_000).alias("__cuts"))
    total = base.count()
    large = F.broadcast(sizes.filter(F.col("__n") > max(stretch, total // 1000)).select(*keys, "__cuts"))
    known = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    cut = base.join(large.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__cuts"), reduce(lambda a, b: a & b, known), "left").drop(*[f"__k_{k}" for k in keys])
    dealt = cut.withColumn("__s", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order).cast("double"))), F.lit(0))).withColumn("__s", F.when(F.col(order).isNull() | (F.col("__s") < 0), 0).otherwise(F.col("__s"))).drop("__cuts")
    dealt = dealt.withColumn("__e", F.coalesce(eligible, F.lit(False)).cast("long"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*keys, "__s").agg(F.sum("__e").alias("__sum")).withColumn("__before", before).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__s").alias("__k_s"), "__before")
    on = reduce(lambda a, b: a & b, known) & (F.col("__s") == F.col("__k_s"))
    running = F.col("__before") + F.sum("__e").over(Window.partitionBy(*keys, "__s").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.join(sums, on).withColumn("__run", running).withColumn("allowed", (F.col("__e") == 1) & (F.col("__run") <= F.greatest(F.lit(0), F.lit(cap) - used)))
    return out.select(*rows.columns, "allowed")


def enrich_outcome(http_status: Column, description: Column) -> Column:
    """ok, not_found, blocked or error of a fetched page; a page that was never fetched is an error."""
    has_text = F.trim(F.coalesce(description, F.lit(""))) != ""
    return F.when(http_status.isin(404, 410), "not_found").when(http_status.isin(403, 429), "blocked").when(http_status.between(200, 299), F.when(has_text, "ok").otherwise("not_found")).otherwise("error")


def score_stage(score: Column, threshold: int = 40) -> Column:
    """struct(status, stage) after scoring."""
    good = score >= threshold
    return F.struct(F.when(good, "matched").otherwise("rejected").alias("status"), F.when(good, "draft").otherwise("done").alias("stage"))


def dispatch(kind: str, email: Column, has_resume: Column, has_sender: Column, allowed: Column, dry_run: bool) -> Column:
    """send, wait or queue for a person. Leads with an address that the cap leaves out wait."""
    email = F.coalesce(email, F.lit("")) != ""
    live = F.lit(not dry_run) & has_sender
    if kind == "job":
        return F.when(email & has_resume & live, "send").otherwise("queue")
    return F.when(email & allowed & live, "send").when(email & ~allowed, "wait").otherwise("queue")


def next_follow_up(count: Column, sent: Column, first_days: int = 4, final_days: int = 10) -> Column:
    """When the next follow-up is due, always from the first message; null after two."""
    days = F.when(count == 0, first_days).when(count < 2, final_days)
    return sent + F.make_dt_interval(days)


def due_follow_ups(rows: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """Sent rows without an answer whose follow-up is due, by id, with the step and whole days since sending."""
    due = rows.filter(F.col("sent_at").isNotNull() & F.col("responded_at").isNull() & (F.col("next_follow_up_at") <= F.lit(now)) & (F.col("follow_up_count") < 2))
    days = (F.lit(now).cast("timestamp").cast("long") - F.col("sent_at").cast("timestamp").cast("long")) / 86400
    out = due.withColumns({"step": F.when(F.col("follow_up_count") == 0, 1).otherwise(2), "days_since": F.greatest(F.lit(0), F.floor(days + 0.5)).cast("int")})
    return out if limit is None else out.orderBy("id").limit(limit)


def invite_state(expires: Column, accepted: Column, revoked: Column, now: datetime) -> Column:
    return F.when(accepted.isNotNull(), "accepted").when(revoked.isNotNull(), "revoked").when(expires <= F.lit(now), "expired").otherwise("valid")


def parse_role(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)) == "admin", "admin").otherwise("user")


def fact_chips(arrangement: Column, eligibility: Column, regions: Column, low: Column, high: Column, easy: Column) -> Column:
    """Labels for what is known, in order."""
    years = F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" yrs"))).when(low.isNotNull(), F.concat(low.cast("string"), F.lit("+ yrs")))
    place = F.when(eligibility == "worldwide", "Worldwide").when(eligibility == "eligible", "Open to you").when(eligibility == "restricted", F.concat_ws(" ", F.lit("Restricted"), F.nullif(F.upper(F.array_join(regions, "/")), F.lit(""))))
    return F.array_compact(F.array(F.when(arrangement != "unknown", F.initcap(arrangement)), place, years, F.when(easy, "Easy apply")))


def backfill(rows: DataFrame, version: int) -> DataFrame:
    """Rows whose derived columns are of an older version or none."""
    return rows.filter(F.col("facts_version").isNull() | (F.col("facts_version") < version))


def digest(events: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """One row of counts by kind and their line of text."""
    counts = events.agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])
    return counts.withColumn("summary", F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in kinds]))


def follow_up(kind: str, step: Column, title: Column, company: Column, subject: Column, days: Column, sender: str) -> Column:
    """struct(subject, text) of a follow-up in the sender's name."""
    from millrace.functions.text import days_ago, thread_subject

    ago = days_ago(days)
    at = F.when(F.coalesce(F.trim(company), F.lit("")) != "", F.trim(company))
    if kind == "application":
        what = F.concat(F.lit("the "), F.trim(title), F.lit(" role"), F.coalesce(F.concat(F.lit(" at "), at), F.lit("")))
        fallback = F.concat(F.lit("Application - "), F.trim(title), F.coalesce(F.concat(F.lit(" ("), at, F.lit(")")), F.lit("")))
    else:
        what = F.concat(F.lit('your "'), F.trim(title), F.lit('" post'), F.coalesce(F.concat(F.lit(" ("), at, F.lit(")")), F.lit("")))
        fallback = F.concat(F.trim(title), F.coalesce(F.concat(F.lit(" ("), at, F.lit(")")), F.lit("")))
    when = F.coalesce(F.concat(F.lit(", sent "), ago), F.lit(""))
    first = F.concat(F.lit("Hi,\n\nThis is about my message on "), what, when, F.lit(". I would still like to hear from you.\n\nThanks,\n"))
    last = F.concat(F.lit("Hi,\n\nA last note on "), what, when, F.lit(". No answer is needed if it is closed.\n\nThanks,\n"))
    return F.struct(thread_subject(subject, fallback).alias("subject"), F.concat(F.when(step == 1, first).otherwise(last), F.lit(sender)).alias("text"))
