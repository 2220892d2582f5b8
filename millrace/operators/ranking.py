"""Per-viewer listing: private state joined to the shared pool, derived piles, read-time scores, a stable page."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicon as L

BUCKETS = ("inbox", "working", "archive")


def effective_date(posted: Column, fetched: Column) -> Column:
    return F.coalesce(posted, fetched)


def is_stale(date: Column, now: datetime, days: int) -> Column:
    """At least so many days of 24 hours old; a row without a date never is."""
    return F.coalesce(date <= F.lit(now - timedelta(days=days)), F.lit(False))


def is_new(fetched: Column, posted: Column, last_seen: datetime | None) -> Column:
    """Came in after the viewer last looked; nothing is new to one who never did."""
    return F.lit(False) if last_seen is None else F.coalesce(F.coalesce(fetched, posted) > F.lit(last_seen), F.lit(False))


def listed_bucket(status: Column, date: Column, now: datetime, days: int) -> Column:
    """The pile whose listing has the row, or null: a status that nobody knows is in no listing. At the cutoff a row is fresh."""
    cutoff = F.lit((now - timedelta(days=days)).replace(microsecond=0))
    untriaged = status.isNull() | (status == "found")
    return (
        F.when(status.isin(L.WORKING_STATUSES), "working").when(status.isin(L.ARCHIVED_STATUSES), "archive")
        .when(untriaged & (date.isNull() | (date >= cutoff)), "inbox").when(untriaged, "archive")
    )


def derived_bucket(status: Column, date: Column, now: datetime, days: int) -> Column:
    """The pile of a row for any status, unknown ones as untriaged; at the cutoff a row is stale."""
    return F.when(status.isin(L.ARCHIVED_STATUSES), "archive").when(status.isin(L.WORKING_STATUSES), "working").when(is_stale(date, now, days), "archive").otherwise("inbox")


def badge_bucket(status: Column, date: Column, now: datetime, days: int) -> Column:
    """The pile that badge counts put a row in: as listed, but without a date it is archived and an unknown status is untriaged."""
    fresh = F.coalesce(date >= F.lit((now - timedelta(days=days)).replace(microsecond=0)), F.lit(False))
    return F.when(status.isin(L.WORKING_STATUSES), "working").when(status.isin(L.ARCHIVED_STATUSES) | ~fresh, "archive").otherwise("inbox")


def archive_reason(status: Column, date: Column, now: datetime, days: int) -> Column:
    stale = is_stale(date, now, days) & ~F.coalesce(status.isin(L.WORKING_STATUSES), F.lit(False))
    return F.when(status.isin(L.ARCHIVED_STATUSES), "dismissed").when(stale, "expired")


def with_viewer_state(pool: DataFrame, state: DataFrame, viewer: int) -> DataFrame:
    """pool and the viewer's status of each row. The viewer's rows are chosen before the outer join, so others' never count.

    One viewer's triage has no fixed bound, so the join carries no broadcast hint; Spark broadcasts it where it is small.
    """
    own = state.filter(F.col("user_id") == viewer).select(F.col("job_id").alias("id"), "status")
    return pool.join(own, "id", "left")


def store_by_id(rows: DataFrame, table: str, folder: str, id_col: str, buckets: int) -> None:
    """rows as a table of the catalog, kept below folder in buckets of the id, each sorted by it, in place of an earlier one.

    Two tables stored so with the same number of buckets are joined on the id without an exchange.
    """
    rows.repartition(buckets, id_col).write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col).option("path", folder).saveAsTable(table)


def stored_with_viewer_state(pool: DataFrame, state: DataFrame, viewer: int | None = None) -> DataFrame:
    """with_viewer_state() over tables of store_by_id(), the state by its job_id; for every viewer that has a state of a row, if none is named.

    The merge hint keeps Spark from gathering either side: a bucket of one meets the same bucket of the other where it lies.
    """
    own = state if viewer is None else state.filter(F.col("user_id") == viewer)
    columns = ["job_id", "status"] + (["user_id"] if viewer is None else [])
    return pool.hint("merge").join(own.select(*columns), F.col("id") == F.col("job_id"), "left").drop("job_id")


def serialize_view(view: dict) -> dict[str, str]:
    """Request parameters of a view; what is as by default is left out."""
    shown = {"bucket": view["bucket"] if view["bucket"] != "inbox" else None, "q": view["query"], "page": str(view["page"]) if view["page"] > 1 else None}
    return {k: v for k, v in shown.items() if v}


def with_view(view: dict, **changes) -> dict:
    """The view after changes; another pile or search begins at the first page unless the change names one."""
    after = view | changes
    moved = any(after[k] != view[k] for k in ("bucket", "query"))
    return after | ({"page": 1} if moved and "page" not in changes else {})


def contains_text(needle: str, *columns: Column) -> Column:
    """Literal search in any of the columns, whatever the case; a blank needle finds all."""
    needle = needle.strip().lower()
    out = F.lit(not needle)
    for c in columns if needle else ():
        out = out | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return out


def page(ranked: DataFrame, order: list[Column], number: int = 1, size: int = 100) -> DataFrame:
    """One page of a total order; past the end it is empty. The rows of all pages up to it are all that meet in one task."""
    return ranked.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def bucket_counts(rows: DataFrame, bucket: Column) -> DataFrame:
    """A row for each pile, with 0 for an empty one."""
    counts = rows.select(*[F.count_if(bucket == b).alias(b) for b in BUCKETS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in BUCKETS])).alias("x")).select("x.*")


def parse_view(params: dict[str, str]) -> dict:
    """A sound view from request parameters: a bad pile is the inbox, a bad page the first."""
    raw = params.get("page", "")
    return {"bucket": params.get("bucket") if params.get("bucket") in BUCKETS else "inbox", "query": (params.get("q") or "").strip() or None, "page": max(1, int(raw)) if raw.isascii() and raw.isdigit() else 1}
