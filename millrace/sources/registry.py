"""The ordered catalogue of sources, and reading all that are on into one table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import feeds


@dataclass(frozen=True)
class Source:
    """read gives the source's rows; needs are the settings without which it is off; retired is why it can't be read any more."""

    name: str
    kind: str
    read: Callable[[DataFrame], DataFrame] | None
    needs: tuple[str, ...] = ()
    retired: str | None = None


# The order of sources decides which posting of a group comes first.
JOB_SOURCES = [
    Source("remoteok", "job", feeds.remoteok), Source("remotive", "job", feeds.remotive), Source("arbeitnow", "job", feeds.arbeitnow), Source("wwr", "job", feeds.wwr), Source("himalayas", "job", feeds.himalayas),
    Source("jobicy", "job", feeds.jobicy), Source("adzuna", "job", feeds.adzuna, ("adzuna_id", "adzuna_key")), Source("linkedin_alert", "job", None, ("linkedin_alerts",)), Source("wellfound_alert", "job", None, ("wellfound_alerts",)),
    Source("indeed_alert", "job", None, ("indeed_alerts",)), Source("ycombinator", "job", feeds.ycombinator),
]
LEAD_SOURCES = [Source("arbeitnow_contract", "lead", feeds.arbeitnow_contract), Source("wwr_contract", "lead", feeds.wwr_contract), Source("upwork_rss", "lead", None, retired="the feed is gone")]


@dataclass
class Reading:
    """rows of all sources that could be read; by source name why others were not."""

    rows: DataFrame
    errors: dict[str, str] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    retired: dict[str, str] = field(default_factory=dict)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All rows one after another; ord is a struct that orders them by source, payload and position."""
    tagged = [p.withColumn("ord", F.struct(F.lit(i).alias("source_ord"), F.col("payload"), F.col("pos"))).drop("payload", "pos") for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_sources(spark: SparkSession, sources: list[Source], settings: dict, payloads: Callable[[str], DataFrame], readers: dict[str, Callable[[], DataFrame]] | None = None, folder: str | None = None, at_once: int = 8) -> Reading:
    """Every source that is on, in the catalogue's order. A source that fails is an error of its own and stops no other.

    payloads gives the payloads of a source by name; readers gives the rows of sources that are not feeds. With a
    folder, each source is written below it, replacing what is there, and read again, so a failure while its rows are
    made is its own error too; without one, rows are made when they are used, and such a failure stops the whole union.
    """
    out, readers, wanted = Reading(None), readers or {}, []
    schema = feeds.LEAD if sources and sources[0].kind == "lead" else feeds.POSTING
    for s in sources:
        missing = [n for n in s.needs if not settings.get(n)]
        if s.retired:
            out.retired[s.name] = s.retired
        elif missing:
            out.skipped[s.name] = f"set {' and '.join(missing)}"
        else:
            wanted.append(s)

    def read(s: Source) -> DataFrame | Exception:
        try:
            rows = readers[s.name]() if s.read is None else s.read(payloads(s.name))
            if folder is not None:
                rows.write.mode("overwrite").parquet(f"{folder}/{s.name}")
                rows = spark.read.schema(rows.schema).parquet(f"{folder}/{s.name}")
            return rows
        except Exception as e:  # noqa: BLE001
            return e

    # sources are read side by side, so that a slow one keeps no other waiting
    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(read), wanted))
    parts = [r for r in results if not isinstance(r, Exception)]
    out.errors = {s.name: f"{s.name}: {r}" for s, r in zip(wanted, results, strict=True) if isinstance(r, Exception)}
    empty = spark.createDataFrame([], "payload string, pos int, " + ", ".join(f"{c} {t}" for c, t in schema.items()))
    out.rows = union_sources(parts or [empty])
    return out
