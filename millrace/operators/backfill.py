"""Derived columns of an older version derived again: what changes, a report of it, and a table that is switched over at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import facts, scoring, text
from millrace.operators.merging import join_filled

#: Statuses of rows that nobody has acted on; only these go back to scoring or fetching.
UNTOUCHED = ["rejected", "found"]


def backfilled(rows: DataFrame, version: int, profile: scoring.Profile, now: datetime) -> DataFrame:
    """All rows after the backfill, and changed: whether a row was of an older version, or of none.

    A title that holds a whole card is taken apart first, which may give a place. Facts come from place, tags, flag and
    text; what they do not state becomes null, so nothing stale stays. The row is scored again, and one that nobody has
    acted on goes back to scoring. Rows of the version or a later one, and columns that are not derived, stay.
    """
    old = F.col("facts_version").isNull() | (F.col("facts_version") < version)
    card = text.repair_card(F.col("title"))
    whole = (F.col("source") == "linkedin_alert") & F.coalesce(F.col("title").contains(" · "), F.lit(False))
    own = rows.withColumn("changed", old).withColumn("__whole", old & whole)
    own = own.withColumn("__card", F.when(F.col("__whole"), card))
    own = own.withColumns({"title": F.coalesce("__card.title", "title"), "location": F.coalesce("__card.location", "location"), "easy_apply": F.coalesce("__card.easy_apply", "easy_apply")})
    how = facts.arrangement(F.col("location"), F.col("tags"), F.col("remote"))
    place, years = facts.geo(F.col("location")), facts.experience(F.concat_ws("\n", "title", "description"))
    derived = own.withColumn("__f", F.when(old, F.struct(facts.row_arrangement(how).alias("how"), place.alias("place"), years.alias("years"))))
    kept = lambda c, new: F.when(old, new).otherwise(F.col(c))
    after = derived.withColumns({
        "arrangement": kept("arrangement", F.col("__f.how.arrangement")), "remote": kept("remote", F.col("__f.how.remote")), "geo_eligibility": kept("geo_eligibility", F.col("__f.place.eligibility")),
        "geo_regions": kept("geo_regions", F.col("__f.place.regions")), "min_years": kept("min_years", F.col("__f.years.min_years")), "max_years": kept("max_years", F.col("__f.years.max_years")),
        "experience_text": kept("experience_text", F.col("__f.years.experience_text")), "sparse": kept("sparse", F.coalesce(F.col("description"), F.lit("")) == ""),
    })
    judged = after.withColumn("__s", F.when(old, scoring.score_job({c: F.col(c) for c in after.columns}, profile, now)))
    again = old & F.coalesce(F.col("status").isin(UNTOUCHED), F.lit(False))
    done = judged.withColumns({
        "score": kept("score", F.col("__s.score")), "score_reasons": kept("score_reasons", F.col("__s.reasons")), "status": F.when(again, "found").otherwise(F.col("status")),
        "stage": F.when(again, "score").otherwise(F.col("stage")), "attempts": F.when(again, 0).otherwise(F.col("attempts")), "facts_version": F.when(old, version).otherwise(F.col("facts_version")),
    })
    return done.select(*rows.columns, "changed")


def histogram(before: DataFrame, after: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(fact, value, before, after): how many changed rows had and have each value; null is a value, written null.

    after has changed, as backfilled() gives it. One join on the id and one aggregate, whatever the number of facts.
    """
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    old = before.select(id_col, F.struct(*columns).alias("__old"))
    pairs = after.filter("changed").select(id_col, F.struct(*columns).alias("__new")).join(old, id_col)
    facts_of = F.array(*[F.struct(F.lit(c).alias("fact"), text_of(F.col(f"{side}.{c}")).alias("value"), F.lit(side == "__new").alias("new")) for c in columns for side in ("__old", "__new")])
    each = pairs.select(F.explode(facts_of).alias("f")).select("f.*")
    return each.groupBy("fact", "value").agg(F.count_if(~F.col("new")).alias("before"), F.count_if("new").alias("after"))


def requeued(rows: DataFrame, cache: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """All rows after alert cards without a company went back to fetching, and requeued: whether a row did.

    Only untouched rows whose address has a page number that the cache lacks go, so a second run changes nothing.
    """
    wanted = (F.col("source") == "linkedin_alert") & (F.col("company") == unknown) & F.col("status").isin(UNTOUCHED)
    keyed = rows.withColumn("__page", F.when(wanted, text.job_page_id(F.col("url"))))
    known = cache.select(F.col("job_id").cast("string").alias("__page"), F.lit(True).alias("__known")).distinct()
    goes = F.col("__page").isNotNull() & F.col("__known").isNull()
    marked = join_filled(keyed, known, "__page").withColumn("requeued", goes)
    to = {"stage": F.lit("enrich"), "attempts": F.lit(0), "last_error": F.lit(None), "next_attempt_at": F.lit(None)}
    return marked.withColumns({c: F.when(F.col("requeued"), v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in to.items()}).select(*rows.columns, "requeued")


class Versions:
    """A table kept as numbered folders, and markers that say which are whole; the greatest marked one is the table.

    A version is written aside and then marked by an empty file that is created at once or not at all. A writer that
    dies before leaves the earlier version as it was, and its number is written over by the next.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/whole")
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def read(self, number: int | None = None) -> DataFrame:
        """The table, or an earlier version of it."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            raise ValueError(f"{self.folder} has no whole version{'' if number is None else f' {number}'}")
        return self.spark.read.parquet(f"{self.folder}/v={known[-1] if number is None else number}")

    def stage(self, table: DataFrame) -> int:
        """Writes the next version without switching over to it."""
        number = (self.numbers() or [0])[-1] + 1
        table.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        return number

    def switch(self, number: int) -> None:
        """Makes a staged version the table. Two writers of one number: the second gets an error."""
        self._files.create(self._path(f"{self.folder}/whole/{number}"), False).close()


def run(versions: Versions, version: int, profile: scoring.Profile, now: datetime, columns: list[str], write: bool = False) -> DataFrame:
    """The report of a backfill of the stored table; only with write is the table changed too, by staging and switching."""
    before = versions.read()
    after = backfilled(before, version, profile, now)
    if write:
        number = versions.stage(after.drop("changed"))
        versions.switch(number)
        after = versions.read(number).join(before.select("id", (F.col("facts_version").isNull() | (F.col("facts_version") < version)).alias("changed")), "id")
    return histogram(before, after, columns)
