"""One run of the stage machine as a chain of set-based passes: enrich, score, draft, dispatch.

A pass changes the rows that its stage may claim and leaves the others as they are. What a run would fetch or send is
returned as tables, so a run has no effects of its own and can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import facts, scoring
from millrace.functions.text import haystack, job_page_id
from millrace.operators import drafting, stages
from millrace.operators.merging import join_filled


@dataclass
class Run:
    """rows: the table after the run; drafts: (id, letter, decision) of those that reached dispatch; decision is send or queue."""

    rows: DataFrame
    drafts: DataFrame


def _settle(rows: DataFrame, claimed: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows with the changes where claimed; a worked row has no attempts, error or wait left."""
    clean = {"attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "next_attempt_at": F.lit(None).cast("timestamp")}
    return rows.withColumns({c: F.when(claimed, v).otherwise(F.col(c)) for c, v in (changes | clean).items()})


def enrich(rows: DataFrame, cache: DataFrame, fetched: DataFrame, remaining: int, now: datetime) -> DataFrame:
    """Rows of the stage with the description of their page, from the cache or, for the first remaining ones by id, freshly fetched.

    cache and fetched have one row a job_id at most, with outcome, description, company. Rows without a page go on as
    they are, and so do those whose page gives nothing; rows beyond the cap stay. A company is only set where it is
    Unknown. With a description, experience is derived again.
    """
    claimed = rows.withColumns({"__due": stages.claimable("enrich", now), "__page": job_page_id(F.col("url"))})
    known = cache.select(F.col("job_id").alias("__page"), F.struct("outcome", "description", "company").alias("__known"))
    joined = join_filled(claimed, known, "__page")
    asks = joined.filter(F.col("__due") & F.col("__page").isNotNull() & F.col("__known").isNull()).select("id", "__page").orderBy("id").limit(max(0, remaining))
    fresh = asks.join(fetched.select(F.col("job_id").alias("__page"), F.struct("outcome", "description", "company").alias("__fresh")), "__page", "left").select("id", "__fresh", F.lit(True).alias("__asked"))
    both = joined.join(fresh, "id", "left")
    page = F.coalesce("__known", "__fresh")
    text = F.when(page["outcome"] == "ok", F.nullif(page["description"], F.lit("")))
    worked = F.col("__due") & (F.col("__page").isNull() | F.col("__known").isNotNull() | F.coalesce("__asked", F.lit(False)))
    years = facts.experience(F.concat_ws("\n", "title", text))
    gained = text.isNotNull()
    changes = {
        "description": F.coalesce(text, "description"), "company": F.when((F.col("company") == "Unknown") & F.coalesce(page["company"] != "", F.lit(False)), page["company"]).otherwise(F.col("company")), "stage": F.lit("score"),
        "min_years": F.when(gained, years["min_years"]).otherwise(F.col("min_years")), "max_years": F.when(gained, years["max_years"]).otherwise(F.col("max_years")),
    }
    # every change reads the row as it was
    return _settle(both, worked, changes).select(*rows.columns)


def score(rows: DataFrame, profile: scoring.Profile, threshold: int, now: datetime) -> DataFrame:
    sparse = F.coalesce("description", F.lit("")) == ""
    own = scoring.score_job({c: F.col(c) for c in rows.columns} | {"sparse": sparse}, profile, now)["score"]
    # from an array of one: filters on what follows from the score stay above it, so it is worked out once a row
    due = rows.withColumn("__due", stages.claimable("score", now))
    claimed = due.withColumn("__score", F.explode(F.array(F.when(F.col("__due"), own))))
    after = stages.score_stage(F.col("__score"), threshold)
    return _settle(claimed, F.col("__due"), {"score": F.col("__score"), "status": after["status"], "stage": after["stage"]}).select(*rows.columns)


def run_once(rows: DataFrame, cache: DataFrame, fetched: DataFrame, profile: scoring.Profile, sender: drafting.Sender | None, now: datetime, threshold: int = 40, fetch_cap: int = 80, has_resume: bool = True, dry_run: bool = False) -> Run:
    """All stages one after the other; a row may pass several. Rows that reach dispatch are sent or queued and done."""
    scored = score(enrich(rows, cache, fetched, fetch_cap, now), profile, threshold, now)
    drafted = _settle(scored, stages.claimable("draft", now), {"stage": F.lit("dispatch")})
    ready = stages.claimable("dispatch", now)
    decision = stages.dispatch("job", F.col("apply_email"), F.lit(has_resume), F.lit(sender is not None), F.lit(True), dry_run)
    skills = facts.emphasized_skills(haystack(F.col("title"), F.col("company"), F.col("description")))
    letter = drafting.cover_letter(F.col("title"), F.col("company"), skills, sender) if sender else F.lit(None).cast("string")
    drafts = drafted.filter(ready).select("id", letter.alias("letter"), decision.alias("decision"))
    done = _settle(drafted, ready, {"status": F.when(decision == "send", "sent").otherwise("ready_for_review"), "stage": F.lit("done")})
    return Run(done, drafts)
