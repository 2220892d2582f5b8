"""A settings document whose every key falls back by itself, and the rules over several keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """kind: boolean, long or string; low and high bound a number, or the length of a text from below."""

    name: str
    kind: str
    default: bool | int | str
    low: int | None = None
    high: int | None = None


# Keys, defaults and bounds.
SETTINGS = [
    Setting("DRY_RUN", "boolean", False), Setting("MATCH_THRESHOLD", "long", 40, 0, 100), Setting("JOB_STALE_DAYS", "long", 30, 1, 365), Setting("ENABLE_LINKEDIN_ALERTS", "boolean", False),
    Setting("ENABLE_WELLFOUND_ALERTS", "boolean", False), Setting("ENABLE_INDEED_ALERTS", "boolean", False), Setting("LINKEDIN_ALERT_DAYS", "long", 3, 1, 30), Setting("ENABLE_LINKEDIN_ENRICH", "boolean", True),
    Setting("LINKEDIN_ENRICH_DAILY_CAP", "long", 80, 0, 500), Setting("LINKEDIN_ENRICH_DELAY_MS", "long", 1500, 0, 60_000), Setting("ENABLE_FOLLOWUPS", "boolean", True), Setting("FOLLOWUP_FIRST_DAYS", "long", 4, 1, 60),
    Setting("FOLLOWUP_FINAL_DAYS", "long", 10, 2, 120), Setting("FOLLOWUP_DAILY_CAP", "long", 20, 0, 200), Setting("WORKER_TIME_BUDGET_MS", "long", 45_000, 1_000, 50_000), Setting("WORKER_BATCH_SIZE", "long", 25, 1, 500),
    Setting("OUTREACH_DAILY_CAP", "long", 10, 0, 200), Setting("IMAP_HOST", "string", "imap.gmail.com", 1), Setting("IMAP_PORT", "long", 993, 1, 65_535), Setting("IMAP_MAILBOX", "string", "INBOX", 1),
]


def _value(document: Column, s: Setting) -> Column:
    """The key's own value if it is of the kind and within the bounds; a number in quotes or with a fraction is not."""
    at = F.try_variant_get(document, f"$.{s.name}", "variant")
    kind = F.regexp_extract(F.schema_of_variant(at), "^([A-Z]+)", 1)
    if s.kind == "boolean":
        return F.when(kind == "BOOLEAN", F.try_variant_get(at, "$", "boolean"))
    if s.kind == "string":
        own = F.when(kind == "STRING", F.try_variant_get(at, "$", "string"))
        return F.when(F.length(own) >= (s.low or 0), own)
    number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(at, "$", "double"))
    return F.when((number == F.floor(number)) & number.between(s.low, s.high), number.cast("long"))


def parse_settings(text: Column, settings: list[Setting] = SETTINGS) -> Column:
    """A struct of all settings of a JSON text. A bad value of a key, or a missing one, is its default and leaves the others; what is no JSON object has all defaults."""
    document = F.try_parse_json(text)
    return F.struct(*[F.coalesce(_value(document, s), F.lit(s.default)).alias(s.name) for s in settings])


def problems(parsed: Column) -> Column:
    """What is wrong between keys; settings are written only if this is empty, and read whatever it is."""
    first, final = parsed["FOLLOWUP_FIRST_DAYS"], parsed["FOLLOWUP_FINAL_DAYS"]
    text = F.concat(F.lit("the final follow-up (day "), final.cast("string"), F.lit(") has to come after the first (day "), first.cast("string"), F.lit(")"))
    return F.array_compact(F.array(F.when(final <= first, text)))


def dry_run(parsed: Column, forced: bool = False) -> Column:
    """Whether nothing is sent: the deployment can force it on and never off."""
    return F.lit(forced) | parsed["DRY_RUN"]
