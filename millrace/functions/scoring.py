"""Scores of postings and leads, compiled from a profile into one expression over the columns of a row."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions.text import contains_adjacent, contains_in_order, haystack, let, names_any, title_clauses

#: Parts of a score.
FULL_CREDIT, ROLE_BONUS, INTERN_PENALTY = 0.35, 8, 15
RESTRICTED, ELIGIBLE, OVER_YEARS, IN_RANGE, ACCEPTED, NOT_ACCEPTED, TOLERANCE = -25, 10, -20, 6, 5, -8, 2
KEYWORD_POINTS, BUDGET_POINTS = 10, 5


@dataclass(frozen=True)
class Profile:
    """What a viewer looks for. skills: (name, weight, other names)."""

    skills: list[tuple[str, float, list[str]]] = field(default_factory=lambda: L.DEFAULT_SKILLS)
    target_roles: list[str] = field(default_factory=lambda: L.TARGET_ROLES)
    veto_phrases: list[str] = field(default_factory=lambda: L.VETO_PHRASES)
    career_start: datetime | None = None
    accepted: list[str] = field(default_factory=lambda: ["remote"])

    def years(self, now: datetime) -> float | None:
        """Years of 365.25 days since the career began, at least 0."""
        return None if self.career_start is None else max(0.0, (now - self.career_start).total_seconds() / (365.25 * 86400))


def build_profile(raw: dict | None) -> Profile:
    """A sound profile from any mapping: malformed entries go, weights are held in 0 to 10, a missing list is the default, an empty one stays."""
    raw = raw if isinstance(raw, dict) else {}

    def strings(key: str, default: list[str]) -> list[str]:
        value = raw.get(key)
        return [x.strip().lower() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else default

    skills = L.DEFAULT_SKILLS
    if isinstance(raw.get("skills"), list):
        skills = []
        for s in raw["skills"]:
            if isinstance(s, dict) and isinstance(s.get("name"), str) and s["name"].strip():
                w = s.get("weight", 1)
                w = float(w) if isinstance(w, int | float) and not isinstance(w, bool) and w == w else 1.0
                names = s.get("aliases") if isinstance(s.get("aliases"), list) else []
                skills.append((s["name"].strip().lower(), min(10.0, max(0.0, w)), [a.strip().lower() for a in names if isinstance(a, str) and a.strip()]))
    start = raw.get("career_start")
    return Profile(skills, strings("target_roles", L.TARGET_ROLES), strings("veto_phrases", L.VETO_PHRASES), start if isinstance(start, datetime) else None, strings("accepted", ["remote"]))


def _title_tokens(text: str) -> list[str]:
    import re

    return [t for t in (x.rstrip(".") for x in re.split("[^a-z0-9.+#]+", text.lower())) if t]


def role_match(title: Column, roles: list[str]) -> Column:
    """Whether some clause of the title has the words of some role in order; developers are engineers."""
    clauses = F.transform(title_clauses(title), lambda c: F.transform(c, lambda t: F.when(t == "developer", "engineer").otherwise(t)))
    needed = [[("engineer" if t == "developer" else t) for t in _title_tokens(r)] for r in roles]
    return F.exists(clauses, lambda c: _any([contains_in_order(c, n) for n in needed if n]))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def veto(title: Column, phrases: list[str]) -> Column:
    """The first veto phrase that stands in one clause of the title, or null."""
    clauses = title_clauses(title)

    def stands(tokens: list[str]) -> Column:
        return F.exists(clauses, lambda c: contains_adjacent(c, tokens))

    return F.coalesce(*[F.when(stands(_title_tokens(p)), p) for p in phrases if _title_tokens(p)], F.lit(None).cast("string"))


def fit(row: dict[str, Column], years: float | None, accepted: list[str]) -> tuple[Column, Column]:
    """(delta, reasons) of eligibility, experience and arrangement; row has geo_eligibility, geo_regions, min_years, max_years, arrangement."""
    geo, low, high, how = row["geo_eligibility"], row["min_years"], row["max_years"], row["arrangement"]
    regions = F.coalesce(F.array_join(row["geo_regions"], ", "), F.lit(""))
    places = F.when(regions != "", F.concat(F.lit(" (hiring in: "), regions, F.lit(")"))).otherwise("")
    delta = F.when(geo == "restricted", RESTRICTED).when(geo.isin("worldwide", "eligible"), ELIGIBLE).otherwise(0)
    geo_reason = (
        F.when(geo == "restricted", F.concat(F.lit("not open to your location"), places)).when(geo == "worldwide", "open worldwide - no location restriction")
        .when(geo == "eligible", "open to your location").otherwise("location eligibility not stated by this source")
    )
    if years is None:
        years_reason = F.when(low.isNotNull(), F.concat(F.lit("asks for "), low.cast("string"), F.lit("+ years - add your career start date to your profile so this can be judged")))
    else:
        over, inside = low > years + TOLERANCE, high.isNotNull() & (low <= years) & (years <= high)
        delta = delta + F.when(over, OVER_YEARS).when(inside, IN_RANGE).otherwise(0)
        years_reason = F.when(over, F.concat(F.lit("wants "), low.cast("string"), F.lit(f"+ years, you have ~{years:.1f} - likely filtered out"))).when(inside, F.concat(F.lit("asks for "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years - you are in range")))
    stated = how.isNotNull() & (how != "unknown")
    fine = how.isin(accepted or ["remote"])
    delta = delta + F.when(~stated, 0).when(fine, ACCEPTED).otherwise(NOT_ACCEPTED)
    how_reason = F.when(~stated, "work arrangement not stated by this source").when(fine, how).when(how == "hybrid", "hybrid - requires office presence").otherwise("on-site - requires office presence")
    return delta, F.array_compact(F.array(geo_reason, years_reason, how_reason))


def matched_skills(text: Column, skills: list[tuple[str, float, list[str]]]) -> Column:
    """array of struct(name, weight) of the skills that lower-case text names as whole tokens, in the profile's order."""
    def hits(t: Column) -> Column:
        return F.array_compact(F.array(*[F.when(names_any(t, [name, *names]), F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"))) for name, weight, names in skills]))

    return let(text, hits)


def score_job(row: dict[str, Column], profile: Profile, now: datetime) -> Column:
    """struct(score, reasons) of a posting.

    row has title, company, description, tags, sparse and what fit() needs. A vetoed title scores 0 with the veto first.
    """
    text = haystack(row["title"], row["company"], row["description"], F.array_join(row["tags"], " \n "))
    intern = F.coalesce(F.lower(row["title"]).rlike("(?<![a-z0-9_])(?:intern|internship)(?![a-z0-9_])"), F.lit(False))
    full = max(sum(w for _, w, _ in profile.skills) * FULL_CREDIT, 1.0)
    delta, fit_reasons = fit(row, profile.years(now), profile.accepted)
    sparse = F.when(F.coalesce(row["sparse"], F.lit(False)), "scored on title only - no job description could be recovered for this job")

    def judged(seen: Column) -> Column:
        """seen: a flag for each skill, the phrase that vetoes the title, whether the title is a role sought and an internship."""
        tests, vetoed, is_role, intern = [F.get(seen["skills"], F.lit(i)) for i in range(len(profile.skills))], seen["vetoed"], seen["is_role"], seen["intern"]
        raw = sum((F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0)) for test, (_, weight, _) in zip(tests, profile.skills, strict=True)), F.lit(0.0))
        raw = raw + F.when(is_role, ROLE_BONUS).otherwise(0) - F.when(intern, INTERN_PENALTY).otherwise(0)
        normal = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(raw / F.lit(full) * 100 + 0.5).cast("double")))
        own = [F.when(test, f"matches skill: {name}") for test, (name, _, _) in zip(tests, profile.skills, strict=True)]
        own += [F.when(is_role, "title matches a targeted role"), F.when(intern, "looks like an internship - deprioritized")]
        veto_reason = F.concat(F.lit('title is a non-engineering role ("'), vetoed, F.lit('") - excluded regardless of the skills below'))
        reasons = F.array_compact(F.array(veto_reason, sparse, *own))
        score = F.when(vetoed.isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), (normal + delta).cast("int"))))
        return F.struct(score.cast("int").alias("score"), F.when(vetoed.isNotNull(), reasons).otherwise(F.concat(reasons, fit_reasons)).alias("reasons"))

    flags = let(text, lambda t: F.array(*[names_any(t, [name, *names]) for name, _, names in profile.skills]))
    role = let(veto(row["title"], profile.veto_phrases), lambda v: F.struct(v.alias("vetoed"), (v.isNull() & role_match(row["title"], profile.target_roles)).alias("is_role")))
    return let(let(role, lambda r: F.struct(flags.alias("skills"), r["vetoed"].alias("vetoed"), r["is_role"].alias("is_role"), intern.alias("intern"))), judged)


def score_lead(title: Column, client: Column, description: Column, budget: Column) -> Column:
    """struct(score, reasons) of a lead: points for each keyword inside the text and for a budget."""
    has_budget = F.coalesce(budget != "", F.lit(False))
    found = let(haystack(title, client, description), lambda text: F.array_compact(F.array(*[F.when(text.contains(k), f"matches: {k}") for k in L.CONTRACT_KEYWORDS])))

    def judged(reasons: Column) -> Column:
        total = F.least(F.lit(100), F.size(reasons) * KEYWORD_POINTS + F.when(has_budget, BUDGET_POINTS).otherwise(0))
        budget_reason = F.array_compact(F.array(F.when(has_budget, F.concat(F.lit("budget listed: "), budget))))
        return F.struct(total.cast("int").alias("score"), F.concat(reasons, budget_reason).alias("reasons"))

    return let(found, judged)
