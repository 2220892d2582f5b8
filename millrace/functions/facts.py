"""Facts that postings state in free text: work arrangement, eligible places, experience, skills, roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions.text import END, START, let, token_pattern

YEARS = r"(?:years?|yrs?)(?![a-zA-Z])"
#: Fixed values, patterns by rule: the first group is the least number of years, the second the most.
EXPERIENCE_RULES = [
    rf"(?i)(?<!\d)(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})\s*{YEARS}",
    rf"(?i)(?<!\d)(\d{{1,2}})\s+to\s+(\d{{1,2}})\s*{YEARS}",
    rf"(?i)(?<!\d)(\d{{1,2}})()\s*(?:\+|or\s+more)\s*{YEARS}",
    rf"(?i)(?:at\s+least|minimum(?:\s+of)?|min\.?)\s+(?<!\d)(\d{{1,2}})()\s*{YEARS}",
]
DERIVED_VERSION = 1


def _mentions(text: Column, names: str) -> Column:
    return text.rlike(f"(?i){START}(?:{names}){END}")


def arrangement(location: Column, tags: Column, remote: Column) -> Column:
    """hybrid, onsite, remote or unknown: from the place, else the tags, else the flag. The patterns are fixed values."""

    def stated(text: Column) -> Column:
        return (
            F.when(_mentions(text, "hybrid"), "hybrid").when(_mentions(text, r"on[\s-]?site|onsite|in[\s-]?office|in\s+person"), "onsite")
            .when(_mentions(text, "remote|work from home|wfh|anywhere|worldwide|distributed|telecommute"), "remote")
        )

    return F.coalesce(stated(location), stated(F.array_join(tags, " ")), F.when(remote, "remote").when(~remote, "onsite"), F.lit("unknown"))


def experience(text: Column) -> Column:
    """struct(min_years, max_years, experience_text) of the first highest floor over the rules in order, or null."""
    def spans(rule: str, text: Column) -> Column:
        def span(s: Column) -> Column:
            most = F.nullif(F.regexp_extract(s, rule, 2), F.lit("")).cast("int")
            return F.struct(F.regexp_extract(s, rule, 1).cast("int").alias("min_years"), most.alias("max_years"), F.trim(s).alias("experience_text"))

        return F.transform(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), span)

    none = F.lit(None).cast("struct<min_years:int,max_years:int,experience_text:string>")
    all_spans = let(F.coalesce(text, F.lit("")), lambda text: F.concat(*[spans(r, text) for r in EXPERIENCE_RULES]))
    return F.aggregate(all_spans, none, lambda best, m: F.when(best.isNull() | (m["min_years"] > best["min_years"]), m).otherwise(best))


def geo(location: Column) -> Column:
    """struct(regions, eligibility): worldwide, eligible, restricted or unknown."""
    text = F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"[\s,]+$", ""))
    sure = _mentions(text, L.INDIA)
    listed = F.regexp_extract(text, r"\(\s*([A-Z]{2}(?:\s*[;,]\s*[A-Z]{2})*)\s*\)", 1)
    codes = F.transform(F.split(listed, "[;,]"), lambda c: F.lower(F.trim(c)))
    elsewhere = F.exists(F.split(text, "[,/;()]"), lambda c: F.trim(c).rlike(rf"(?i)^(?:{L.OTHER_COUNTRY})\z"))
    india = sure | (_mentions(text, L.PERHAPS_INDIA) & ~elsewhere)

    def present(tokens: list[tuple[str, Column]]) -> Column:
        return F.filter(F.array(*[F.when(test, token) for token, test in tokens]), lambda t: t.isNotNull())

    near = present([("in", india), ("apac", _mentions(text, L.APAC))])
    us_dotted = text.rlike(rf"(?i){START}u\.s\.a?\.?")
    far = present([(token, _mentions(text, names) | us_dotted if token == "us" else _mentions(text, names)) for token, names in L.RESTRICTED])
    none = F.array().cast("array<string>")

    def facts(regions: Column, eligibility: str | Column) -> Column:
        return F.struct(regions.alias("regions"), (F.lit(eligibility) if isinstance(eligibility, str) else eligibility).alias("eligibility"))

    return (
        F.when(text == "", facts(none, "unknown")).when(_mentions(text, L.WORLDWIDE), facts(F.array(F.lit("worldwide")), "worldwide"))
        .when(~sure & (listed != ""), facts(codes, F.when(F.array_contains(codes, "in"), "eligible").otherwise("restricted")))
        .when(F.size(near) > 0, facts(near, "eligible")).when(F.size(far) > 0, facts(far, "restricted")).otherwise(facts(none, "unknown"))
    )


def visa_geo(visa: Column) -> Column:
    """restricted if a visa statement asks for citizens or visa holders, else null."""
    return F.when(visa.rlike(r"(?i)us\s+citizen(?:ship)?/?visa\s+only"), "restricted")


def row_arrangement(value: Column) -> Column:
    """struct(arrangement, remote) as stored: unknown is null."""
    known = F.when(value != "unknown", value)
    return F.struct(known.alias("arrangement"), (known == "remote").alias("remote"))


def skills(text: Column, taxonomy: list[tuple[str, float, list[str]]] = L.SKILLS) -> Column:
    """array of struct(name, weight) mentioned in lower-case text; three mentions or more add 1, up to 5."""

    def mention(name: str, weight: float) -> Callable[[Column], Column]:
        return lambda n: F.when(n > 0, F.struct(F.lit(name).alias("name"), F.when(n >= 3, F.lit(min(weight + 1, 5.0))).otherwise(F.lit(weight)).alias("weight")))

    def told(text: Column) -> Column:
        found = []
        for name, weight, names in taxonomy:
            hits = sum((F.when(text.contains(t.lower()), F.regexp_count(text, F.lit(token_pattern(t)))).otherwise(0) for t in [name, *names]), F.lit(0))
            found.append(let(hits, mention(name, weight)))
        return F.filter(F.array(*found), lambda s: s.isNotNull())

    return let(text, told)


def emphasized_skills(text: Column, limit: int = 5, taxonomy: list[tuple[str, float, list[str]]] = L.DEFAULT_SKILLS) -> Column:
    """Names of the heaviest skills that stand as whole words in the text; ties in the taxonomy's order. Only a text with the letters of a name is searched for its pattern."""

    def told(both: Column) -> Column:
        text, small, found = both["text"], both["small"], []
        for i, (name, weight, names) in enumerate(taxonomy):
            either = "|".join(token_pattern(t).replace("s?(?![a-z0-9])", "").replace("(?<![a-z0-9])", "") for t in [name, *names])
            plain = reduce(lambda a, b: a | b, [small.contains(t.lower()) for t in [name, *names]])
            found.append(F.when(plain & text.rlike(f"(?i)(?:{START}(?=\\w)|(?<=\\w)(?!\\w))(?:{either})(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"), F.struct(F.lit(-weight).alias("w"), F.lit(i).alias("i"), F.lit(name).alias("name"))))
        return F.filter(F.array(*found), lambda s: s.isNotNull())

    kept = let(let(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("small"))), told)
    return F.transform(F.slice(F.array_sort(kept), 1, limit), lambda s: s["name"])


def target_roles(text: Column) -> Column:
    """Roles of the vocabulary whose words stand near each other in order, without those that a veto phrase is part of. Only a text with the letters of all words is searched for the pattern."""

    def told(both: Column) -> Column:
        found = []
        for role in L.ROLE_VOCABULARY:
            if not any(v in role for v in L.VETO_PHRASES):
                pattern = r"[\s\w.,/-]{0,20}?".join(token_pattern(w) for w in role.split())
                plain = reduce(lambda a, b: a & b, [both["small"].contains(w.lower()) for w in role.split()])
                found.append(F.when(plain & both["text"].rlike(f"(?i){pattern}"), role))
        return F.filter(F.array(*found), lambda r: r.isNotNull())

    return let(let(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("small"))), told)


def career_start(text: Column, now: Column) -> Column:
    """The earliest `Mon YYYY` since 1980 and not after this year, as a date; null if none or over 50 years ago."""
    pattern = rf"(?i){START}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{{4}}){END}"
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def day(span: Column) -> Column:
        year = F.regexp_extract(span, pattern, 2).cast("int")
        month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(span, pattern, 1))) + 2) / 3
        return F.when((year >= 1980) & (year <= F.year(now)), F.make_date(year, month.cast("int"), F.lit(1)))

    earliest = F.array_min(F.filter(F.transform(spans, day), lambda d: d.isNotNull()))
    return let(earliest, lambda first: F.when(F.datediff(now, first) <= 50 * 365.25, first))


#: A text with fewer characters tells too little of a person.
LEAST_PROFILE = 200


def extract_profile(text: Column, now: Column) -> Column:
    """struct(skills, target_roles, career_start, low_confidence) of a résumé's text; a short text gives the default skills."""
    low = F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_PROFILE
    default = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w, _ in L.DEFAULT_SKILLS])
    body = F.lower(F.coalesce(text, F.lit("")))
    own = skills(body)
    return F.struct(F.when(low | (F.size(own) == 0), default).otherwise(own).alias("skills"), target_roles(body).alias("target_roles"), career_start(text, now).alias("career_start"), low.alias("low_confidence"))
