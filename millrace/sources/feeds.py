"""Postings and leads from payloads of web feeds, one parser for each feed's shape.

A payload is a row (payload, arg, body): an orderable name, what it was asked for, and the whole JSON, XML or HTML
text. Parsers are Column expressions over such rows, so a folder of a million payloads is one scan; what a payload
doesn't have is null, and one that can't be parsed gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import facts
from millrace.functions.text import END, START, apply_email, split_title
from millrace.operators.merging import keep_first

#: Columns of every posting and lead, besides the payload and position that it came from.
POSTING = {
    "source": "string", "source_id": "string", "title": "string", "company": "string", "company_url": "string", "url": "string", "apply_email": "string", "location": "string", "remote": "boolean",
    "salary_text": "string", "tags": "array<string>", "description": "string", "posted_at": "timestamp", "sparse": "boolean", "arrangement": "string", "geo_eligibility": "string", "geo_regions": "array<string>",
    "min_years": "int", "max_years": "int", "experience_text": "string", "easy_apply": "boolean",
}
LEAD = {"source": "string", "source_id": "string", "title": "string", "client_or_company": "string", "url": "string", "contact_email": "string", "budget_text": "string", "description": "string", "posted_at": "timestamp"}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder as a payload; arg is the file's name without its ending."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    name = F.col("_metadata.file_path")
    return rows.select(name.alias("payload"), F.regexp_extract(name, r"([^/]*?)(?:\.[a-z]+)?$", 1).alias("arg"), F.col("value").alias("body"))


def records(rows: DataFrame, schema: dict[str, str], **values: Column | str) -> DataFrame:
    """payload, pos and the schema's columns, null where no value is given."""
    def of(name: str, kind: str) -> Column:
        value = values.get(name)
        return (F.lit(value) if isinstance(value, str) or value is None else value).cast(kind).alias(name)

    return rows.select("payload", "pos", *[of(n, k) for n, k in schema.items()])


def filled(value: Column, other: Column | str | None = None) -> Column:
    """The text if it has any, else the other."""
    own = F.nullif(value, F.lit(""))
    return own if other is None else F.coalesce(own, F.lit(other) if isinstance(other, str) else other)


def tag_list(*parts: Column) -> Column:
    """The filled texts of arrays and texts, in order."""
    return F.filter(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])), lambda t: F.coalesce(t, F.lit("")) != "")


def _one(value: Column) -> Column:
    return F.array(value)


def items(payloads: DataFrame, parsed: Column, name: str = "d") -> DataFrame:
    """payload, arg, pos and one struct for each entry of a parsed array."""
    return payloads.select("payload", "arg", F.posexplode(parsed).alias("pos", name)).filter(F.col(name).isNotNull())


def first_of_each(rows: DataFrame, key: Column) -> DataFrame:
    """Rows with a key, the first of each in the order of payloads and positions."""
    return keep_first(rows.withColumn("__key", filled(key)).filter("__key is not null"), ["__key"], [F.col("payload"), F.col("pos")])


def iso_date(text: Column) -> Column:
    return F.try_to_timestamp(text)


def mail_date(text: Column) -> Column:
    """`Mon, 02 Jan 2006 15:04:05 GMT` or with an offset; null if it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text))


def _commas(number: Column) -> Column:
    return F.call_function("format_number", number, F.lit("#,##0.###"))


def remoteok(payloads: DataFrame) -> DataFrame:
    schema = "array<struct<id string, position string, company string, company_url string, url string, apply_url string, description string, location string, salary_min string, salary_max string, tags array<string>, date string>>"
    d = F.col("d")
    rows = items(payloads, F.from_json("body", schema)).filter(filled(d.id).isNotNull() & (d.id != "0") & filled(d.position).isNotNull())
    path = F.concat(F.when(d.url.startswith("/"), "").otherwise("/"), F.regexp_replace(d.url, r"^https?://remoteok\.com", ""))
    pay = F.concat(F.lit("$"), d.salary_min, F.lit(" - $"), d.salary_max)
    paid = ~F.coalesce(d.salary_min, F.lit("")).isin("", "0") & ~F.coalesce(d.salary_max, F.lit("")).isin("", "0")
    return records(
        rows, POSTING, source="remoteok", source_id=d.id, title=d.position, company=filled(d.company, "Unknown"), company_url=filled(d.company_url), apply_email=apply_email(d.description),
        url=F.when(filled(d.url).isNotNull(), F.concat(F.lit("https://remoteok.com"), path)).otherwise(d.apply_url), location=filled(d.location, "Remote"), remote=F.lit(True),
        salary_text=F.when(paid, pay), tags=tag_list(d.tags), description=d.description, posted_at=iso_date(d.date),
    )


def remotive(payloads: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id string, title string, company_name string, company_logo_url string, url string, description string, candidate_required_location string, salary string, tags array<string>, publication_date string>>"
    d = F.col("d")
    rows = first_of_each(items(payloads, F.from_json("body", schema)["jobs"]), d.id)
    return records(
        rows, POSTING, source="remotive", source_id=d.id, title=d.title, company=filled(d.company_name, "Unknown"), company_url=filled(d.company_logo_url), url=d.url, apply_email=apply_email(d.description),
        location=filled(d.candidate_required_location, "Remote"), remote=F.lit(True), salary_text=filled(d.salary), tags=tag_list(d.tags), description=d.description, posted_at=iso_date(d.publication_date),
    )


_ARBEITNOW = "data array<struct<slug string, title string, company_name string, url string, description string, location string, remote boolean, tags array<string>, job_types array<string>, created_at long>>"


def arbeitnow(payloads: DataFrame) -> DataFrame:
    d = F.col("d")
    rows = items(payloads, F.from_json("body", _ARBEITNOW)["data"]).filter(d.remote)
    return records(
        rows, POSTING, source="arbeitnow", source_id=d.slug, title=d.title, company=filled(d.company_name, "Unknown"), url=d.url, apply_email=apply_email(d.description), location=filled(d.location, "Remote"),
        remote=F.lit(True), tags=tag_list(d.tags), description=d.description, posted_at=F.timestamp_seconds(F.nullif(d.created_at, F.lit(0))),
    )


def arbeitnow_contract(payloads: DataFrame) -> DataFrame:
    """Entries of which some type is a contract or freelance work, as leads."""
    d = F.col("d")
    rows = items(payloads, F.from_json("body", _ARBEITNOW)["data"]).filter(F.exists(d.job_types, lambda t: t.rlike("(?i)contract|freelance")))
    return records(rows, LEAD, source="arbeitnow_contract", source_id=d.slug, title=d.title, client_or_company=d.company_name, url=d.url, contact_email=apply_email(d.description), description=d.description, posted_at=F.timestamp_seconds(F.nullif(d.created_at, F.lit(0))))


def himalayas(payloads: DataFrame) -> DataFrame:
    schema = "jobs array<struct<guid string, title string, companyName string, companyLogo string, applicationLink string, excerpt string, description string, employmentType string, minSalary double, maxSalary double, salaryPeriod string, currency string, categories array<string>, seniority array<string>, locationRestrictions array<struct<name string>>, pubDate long>>"
    d = F.col("d")
    found = items(payloads, F.from_json("body", schema)["jobs"]).filter(filled(d.title).isNotNull() & filled(d.applicationLink).isNotNull())
    rows = first_of_each(found, filled(d.guid, d.applicationLink))
    places = F.array_join(F.filter(F.transform(d.locationRestrictions, lambda p: p["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), ", ")
    period = F.coalesce(F.concat(F.lit("/"), filled(d.salaryPeriod)), F.lit(""))
    pay = F.trim(F.concat(F.coalesce(d.currency, F.lit("")), F.lit(" "), F.coalesce(_commas(d.minSalary), F.lit("?")), F.lit(" - "), F.coalesce(_commas(d.maxSalary), F.lit("?")), period))
    text = filled(d.description, d.excerpt)
    return records(
        rows, POSTING, source="himalayas", source_id=F.col("__key"), title=d.title, company=filled(d.companyName, "Unknown"), company_url=filled(d.companyLogo), url=d.applicationLink, apply_email=apply_email(text),
        location=filled(places, "Worldwide"), remote=F.lit(True), salary_text=F.when(d.minSalary.isNotNull() | d.maxSalary.isNotNull(), pay), tags=tag_list(d.categories, d.seniority, _one(d.employmentType)),
        description=text, posted_at=F.timestamp_millis(F.nullif(d.pubDate, F.lit(0))),
    )


def jobicy(payloads: DataFrame) -> DataFrame:
    """The payload is an array of entries or an object that holds it; industry and type are a text or an array."""
    entry = "struct<id string, url string, jobTitle string, companyName string, companyLogo string, jobIndustry string, jobType string, jobGeo string, jobLevel string, jobExcerpt string, jobDescription string, pubDate string, annualSalaryMin string, annualSalaryMax string, salaryCurrency string>"
    d = F.col("d")
    parsed = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{entry}>")).otherwise(F.from_json("body", f"jobs array<{entry}>")["jobs"])
    found = items(payloads, parsed).filter(filled(d.jobTitle).isNotNull() & filled(d.url).isNotNull())

    def many(x: Column) -> Column:
        return F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))

    text = filled(d.jobDescription, d.jobExcerpt)
    pay = F.trim(F.concat(F.coalesce(d.salaryCurrency, F.lit("")), F.lit(" "), F.coalesce(d.annualSalaryMin, F.lit("?")), F.lit(" - "), F.coalesce(d.annualSalaryMax, F.lit("?")), F.lit(" /year")))
    return records(
        first_of_each(found, filled(d.id, d.url)), POSTING, source="jobicy", source_id=F.col("__key"), title=d.jobTitle, company=filled(d.companyName, "Unknown"), company_url=filled(d.companyLogo), url=d.url, apply_email=apply_email(text),
        location=filled(d.jobGeo, "Remote"), remote=F.lit(True), salary_text=F.when(d.annualSalaryMin.isNotNull() | d.annualSalaryMax.isNotNull(), pay), tags=tag_list(many(d.jobIndustry), many(d.jobType), _one(d.jobLevel)),
        description=text, posted_at=iso_date(d.pubDate),
    )


def adzuna(payloads: DataFrame) -> DataFrame:
    """arg is the country. Only entries that hint at remote work; whether they are remote stays open."""
    schema = "results array<struct<id string, title string, description string, redirect_url string, created string, contract_time string, contract_type string, salary_min double, salary_max double, salary_is_predicted string, company struct<display_name string>, location struct<display_name string>, category struct<label string>>>"
    d = F.col("d")
    hint = F.concat_ws(" ", d.title, F.coalesce(d.description, F.lit("")), F.coalesce(d.location.display_name, F.lit(""))).rlike(f"(?i){START}(?:remote|work from home|wfh|distributed|anywhere){END}")
    found = items(payloads, F.from_json("body", schema)["results"]).filter(filled(d.title).isNotNull() & filled(d.redirect_url).isNotNull() & hint)
    rows = first_of_each(found, F.coalesce(F.concat(F.col("arg"), F.lit(":"), d.id), d.redirect_url))

    def money(x: Column) -> Column:
        return F.format_number(F.floor(F.coalesce(x, F.lit(0.0)) + 0.5), 0)

    pay = F.concat(money(d.salary_min), F.lit(" - "), money(d.salary_max), F.when(d.salary_is_predicted == "1", " (estimated by Adzuna)").otherwise(""))
    return records(
        rows, POSTING, source="adzuna", source_id=F.col("__key"), title=d.title, company=filled(d.company.display_name, "Unknown"), url=d.redirect_url, apply_email=apply_email(d.description),
        location=filled(d.location.display_name, F.upper("arg")), salary_text=F.when(d.salary_min.isNotNull() | d.salary_max.isNotNull(), pay), tags=tag_list(_one(d.category.label), _one(d.contract_time), _one(d.contract_type)),
        description=d.description, posted_at=iso_date(d.created),
    )


def _rss(payloads: DataFrame) -> DataFrame:
    """Entries of RSS payloads, the first of each guid, link or title."""
    schema = "channel struct<item array<struct<title string, region string, category string, type string, description string, pubDate string, guid string, link string>>>"
    parsed = F.from_xml(F.col("body"), schema, {"rowTag": "rss", "mode": "PERMISSIVE"})
    d = F.col("d")
    return first_of_each(items(payloads, parsed["channel"]["item"]), F.coalesce(filled(d.guid), filled(d.link), d.title))


def _is_contract() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("d.type"), F.lit("")))) == "contract"


def wwr(payloads: DataFrame) -> DataFrame:
    d, parts = F.col("d"), split_title(filled(F.col("d.title"), "Untitled"))
    return records(
        _rss(payloads).filter(~_is_contract()), POSTING, source="wwr", source_id=F.coalesce(filled(d.guid), filled(d.link), parts["title"]), title=parts["title"], company=F.coalesce(parts["company"], F.lit("Unknown")), url=F.coalesce(d.link, F.lit("")),
        apply_email=apply_email(d.description), location=filled(F.trim(d.region), "Remote"), remote=F.lit(True), tags=tag_list(_one(d.category), _one(d.type)), description=d.description, posted_at=mail_date(d.pubDate),
    )


def wwr_contract(payloads: DataFrame) -> DataFrame:
    d, parts = F.col("d"), split_title(filled(F.col("d.title"), "Untitled"))
    return records(
        _rss(payloads).filter(_is_contract()), LEAD, source="wwr_contract", source_id=F.coalesce(filled(d.guid), filled(d.link), parts["title"]), title=parts["title"], client_or_company=F.coalesce(parts["company"], F.lit("Unknown")),
        url=F.coalesce(d.link, F.lit("")), contact_email=apply_email(d.description), description=d.description, posted_at=mail_date(d.pubDate),
    )


def ycombinator(payloads: DataFrame) -> DataFrame:
    """Postings in the JSON of a page's data-page attribute. A visa limit gives way to a place that is open itself."""
    schema = "props struct<jobPostings array<struct<id string, title string, url string, location string, minExperience string, visa string, skills array<string>, companyName string>>>"
    json = F.regexp_extract("body", 'data-page="([^"]+)"', 1)
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        json = F.replace(json, F.lit(entity), F.lit(char))
    d = F.col("d")
    rows = items(payloads, F.from_json(json, schema)["props"]["jobPostings"]).filter(d.id.isNotNull() & filled(d.title).isNotNull() & filled(d.companyName).isNotNull())
    years = facts.experience(d.minExperience)
    limited = F.coalesce(facts.visa_geo(d.visa) == "restricted", F.lit(False)) & (facts.geo(d.location)["eligibility"] != "eligible")
    base = "https://www.ycombinator.com"
    return records(
        rows, POSTING, source="ycombinator", source_id=d.id, title=d.title, company=d.companyName, url=F.coalesce(F.concat(F.lit(base), filled(d.url)), F.lit(f"{base}/jobs")), location=d.location,
        tags=F.concat(F.array(F.lit("ycombinator")), F.coalesce(d.skills, F.array().cast("array<string>"))), min_years=years["min_years"], max_years=years["max_years"], experience_text=years["experience_text"],
        geo_eligibility=F.when(limited, "restricted"), geo_regions=F.when(limited, F.array(F.lit("us"))), sparse=F.lit(True),
    )
