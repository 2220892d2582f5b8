"""Queries over feeds, alert mails and fetched pages. Payloads are built from the driver's tables, whole texts included.

Entries are written as expressions that Spark and DuckDB both read; the SQL of a query applies the feed's rules to the
same entries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import merging
from millrace.plans import adapters as A
from millrace.plans import catalogue
from millrace.sources import alerts, feeds, pages, registry
from millrace.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Entries in one payload.
PER_PAYLOAD = 20
#: Ten o'clock UTC on 1 May 2024, in seconds.
MAY = 1714557600
DAY = "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')"
TITLE = "trim(replace(substring(text, 1, 40), chr(10), ' '))"
EMAIL = r"nullif(regexp_extract($x, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'), '')"
HINT = "(?i)(?:^|[^A-Za-z0-9_])(?:remote|work from home|wfh|distributed|anywhere)(?:[^A-Za-z0-9_]|$)"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _sql(entry: dict[str, str], filters: str, table: str = "documents", first_of: str | None = None, **values: str) -> str:
    """SQL of a query: entries that pass the filters, the first of each key, with the values; what is not given is the default."""
    columns = {"company": "source", "url": "NULL", "apply_email": EMAIL.replace("$x", "text"), "remote": "true", "salary_text": "NULL", "tags": "''", "description": "text", "posted": "NULL", "location": "NULL"} | values
    kinds = {"remote": "BOOLEAN", "posted": "BIGINT"}
    first = f"QUALIFY row_number() OVER (PARTITION BY {first_of} ORDER BY {next(iter(entry.values()))}) = 1" if first_of else ""
    own = ", ".join(f"{e} AS e_{c}" for c, e in entry.items())
    return f"WITH e AS (SELECT *, {own} FROM {table}), kept AS (SELECT * FROM e WHERE {filters} {first}) SELECT " + ", ".join(f"CAST({v} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c, v in columns.items()) + " FROM kept"


def _shown(rows: DataFrame, **renamed: Column) -> DataFrame:
    """The columns of postings that the queries compare."""
    own = {c: F.col(c) for c in ("source_id", "title", "company", "url", "apply_email", "location", "remote", "salary_text", "description")}
    return rows.select(*[v.alias(c) for c, v in (own | {"tags": F.array_join("tags", ","), "posted": F.unix_timestamp("posted_at")} | renamed).items()])


def _entries(spark: SparkSession, sf_dir: str, entry: dict[str, str], table: str = "documents") -> DataFrame:
    return A.table(spark, sf_dir, table).select(*[F.expr(e).alias(c) for c, e in entry.items()])


def _payloads(entries: DataFrame, within: str | None = None, **shapes: Column) -> DataFrame:
    """JSON payloads of some entries each, in the order of n; within names the object's field that holds the array."""
    shaped = entries.withColumns(shapes)
    group = F.floor(F.col("n") / PER_PAYLOAD)
    body = F.struct(*[c for c in shaped.columns if c != "n"])
    held = shaped.groupBy(group.alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", body.alias("e")))), lambda s: s["e"]).alias("held"))
    whole = F.to_json("held") if within is None else F.to_json(F.struct(F.col("held").alias(within)))
    return held.select(F.lpad(F.col("g").cast("string"), 12, "0").alias("payload"), F.when(F.col("g") % 2 == 0, "gb").otherwise("us").alias("arg"), whole.alias("body"))


REMOTEOK = {
    "n": "doc_id", "id": "doc_id", "position": TITLE, "company": "CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END", "apply_url": "'https://a.example/' || CAST(doc_id AS STRING)",
    "url": "CASE doc_id % 4 WHEN 0 THEN '/remote/' || CAST(doc_id AS STRING) WHEN 1 THEN 'https://remoteok.com/l/' || CAST(doc_id AS STRING) WHEN 2 THEN 'l/' || CAST(doc_id AS STRING) END",
    "salary_min": "CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END", "salary_max": "n_chars * 2", "location": "CASE WHEN doc_id % 5 > 0 THEN lang END", "description": "text", "date": f"'2024-05-' || {DAY} || 'T10:00:00+00:00'",
}


@query(_sql(
    REMOTEOK, "e_id <> 0 AND e_position <> ''", source_id="e_id", title="e_position", company="CASE WHEN e_company <> '' THEN e_company ELSE 'Unknown' END", tags="lang || ',' || source",
    url="CASE WHEN e_url IS NULL THEN e_apply_url ELSE 'https://remoteok.com' || CASE WHEN e_url[1] = '/' THEN '' ELSE '/' END || replace(e_url, 'https://remoteok.com', '') END", location="coalesce(e_location, 'Remote')",
    salary_text="CASE WHEN e_salary_min > 0 AND e_salary_max > 0 THEN '$' || e_salary_min || ' - $' || e_salary_max END", posted=f"{MAY} + 86400 * (doc_id % 28)",
))
def feed_remoteok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, REMOTEOK | {"lang": "lang", "source": "source"})
    return _shown(feeds.remoteok(_payloads(rows, tags=F.array("lang", F.lit(""), "source"))))


REMOTIVE = {
    "n": "doc_id", "id": "doc_id - doc_id % 2", "title": TITLE, "company_name": "CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END", "url": "'https://r.example/' || CAST(doc_id AS STRING)", "description": "text",
    "candidate_required_location": "CASE WHEN doc_id % 5 > 0 THEN lang ELSE '' END", "salary": "CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars AS STRING) || ' EUR' ELSE '' END", "tags": "split(lang || ',,' || source, ',')",
    "publication_date": f"'2024-05-' || {DAY} || 'T12:00:00+02:00'",
}


@query(_sql(
    REMOTIVE, "true", first_of="e_id", source_id="e_id", title="e_title", company="CASE WHEN e_company_name <> '' THEN e_company_name ELSE 'Unknown' END", url="e_url", salary_text="nullif(e_salary, '')",
    location="CASE WHEN e_candidate_required_location <> '' THEN e_candidate_required_location ELSE 'Remote' END", tags="lang || ',' || source", posted=f"{MAY} + 86400 * (doc_id % 28)",
))
def feed_remotive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two entries with one id the first stays."""
    return _shown(feeds.remotive(_payloads(_entries(spark, sf_dir, REMOTIVE), "jobs")))


ARBEITNOW = {
    "n": "doc_id", "slug": "'s-' || CAST(doc_id AS STRING)", "title": TITLE, "company_name": "CASE WHEN doc_id % 3 > 0 THEN source END", "url": "'https://n.example/' || CAST(doc_id AS STRING)", "description": "text",
    "location": "CASE WHEN doc_id % 5 > 0 THEN lang END", "remote": "doc_id % 4 > 0", "tags": "split(lang, ',')", "created_at": f"CASE WHEN doc_id % 6 > 0 THEN {MAY} + doc_id ELSE 0 END",
    "job_types": "split(CASE WHEN doc_id % 4 = 1 THEN 'Full time,CONTRACT work' WHEN doc_id % 4 = 2 THEN 'Freelancer' ELSE 'permanent' END, ',')",
}


@query(_sql(ARBEITNOW, "e_remote", source_id="e_slug", title="e_title", company="coalesce(e_company_name, 'Unknown')", url="e_url", location="coalesce(e_location, 'Remote')", tags="lang", posted="nullif(e_created_at, 0)"))
def feed_arbeitnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(feeds.arbeitnow(_payloads(_entries(spark, sf_dir, ARBEITNOW), "data")))


LEAD_COLUMNS = ("source_id", "title", "client_or_company", "url", "contact_email", "description")


@query(rf"""SELECT 's-' || doc_id AS source_id, {TITLE} AS title, CASE WHEN doc_id % 3 > 0 THEN source END AS client_or_company, 'https://n.example/' || doc_id AS url, {EMAIL.replace('$x', 'text')} AS contact_email, text AS description,
    CASE WHEN doc_id % 6 > 0 THEN {MAY} + doc_id END AS posted FROM documents WHERE doc_id % 4 IN (1, 2)""")
def feed_arbeitnow_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.arbeitnow_contract(_payloads(_entries(spark, sf_dir, ARBEITNOW), "data")).select(*LEAD_COLUMNS, F.unix_timestamp("posted_at").alias("posted"))


HIMALAYAS = {
    "n": "doc_id", "guid": "CASE WHEN doc_id % 2 = 0 THEN 'g' || CAST(doc_id AS STRING) END", "applicationLink": "CASE WHEN doc_id % 11 > 0 THEN 'https://h.example/' || CAST(doc_id - doc_id % 4 AS STRING) END", "title": TITLE,
    "companyName": "source", "excerpt": "substring(text, 1, 100)", "description": "CASE WHEN doc_id % 5 > 0 THEN text END", "employmentType": "CASE WHEN doc_id % 2 = 0 THEN 'Full' ELSE '' END",
    "minSalary": "CASE WHEN doc_id % 3 = 0 THEN n_chars + 0.5 WHEN doc_id % 3 = 1 THEN n_chars * 100.0 END", "maxSalary": "CASE WHEN doc_id % 6 < 2 THEN n_chars * 200.0 END", "salaryPeriod": "CASE WHEN doc_id % 2 = 0 THEN 'year' END",
    "currency": "CASE WHEN doc_id % 4 > 0 THEN 'USD' END", "pubDate": f"({MAY} + doc_id) * 1000", "categories": "split(source || ',', ',')",
}
_HTEXT = "coalesce(e_description, e_excerpt)"


@query(_sql(
    HIMALAYAS, "e_title <> '' AND e_applicationLink IS NOT NULL", first_of="coalesce(e_guid, e_applicationLink)", source_id="coalesce(e_guid, e_applicationLink)", title="e_title", url="e_applicationLink", description=_HTEXT,
    apply_email=EMAIL.replace("$x", _HTEXT), location="CASE WHEN doc_id % 3 = 0 THEN 'Worldwide' ELSE lang || ', India' END", tags="source || CASE WHEN e_employmentType <> '' THEN ',' || e_employmentType ELSE '' END", posted=f"{MAY} + doc_id",
    salary_text="CASE WHEN doc_id % 3 < 2 OR doc_id % 6 < 2 THEN trim(coalesce(e_currency, '') || ' ' || CASE doc_id % 3 WHEN 0 THEN format('{:,}', n_chars) || '.5' WHEN 1 THEN format('{:,}', n_chars * 100) ELSE '?' END || ' - '"
    " || CASE WHEN doc_id % 6 < 2 THEN format('{:,}', n_chars * 200) ELSE '?' END || coalesce('/' || e_salaryPeriod, '')) END",
))
def feed_himalayas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, HIMALAYAS | {"lang": "lang"})
    places = F.when(F.col("n") % 3 > 0, F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("India").alias("name"))))
    return _shown(feeds.himalayas(_payloads(rows, "jobs", locationRestrictions=places)))


JOBICY = {
    "n": "doc_id", "id": "CASE WHEN doc_id % 3 > 0 THEN doc_id END", "url": "'https://j.example/' || CAST(doc_id AS STRING)", "jobTitle": TITLE, "companyName": "source", "jobIndustry": "split(source || ',b', ',')", "jobType": "'full'",
    "jobGeo": "CASE WHEN doc_id % 5 > 0 THEN lang END", "jobLevel": "CASE WHEN doc_id % 2 = 0 THEN 'Senior' ELSE '' END", "jobExcerpt": "substring(text, 1, 100)", "jobDescription": "CASE WHEN doc_id % 5 > 0 THEN text ELSE '' END",
    "pubDate": f"CASE WHEN doc_id % 7 > 0 THEN '2024-05-' || {DAY} || 'T10:00:00Z' ELSE 'never' END", "annualSalaryMin": "CASE WHEN doc_id % 4 = 0 THEN n_chars END", "annualSalaryMax": "CASE WHEN doc_id % 8 < 2 THEN n_chars * 2 END",
    "salaryCurrency": "CASE WHEN doc_id % 3 = 0 THEN 'EUR' END",
}
_JTEXT = "CASE WHEN e_jobDescription <> '' THEN e_jobDescription ELSE e_jobExcerpt END"


@query(_sql(
    JOBICY, "e_jobTitle <> ''", source_id="coalesce(CAST(e_id AS VARCHAR), e_url)", title="e_jobTitle", url="e_url", description=_JTEXT, apply_email=EMAIL.replace("$x", _JTEXT), location="coalesce(e_jobGeo, 'Remote')",
    tags="source || ',b,full' || CASE WHEN e_jobLevel <> '' THEN ',' || e_jobLevel ELSE '' END", posted=f"CASE WHEN doc_id % 7 > 0 THEN {MAY} + 86400 * (doc_id % 28) END",
    salary_text="CASE WHEN e_annualSalaryMin IS NOT NULL OR e_annualSalaryMax IS NOT NULL THEN trim(coalesce(e_salaryCurrency, '') || ' ' || coalesce(CAST(e_annualSalaryMin AS VARCHAR), '?') || ' - ' || coalesce(CAST(e_annualSalaryMax AS VARCHAR), '?') || ' /year') END",
))
def feed_jobicy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads are arrays and objects in turn."""
    rows = _entries(spark, sf_dir, JOBICY)
    return _shown(feeds.jobicy(_payloads(rows).filter("arg = 'gb'").unionByName(_payloads(rows, "jobs").filter("arg = 'us'"))))


ADZUNA = {
    "n": "doc_id", "id": "CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id AS STRING) END", "title": TITLE, "description": "text", "redirect_url": "'https://z.example/' || CAST(doc_id AS STRING)", "created": f"'2024-05-' || {DAY} || 'T10:00:00Z'",
    "place": "CASE doc_id % 4 WHEN 0 THEN 'Remote, ' || lang WHEN 1 THEN 'remotely' WHEN 2 THEN 'WFH' END", "contract_time": "CASE WHEN doc_id % 3 = 0 THEN 'full_time' END", "contract_type": "'permanent'",
    "salary_min": "CASE WHEN doc_id % 3 > 0 THEN n_chars + 0.5 END", "salary_max": "CASE WHEN doc_id % 6 < 2 THEN n_chars * 10.0 END", "salary_is_predicted": "CASE WHEN doc_id % 5 = 0 THEN '1' ELSE '0' END", "source": "source", "lang": "lang",
}
_GB = f"(doc_id // {PER_PAYLOAD}) % 2 = 0"


@query(_sql(
    ADZUNA, f"e_title <> '' AND regexp_matches(concat_ws(' ', e_title, coalesce(e_description, ''), coalesce(e_place, '')), '{HINT}')", remote="NULL", title="e_title", url="e_redirect_url", posted=f"{MAY} + 86400 * (doc_id % 28)",
    source_id=f"CASE WHEN e_id IS NULL THEN e_redirect_url WHEN {_GB} THEN 'gb:' || e_id ELSE 'us:' || e_id END", location=f"coalesce(e_place, CASE WHEN {_GB} THEN 'GB' ELSE 'US' END)", tags="concat_ws(',', lang, e_contract_time, e_contract_type)",
    salary_text="CASE WHEN doc_id % 3 > 0 OR doc_id % 6 < 2 THEN CASE WHEN doc_id % 3 > 0 THEN format('{:,}', n_chars + 1) ELSE '0' END || ' - ' || CASE WHEN doc_id % 6 < 2 THEN format('{:,}', n_chars * 10) ELSE '0' END"
    " || CASE WHEN doc_id % 5 = 0 THEN ' (estimated by Adzuna)' ELSE '' END END",
))
def feed_adzuna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only entries that hint at remote work; the payload's argument is the country."""
    rows = _entries(spark, sf_dir, ADZUNA)
    named = {"company": F.struct(F.col("source").alias("display_name")), "location": F.struct(F.col("place").alias("display_name")), "category": F.struct(F.col("lang").alias("label"))}
    return _shown(feeds.adzuna(_payloads(rows, "results", **named)))


RSS = {
    "n": "doc_id", "title": f"CASE WHEN doc_id % 4 > 0 THEN source || ': ' ELSE '' END || {TITLE}", "region": "CASE WHEN doc_id % 5 > 0 THEN lang ELSE ' ' END", "category": "source", "type": "CASE WHEN doc_id % 3 = 1 THEN ' Contract ' ELSE 'Full-Time' END",
    "description": "trim(replace(text, chr(10), ' '))", "guid": "CASE WHEN doc_id % 2 = 0 THEN 'g' || CAST(doc_id AS STRING) END", "link": "'https://w.example/' || CAST(doc_id AS STRING)",
    "pubDate": f"'Mon, ' || {DAY} || ' May 2024 ' || CASE WHEN doc_id % 2 = 0 THEN '10:00:00 GMT' ELSE '12:00:00 +0200' END",
}


def _rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, RSS)

    def element(c: str) -> Column:
        escaped = F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c}>"), escaped, F.lit(f"</{c}>"))).otherwise("")

    item = F.concat(F.lit("<item>"), *[element(c) for c in RSS if c != "n"], F.lit("</item>"))
    held = rows.groupBy(F.floor(F.col("n") / PER_PAYLOAD).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    return held.select(F.lpad(F.col("g").cast("string"), 12, "0").alias("payload"), F.lit("").alias("arg"), F.concat(F.lit("<rss><channel><title>f</title>"), F.col("x"), F.lit("</channel></rss>")).alias("body"))


_COLON = "strpos(e_title, ':') BETWEEN 1 AND 60"
_WWR = dict(
    source_id="coalesce(e_guid, e_link)", title=f"CASE WHEN {_COLON} THEN trim(substring(e_title, strpos(e_title, ':') + 1)) ELSE trim(e_title) END", url="e_link", description="e_description",
    company=f"CASE WHEN {_COLON} THEN trim(substring(e_title, 1, strpos(e_title, ':') - 1)) ELSE 'Unknown' END", posted=f"{MAY} + 86400 * (doc_id % 28)", apply_email=EMAIL.replace("$x", "e_description"),
)


@query(_sql(RSS, "doc_id % 3 <> 1", location="CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'Remote' END", tags="source || ',Full-Time'", **_WWR))
def feed_wwr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(feeds.wwr(_rss(spark, sf_dir)))


@query(f"SELECT source_id, title, company AS client_or_company, url, apply_email AS contact_email, description, posted FROM ({_sql(RSS, 'doc_id % 3 = 1', **_WWR)})")
def feed_wwr_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.wwr_contract(_rss(spark, sf_dir)).select(*LEAD_COLUMNS, F.unix_timestamp("posted_at").alias("posted"))


YC = {
    "n": "doc_id", "id": "doc_id", "title": TITLE, "companyName": "CASE WHEN doc_id % 7 > 0 THEN source ELSE '' END", "url": "CASE WHEN doc_id % 3 > 0 THEN '/j/' || CAST(doc_id AS STRING) END",
    "location": "CASE doc_id % 3 WHEN 0 THEN 'San Francisco, CA, US' WHEN 1 THEN 'Remote - India' END", "minExperience": "CASE WHEN doc_id % 2 = 0 THEN CAST(1 + doc_id % 12 AS STRING) || '+ years' ELSE 'Any' END",
    "visa": "CASE WHEN doc_id % 4 < 2 THEN 'US citizen/visa only' WHEN doc_id % 4 = 2 THEN 'Will sponsor' END", "skills": "split(lang || ',' || source, ',')",
}


@query(f"""WITH e AS (SELECT *, {TITLE} AS t FROM documents WHERE doc_id % 7 > 0)
    SELECT CAST(doc_id AS VARCHAR) AS source_id, t AS title, source AS company, 'https://www.ycombinator.com' || CASE WHEN doc_id % 3 > 0 THEN '/j/' || doc_id ELSE '/jobs' END AS url,
        CASE doc_id % 3 WHEN 0 THEN 'San Francisco, CA, US' WHEN 1 THEN 'Remote - India' END AS location, 'ycombinator,' || lang || ',' || source AS tags,
        CASE WHEN doc_id % 2 = 0 THEN CAST(1 + doc_id % 12 AS INTEGER) END AS min_years, CASE WHEN doc_id % 4 < 2 AND doc_id % 3 <> 1 THEN 'restricted' END AS geo_eligibility FROM e WHERE t <> ''""")
def feed_ycombinator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in an attribute of a page. A visa limit gives way to an open place."""
    json = _payloads(_entries(spark, sf_dir, YC), "jobPostings").withColumn("body", F.concat(F.lit('{"props":'), F.col("body"), F.lit("}")))
    escaped = F.replace(F.replace(F.col("body"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    found = feeds.ycombinator(json.withColumn("body", F.concat(F.lit('<div data-page="'), escaped, F.lit('"></div>'))))
    return found.select("source_id", "title", "company", "url", "location", F.array_join("tags", ",").alias("tags"), "min_years", "geo_eligibility")


# Alert mails: one for each part, of which some are too old or from other senders.
NOON = datetime(2024, 5, 8)
MAIL = {"payload": "lpad(CAST(p_partkey AS STRING), 12, '0')", "sender": "CASE WHEN p_partkey % 5 = 4 THEN 'x@example.com' ELSE 'Jobs <alerts@$domain>' END", "subject": "'$subject'"}
_FRESH = "p_partkey % 5 <> 4 AND p_partkey % 7 > 0"


def _mails(spark: SparkSession, sf_dir: str, source: alerts.AlertSource, subject: str, html: str) -> DataFrame:
    """Mails of a sender: the html is an expression over part, every seventh mail is a month old."""
    columns = {c: F.expr(e.replace("$domain", source.domain).replace("$subject", subject)) for c, e in MAIL.items()}
    date = F.timestamp_seconds(F.when(F.col("p_partkey") % 7 > 0, F.lit(int(NOON.timestamp()) - 86400)).otherwise(int(NOON.timestamp()) - 30 * 86400))
    return A.table(spark, sf_dir, "part").select(*[v.alias(c) for c, v in columns.items()], date.alias("date"), F.expr(html).alias("html"))


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("source_id", "title", "company", "location", "arrangement", "remote", "salary_text", "description", "min_years", "easy_apply", "sparse", "url", F.array_join("tags", ",").alias("tags"))


PART_TITLE = "p_name || ' ' || CAST(p_partkey AS STRING)"
PAIR = "CAST(1000 + p_partkey - p_partkey % 2 AS STRING)"
CARDS = f"""CASE WHEN p_partkey % 3 = 0 THEN
    '<table><tr><td><a href="https://www.linkedin.com/comm/jobs/view/' || {PAIR} || '?x">' || {PART_TITLE} || '</a><a href="https://www.linkedin.com/jobs/view/' || {PAIR} || '"><p>' || {PART_TITLE} || ' ' || p_brand || ' · ' || p_type
        || ' (Remote) Easy Apply 3 days ago</p></a></td></tr></table>'
    ELSE '<table><tr><td><a href="https://linkedin.com/jobs/view/' || {PAIR} || '">' || {PART_TITLE} || '</a><p>' || p_brand || '</p><p>Promoted</p><p>' || p_type || ' (Hybrid)</p></td></tr>'
        || '<tr><td><a href="https://linkedin.com/jobs/view/9">View job</a></td></tr></table>' END"""


@query(f"""SELECT {PAIR} AS source_id, {PART_TITLE} AS title, p_brand AS company, p_type || CASE WHEN p_partkey % 3 = 0 THEN ' (Remote)' ELSE ' (Hybrid)' END AS location, CASE WHEN p_partkey % 3 = 0 THEN 'remote' ELSE 'hybrid' END AS arrangement,
    p_partkey % 3 = 0 AS remote, CAST(NULL AS VARCHAR) AS salary_text, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS INTEGER) AS min_years, p_partkey % 3 = 0 AS easy_apply, true AS sparse,
    'https://www.linkedin.com/jobs/view/' || {PAIR} || '/' AS url, 'linkedin-alert' AS tags FROM part WHERE {_FRESH} QUALIFY row_number() OVER (PARTITION BY {PAIR} ORDER BY p_partkey) = 1""")
def alert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts of cards, with links that are no postings; the first mail of an id counts."""
    return _found(alerts.alert_postings(_mails(spark, sf_dir, alerts.LINKEDIN, "new jobs", CARDS), alerts.LINKEDIN, NOON))


CELL = f"""'<table><tr><td><a href="http://x.example/?jk=a' || CAST(p_partkey AS STRING) || '">' || {PART_TITLE} || '</a><p>' || p_brand || '</p><p>4.1</p><p>' || p_type || ', Remote</p>' || CASE WHEN p_partkey % 2 = 0 THEN '<p>₹ ' || CAST(p_size AS STRING)
    || ',00,000 a year</p><p>Easily apply</p>' ELSE '' END || CASE WHEN p_partkey % 3 > 0 THEN '<p>' || repeat(p_name || ' ', 12) || '</p>' ELSE '' END || '<p>3 days ago</p></td></tr></table>'"""


@query(f"""SELECT 'a' || p_partkey AS source_id, {PART_TITLE} AS title, p_brand AS company, p_type || ', Remote' AS location, 'remote' AS arrangement, true AS remote, CASE WHEN p_partkey % 2 = 0 THEN '₹ ' || p_size || ',00,000 a year' END AS salary_text,
    CASE WHEN p_partkey % 3 > 0 THEN trim(repeat(p_name || ' ', 12)) END AS description, CAST(NULL AS INTEGER) AS min_years, p_partkey % 2 = 0 AS easy_apply, p_partkey % 3 = 0 AS sparse,
    'https://in.indeed.com/viewjob?jk=a' || p_partkey AS url, 'indeed-alert' AS tags FROM part WHERE {_FRESH}""")
def alert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(alerts.alert_postings(_mails(spark, sf_dir, alerts.INDEED, "Dev @ Acme", CELL), alerts.INDEED, NOON))


LINES = f"""'<body><p>' || {PART_TITLE} || '</p><p>' || p_brand || ' / 11-50 Employees</p><p>' || CASE WHEN p_partkey % 2 = 0 THEN 'Onsite or Remote, ' ELSE 'Hybrid, ' END || p_type || ' | ₹ ' || CAST(p_size AS STRING) || 'L | ' || CAST(1 + p_partkey % 9 AS STRING)
    || '+ years of exp | Full-time</p><a href="https://l.example/' || CAST(p_partkey AS STRING) || '">Learn More</a><p>Learn More</p><p>Beta / 1-10 employees</p></body>'"""


@query(f"""SELECT replace(lower(p_brand), '#', '-') || ':' || replace(lower({PART_TITLE}), ' ', '-') AS source_id, {PART_TITLE} AS title, p_brand AS company, p_type AS location, CASE WHEN p_partkey % 2 = 0 THEN 'remote' ELSE 'hybrid' END AS arrangement,
    p_partkey % 2 = 0 AS remote, '₹ ' || p_size || 'L' AS salary_text, CAST(NULL AS VARCHAR) AS description, CAST(1 + p_partkey % 9 AS INTEGER) AS min_years, CAST(NULL AS BOOLEAN) AS easy_apply, true AS sparse, 'https://l.example/' || p_partkey AS url,
    'wellfound-alert' AS tags FROM part WHERE {_FRESH}""")
def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(alerts.alert_postings(_mails(spark, sf_dir, alerts.WELLFOUND, "New jobs: some", LINES), alerts.WELLFOUND, NOON))


MESSAGE = f"""'From: Ann <ann@x.example>' || chr(10) || 'Subject: no ' || CAST(doc_id AS STRING) || chr(10) || 'Date: Mon, ' || {DAY} || ' May 2024 12:00:00 +0200' || chr(10) || 'Message-ID: <' || CAST(doc_id AS STRING) || '@x>' || chr(10)
    || 'MIME-Version: 1.0' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || 'Content-Type: text/' || CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'plain' END || '; charset=utf-8' || chr(10) || chr(10) || text || chr(10)"""


@query(f"""SELECT 'm' || doc_id AS payload, '<' || doc_id || '@x>' AS message_id, 'Ann <ann@x.example>' AS sender, 'no ' || doc_id AS subject, {MAY} + 86400 * (doc_id % 28) AS sent,
    CASE WHEN doc_id % 2 = 0 THEN trim(text, chr(10)) ELSE '<pre>' || trim(text, chr(10)) || chr(10) || '</pre>' END AS html FROM documents WHERE text IS NOT NULL""")
def mailbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as messages of two kinds."""
    raw = F.expr(MESSAGE)
    files = A.table(spark, sf_dir, "documents").filter("text is not null").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("path"), F.encode(raw, "UTF-8").alias("content"))
    html = F.when(F.col("html").startswith("<pre>"), F.col("html")).otherwise(F.trim(F.col("html"), F.lit("\n")))
    return alerts.parse_mail(files).select("payload", "message_id", "sender", "subject", F.unix_timestamp("date").alias("sent"), html.alias("html"))


_TEXT_OF = f"SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({catalogue._HTML}, '^\\n+', ''), '\\n+$', ''), '\\n\\n\\n+', chr(10) || chr(10), 'g')) AS body FROM (SELECT *, text AS html FROM documents)"


@query(f"""WITH told AS ({_TEXT_OF}), known AS (SELECT *, doc_id % 5 < 2 AND body <> '' AS ok FROM told)
    SELECT 'https://www.linkedin.com/jobs/view/' || doc_id AS url, CAST(doc_id AS VARCHAR) AS job_id, CASE WHEN ok THEN 'ok' WHEN doc_id % 5 < 3 OR (doc_id % 5 = 3 AND doc_id % 2 = 0) THEN 'not_found' WHEN doc_id % 5 = 3 THEN 'blocked' ELSE 'error' END AS outcome,
        CASE WHEN ok THEN body END AS description, CASE WHEN doc_id % 5 = 0 THEN source END AS company FROM known""")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in linked data, in a container, nowhere, and behind failed answers."""
    kind, key = F.col("doc_id") % 5, F.col("doc_id")
    data = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("description"), F.struct(F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("name")).alias("hiringOrganization")))
    html = F.when(kind == 0, F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))).when(kind == 1, F.concat(F.lit('<div class="a description__text">'), F.col("text"), F.lit("</div>"))).otherwise("<p>none</p>")
    status = F.when(kind == 3, F.when(key % 2 == 0, 404).otherwise(429)).when(kind == 4, F.when(key % 2 == 0, 500)).otherwise(200)
    fetched = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), key.cast("string")).alias("url"), html.alias("html"), status.alias("http_status"))
    return pages.enrich_pages(fetched).select("url", "job_id", "outcome", "description", "company")


# Reading all sources, and the facts of what was read.
@query("""SELECT 'read' AS what, 'remotive' AS source, count(DISTINCT doc_id - doc_id % 2) AS n FROM documents UNION ALL SELECT 'read', 'arbeitnow', count(*) FROM documents WHERE doc_id % 4 > 0
    UNION ALL SELECT * FROM (VALUES ('error', 'jobicy', NULL), ('skipped', 'adzuna', NULL), ('skipped', 'indeed_alert', NULL), ('skipped', 'linkedin_alert', NULL), ('skipped', 'wellfound_alert', NULL))""")
def sources_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of the catalogue at once: rows of those that answer, and why the others have none."""
    found = {"remotive": _payloads(_entries(spark, sf_dir, REMOTIVE), "jobs"), "arbeitnow": _payloads(_entries(spark, sf_dir, ARBEITNOW), "data")}
    empty = spark.createDataFrame([], "payload string, arg string, body string")

    def payloads(name: str) -> DataFrame:
        if name == "jobicy":
            raise OSError("no answer")
        return found.get(name, empty)

    reading = registry.read_sources(spark, registry.JOB_SOURCES, {}, payloads)
    without = spark.createDataFrame([("error", n) for n in reading.errors] + [("skipped", n) for n in reading.skipped], "what string, source string")
    return reading.rows.groupBy("source").agg(F.count("*").alias("n")).select(F.lit("read").alias("what"), "source", "n").unionByName(without, allowMissingColumns=True)


PLACES = [("Pune, India", "eligible", "in"), ("Remote - Worldwide", "worldwide", "worldwide"), ("Remote (US; CA)", "restricted", "us,ca"), ("", "unknown", "")]


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 'remote' WHEN doc_id % 3 = 0 THEN 'hybrid' ELSE 'remote' END AS arrangement, {A.pick_sql('doc_id', [p[1] for p in PLACES])} AS geo_eligibility,
    {A.pick_sql('doc_id', [p[2] for p in PLACES])} AS geo_regions, CAST(CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 1 + doc_id % 12 END AS INTEGER) AS min_years, CAST(CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 3 + doc_id % 12 END AS INTEGER) AS max_years FROM documents""")
def job_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of postings with whole texts: what the source states goes before what the text says."""
    key = F.col("doc_id")
    years = F.when(key % 2 == 0, F.concat((1 + key % 12).cast("string"), F.lit("-"), (3 + key % 12).cast("string"))).otherwise(F.concat((1 + key % 12).cast("string"), F.lit("+")))
    known = {
        "source": F.lit("s"), "source_id": key.cast("string"), "title": F.concat(F.lit("Dev "), key.cast("string")), "company": F.concat(F.lit("cust "), key.cast("string")), "location": A.pick(key, [p[0] for p in PLACES]), "remote": F.lit(True),
        "tags": F.when(key % 3 == 0, F.array(F.lit("Hybrid"))).otherwise(F.array().cast("array<string>")), "description": F.concat(F.col("text"), F.lit("\nWe ask for "), years, F.lit(" years.")), "min_years": F.when(key % 5 == 0, 9),
    }
    rows = A.table(spark, sf_dir, "documents").select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in feeds.POSTING.items()], key.alias("ord"))
    return ingest.prepared(rows, "ord").select("source_id", "arrangement", "geo_eligibility", F.array_join("geo_regions", ",").alias("geo_regions"), "min_years", "max_years")


@query("""SELECT 'f' || doc_id AS fingerprint, CASE WHEN doc_id % 4 = 0 THEN 'insert' ELSE 'merge' END AS action, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 > 0 THEN 'score' END AS stage,
    CAST(CASE WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN 1 + doc_id % 12 END AS INTEGER) AS min_years, CAST(NULL AS INTEGER) AS max_years FROM documents""")
def merge_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that gains a richer text derives the years again; one that doesn't leaves them."""
    key = F.col("doc_id")
    docs = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), key.cast("string")).alias("fingerprint"), key.alias("id"), key.cast("string").alias("source_id"), F.lit("Dev").alias("title"), F.lit("").alias("apply_email"), "text")
    gained = F.concat(F.col("text"), F.lit(" At least "), (1 + F.col("id") % 12).cast("string"), F.lit(" years."))
    batch = docs.withColumns({"source": F.lit("new"), "sources": F.array(F.lit("new")), "description": gained}).drop("text", "id")
    stored = docs.filter("id % 4 > 0").withColumns({"source": F.lit("old"), "sources": F.array(F.lit("old")), "description": F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" and much more than the batch has to say of it"))).otherwise(F.substring("text", 1, 3))}).drop("text")
    return merging.reconcile(batch, stored).select("fingerprint", "action", "stage", "min_years", "max_years")
