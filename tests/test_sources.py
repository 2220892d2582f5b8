"""Feeds, alert mails, pages and the catalogue of sources, over small payloads."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.sources import alerts, feeds, registry
from millrace.sources.markup import tree
from millrace.sources.pages import enrich_pages


def payloads(spark, *bodies, args=None):
    rows = [(f"p{i:03}", args[i] if args else "", b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload string, arg string, body string").repartition(2)


def by_id(df):
    rows = df.collect()
    out = {r["source_id"]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def test_remoteok(spark):
    got = by_id(feeds.remoteok(payloads(spark, [
        {"legal": "terms"}, {"id": 1, "position": "Dev", "company": "", "url": "/l/1", "salary_min": 10, "salary_max": 20, "tags": ["a"], "description": "write to me@x.org.", "date": "2024-05-01T10:00:00+00:00"},
        {"id": "2", "position": "Ops", "url": "https://remoteok.com/l/2", "salary_min": 0, "salary_max": 5, "tags": "none"}, {"id": 3, "position": "X", "apply_url": "http://a"}, {"id": 0, "position": "no"},
    ], "not json", None)))
    assert set(got) == {"1", "2", "3"}
    assert (got["1"]["company"], got["1"]["salary_text"], got["1"]["url"], got["1"]["apply_email"], got["1"]["location"]) == ("Unknown", "$10 - $20", "https://remoteok.com/l/1", "me@x.org", "Remote")
    assert got["1"]["posted_at"] == datetime(2024, 5, 1, 10) and got["1"]["remote"] is True and got["1"]["tags"] == ["a"]
    assert got["2"]["salary_text"] is None and got["2"]["url"] == "https://remoteok.com//l/2" and got["2"]["tags"] == []
    assert got["3"]["url"] == "http://a"


def test_remotive_keeps_the_first_of_an_id(spark):
    got = by_id(feeds.remotive(payloads(spark, {"jobs": [{"id": 5, "title": "first"}, {"id": 6, "title": "six"}]}, {"jobs": [{"id": 5, "title": "second"}]}, {"nothing": 1})))
    assert {k: v["title"] for k, v in got.items()} == {"5": "first", "6": "six"}


def test_arbeitnow_jobs_and_leads(spark):
    body = {"data": [{"slug": "a", "title": "A", "remote": True, "created_at": 86400, "job_types": ["Full time"]}, {"slug": "b", "title": "B", "remote": False, "job_types": ["CONTRACT work"]}, {"slug": "c", "remote": True, "job_types": None}]}
    jobs, leads = by_id(feeds.arbeitnow(payloads(spark, body))), by_id(feeds.arbeitnow_contract(payloads(spark, body)))
    assert set(jobs) == {"a", "c"} and jobs["a"]["posted_at"] == datetime(1970, 1, 2) and set(leads) == {"b"}


def test_himalayas(spark):
    got = by_id(feeds.himalayas(payloads(spark, {"jobs": [
        {"guid": "g", "title": "T", "applicationLink": "http://l", "minSalary": 1000.5, "currency": "USD", "salaryPeriod": "year", "locationRestrictions": [{"name": "India"}, {"name": ""}, {}, {"name": "UK"}], "categories": ["x", ""], "employmentType": "Full", "pubDate": 86400000, "excerpt": "e"},
        {"title": "U", "applicationLink": "http://m"}, {"guid": "n", "title": "no link"},
    ]})))
    assert set(got) == {"g", "http://m"}
    assert (got["g"]["salary_text"], got["g"]["location"], got["g"]["tags"], got["g"]["description"]) == ("USD 1,000.5 - ?/year", "India, UK", ["x", "Full"], "e")
    assert got["http://m"]["location"] == "Worldwide" and got["http://m"]["salary_text"] is None


@pytest.mark.parametrize("wrap", [True, False])
def test_jobicy_takes_an_array_or_an_object(spark, wrap):
    entries = [{"id": 9, "url": "u", "jobTitle": "T", "jobIndustry": ["a", "b"], "jobType": "full", "annualSalaryMin": 5, "salaryCurrency": "EUR", "pubDate": "never"}, {"url": "only", "jobTitle": "V"}, {"id": 10, "jobTitle": "no url"}]
    got = by_id(feeds.jobicy(payloads(spark, {"jobs": entries} if wrap else entries)))
    assert set(got) == {"9", "only"}
    assert (got["9"]["tags"], got["9"]["salary_text"], got["9"]["posted_at"]) == (["a", "b", "full"], "EUR 5 - ? /year", None)


def test_adzuna_keeps_remote_hints(spark):
    body = {"results": [{"id": 1, "title": "Remote dev", "redirect_url": "r", "salary_min": 1234.6, "salary_is_predicted": "1", "category": {"label": "IT"}}, {"id": 2, "title": "Office", "redirect_url": "s"}, {"id": 3, "title": "x", "description": "Work from Home", "redirect_url": "t"}]}
    got = by_id(feeds.adzuna(payloads(spark, body, body, args=["gb", "us"])))
    assert set(got) == {"gb:1", "gb:3", "us:1", "us:3"}
    assert (got["gb:1"]["salary_text"], got["gb:1"]["remote"], got["us:1"]["location"], got["gb:1"]["tags"]) == ("1,235 - 0 (estimated by Adzuna)", None, "US", ["IT"])


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>
<item><title>Acme: Engineer: Core</title><region> </region><category>Dev</category><type>Full-Time</type><description>&lt;p&gt;mail hr@acme.com&lt;/p&gt;</description><pubDate>Mon, 06 May 2024 10:00:00 +0000</pubDate><guid>g1</guid><link>http://l1</link></item>
<item><title>No colon</title><region>Europe</region><type> Contract </type><pubDate>bad</pubDate><link>http://l2</link></item></channel></rss>"""


def test_rss_jobs_and_leads(spark):
    jobs, leads = by_id(feeds.wwr(payloads(spark, RSS, RSS, "<broken"))), by_id(feeds.wwr_contract(payloads(spark, RSS)))
    assert set(jobs) == {"g1"} and set(leads) == {"http://l2"}
    job = jobs["g1"]
    assert (job["company"], job["title"], job["location"], job["apply_email"], job["tags"]) == ("Acme", "Engineer: Core", "Remote", "hr@acme.com", ["Dev", "Full-Time"])
    assert job["posted_at"] == datetime(2024, 5, 6, 10) and leads["http://l2"]["client_or_company"] == "Unknown" and leads["http://l2"]["posted_at"] is None


def test_embedded_page_data(spark):
    posts = [
        {"id": 1, "title": "A & B", "companyName": "C", "url": "/j/1", "location": "San Francisco, CA, US", "minExperience": "3+ years", "visa": "US citizen/visa only", "skills": ["go"]},
        {"id": 2, "title": "T", "companyName": "C", "location": "Remote - India", "visa": "US citizenship/visa only"}, {"id": 3, "title": "no company"},
    ]
    data = json.dumps({"props": {"jobPostings": posts}}).replace("&", "&amp;").replace('"', "&quot;")
    got = by_id(feeds.ycombinator(payloads(spark, f'<div data-page="{data}"></div>', "<p>none</p>")))
    assert set(got) == {"1", "2"}
    assert (got["1"]["title"], got["1"]["url"], got["1"]["min_years"], got["1"]["geo_eligibility"], got["1"]["geo_regions"], got["1"]["tags"]) == ("A & B", "https://www.ycombinator.com/j/1", 3, "restricted", ["us"], ["ycombinator", "go"])
    assert got["2"]["geo_eligibility"] is None and got["2"]["sparse"]


CARDS = """<table><tr><td><a href="https://www.linkedin.com/comm/jobs/view/11?x">Harbour Pilot</a>
<a href="https://www.linkedin.com/jobs/view/11"><p>Harbour Pilot Tideworks · Hull (Remote) Easy Apply 3 days ago</p></a></td></tr>
<tr><td><a href="https://linkedin.com/jobs/view/12">Kiln Keeper</a><p>Ember &amp; Sons</p><p>Promoted</p><p>Stoke (Hybrid)</p></td></tr>
<tr><td><a href="https://linkedin.com/jobs/view/13">View job</a></td></tr><tr><td><a href="https://linkedin.com/jobs/view/12">See all jobs ›</a></td></tr>
<tr><td><a href="https://linkedin.com/jobs/view/14">Bell Founder · York</a><a href="https://linkedin.com/jobs/view/14">Bell Founder</a><a href="https://www.linkedin.com/company/x">Toll Ltd</a></td></tr>
<tr><td><a href="https://linkedin.com/jobs/view/15">Lamplighter</a><p>An alumni favourite</p><p>Bath</p></td></tr></table>"""


def outlines(spark, *html):
    return alerts.outlined(spark.createDataFrame([(f"m{i}", None, h) for i, h in enumerate(html)], "payload string, date timestamp, html string"))


def test_alert_cards(spark):
    got = {f["id"]: f for f in alerts.card_postings(outlines(spark, CARDS)).collect()}
    assert set(got) == {"11", "12", "14", "15"}
    assert (got["11"]["title"], got["11"]["company"], got["11"]["location"], got["11"]["easy_apply"]) == ("Harbour Pilot", "Tideworks", "Hull (Remote)", True)
    assert (got["12"]["title"], got["12"]["company"], got["12"]["location"], got["12"]["easy_apply"]) == ("Kiln Keeper", "Ember & Sons", "Stoke (Hybrid)", False)
    assert (got["14"]["title"], got["14"]["company"], got["14"]["location"]) == ("Bell Founder", "Toll Ltd", "York")
    assert (got["15"]["title"], got["15"]["company"], got["15"]["location"]) == ("Lamplighter", "Unknown", None)


@pytest.mark.parametrize("line", ["", " › ", "View job", "SEE MORE »", "view all the others", "12 new jobs", "view 3 new jobs", "Show more"])
def test_navigation_is_told(spark, line):
    row = spark.createDataFrame([(line, "Viewing engineer", "newsroom jobs lead")], "a string, b string, c string")
    assert row.select(*[alerts.is_navigation(F.col(c)) for c in "abc"]).first()[:] == (True, False, False)


def test_alert_cells(spark):
    cell = "<table><tr><td><a href='http://x/?jk=ab12'>Cooper</a><p>Stave Works</p><p>4.1</p><p>Remote</p><p>₹ 5,00,000 a year</p><p>Easily apply</p><p>" + "long text " * 9 + "</p><p>3 days ago</p><p>Second place</p></td></tr></table>"
    bad = "<a href='?jk=aa'>no cell</a><table><tr><td><a href='?jk=bb'>4.2</a><p>x</p></td></tr><tr><td><a href='?jk=cc'>alone</a></td></tr></table>"
    found = alerts.cell_postings(outlines(spark, cell + bad)).collect()
    assert [(f["title"], f["company"], f["location"], f["salary_text"], f["easy_apply"], f["description"]) for f in found] == [("Cooper", "Stave Works", "Remote", "₹ 5,00,000 a year", True, ("long text " * 9).strip())]


def test_alert_lines(spark):
    lines = ("<body><p>Rope Walker</p><p>Hemp Inc / 11-50 Employees</p><p>Hiring</p><p>Onsite or Remote, Deal | ₹ 10L | 3+ years of exp | Full-time</p><a href='http://l'>Learn More</a><p>Learn More</p><p>Beta / 1-10 employees</p>"
             "<p>Rope Walker</p><p>Hemp, Inc. / 51+ employees</p><p>Net Mender</p><p>Knots / 1,000 Employees</p><a href='http://m'>Learn More</a><p>Remote | Contract</p></body>")  # fmt: skip
    found = alerts.line_postings(outlines(spark, lines)).orderBy("pos").collect()
    assert [(f["id"], f["company"], f["stated"], f["location"], f["salary_text"], f["min_years"], f["url"]) for f in found] == [
        ("hemp-inc:rope-walker", "Hemp Inc", "remote", "Deal", "₹ 10L", 3, "http://l"), ("knots:net-mender", "Knots", "Remote", None, None, None, "http://m"),
    ]


def test_messages_that_fail_are_told(spark, monkeypatch):
    files = spark.createDataFrame([("good", b"From: a@b.c\n\nx"), ("none", None), ("junk", b"\xff\xfe\x00")], "path string, content binary")
    got = {r["payload"]: r["error"] for r in alerts.read_messages(files).collect()}
    assert got["good"] is None and got["none"] and got["junk"] and alerts.parse_mail(files).count() == 1
    mail = spark.createDataFrame([("a", "x@linkedin.com", "s", datetime(2024, 5, 7), CARDS), ("b", "x@linkedin.com", "s", datetime(2024, 5, 7), "<p>nothing</p>"), ("c", "x@else.com", "s", datetime(2024, 5, 7), "")], "payload string, sender string, subject string, date timestamp, html string")
    assert [tuple(r) for r in alerts.alert_failures(mail, alerts.LINKEDIN, datetime(2024, 5, 8)).collect()] == [("b", "no postings")]


def test_mailbox_scan(spark, tmp_path):
    def mail(name, sender, date, html, subject="new jobs"):
        (tmp_path / name).write_text(f"From: {sender}\nSubject: {subject}\nDate: {date}\nMessage-ID: <{name}@x>\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n{html}\n")

    mail("a.eml", "Jobs <alerts@linkedin.com>", "Mon, 06 May 2024 10:00:00 +0000", CARDS)
    mail("b.eml", "Jobs <alerts@linkedin.com>", "Tue, 07 May 2024 10:00:00 +0000", CARDS)
    mail("old.eml", "alerts@linkedin.com", "Mon, 01 Jan 2024 10:00:00 +0000", CARDS.replace("view/11", "view/99"))
    mail("other.eml", "x@example.com", "Mon, 06 May 2024 10:00:00 +0000", CARDS.replace("view/11", "view/98"))
    (tmp_path / "junk.eml").write_bytes(b"\xff\xfe\x00junk")
    box = alerts.read_mail(spark, str(tmp_path))
    got = by_id(alerts.alert_postings(box, alerts.LINKEDIN, datetime(2024, 5, 8)))
    assert set(got) == {"11", "12", "14", "15"} and got["11"]["arrangement"] == "remote" and got["11"]["remote"] is True and got["12"]["remote"] is False and got["11"]["posted_at"] == datetime(2024, 5, 6, 10)
    assert alerts.alert_postings(box, alerts.WELLFOUND, datetime(2024, 5, 8)).count() == 0


def test_page_descriptions(spark):
    structured = {"@graph": [{"@type": "Organization"}, {"@type": ["JobPosting"], "description": "<p>One</p><p>Two &amp; more</p>", "hiringOrganization": {"name": " Acme "}}]}
    pages = [
        ("https://linkedin.com/jobs/view/1", 200, f'<script type="application/ld+json">{json.dumps(structured)}</script>'),
        ("https://x/?currentJobId=2", 200, '<div class="a description__text b">Hello<br>World<ul><li>x</li></ul></div>'), ("u3", 200, "<p>nothing</p>"), ("u4", 404, ""), ("u5", 429, None), ("u6", 500, "x"), ("u7", None, None),
        ("u8", 200, '<script type="application/ld+json">{bad</script><div id="job-details">&lt;p&gt;Twice&lt;/p&gt;&lt;p&gt;told&lt;/p&gt;</div>'),
    ]
    got = {r["url"]: r for r in enrich_pages(spark.createDataFrame(pages, "url string, http_status int, html string")).collect()}
    first = got["https://linkedin.com/jobs/view/1"]
    assert (first["outcome"], first["description"], first["company"], first["job_id"]) == ("ok", "One\nTwo & more", "Acme", "1")
    assert got["https://x/?currentJobId=2"]["description"] == "Hello\nWorld x" or got["https://x/?currentJobId=2"]["description"].startswith("Hello\nWorld")
    assert [got[f"u{i}"]["outcome"] for i in (3, 4, 5, 6, 7)] == ["not_found", "not_found", "blocked", "error", "error"]
    assert got["u8"]["description"] == "Twice\ntold"


def test_catalogue_isolates_failures(spark):
    def payload_of(name):
        if name == "remotive":
            raise OSError("no such folder")
        return payloads(spark, {"data": [{"slug": "a", "title": "A", "remote": True}]} if name == "arbeitnow" else "[]")

    found = registry.read_sources(spark, registry.JOB_SOURCES, {"linkedin_alerts": True}, payload_of)
    assert "remotive" in found.errors and "linkedin_alert" in found.errors and set(found.skipped) == {"adzuna", "wellfound_alert", "indeed_alert"}
    assert [r["source_id"] for r in found.rows.collect()] == ["a"]
    leads = registry.read_sources(spark, registry.LEAD_SOURCES, {}, lambda n: payloads(spark, "[]"))
    assert set(leads.retired) == {"upwork_rss"} and leads.rows.count() == 0


def test_a_source_that_fails_while_it_runs_stops_no_other(spark, tmp_path):
    def payload_of(name):
        rows = payloads(spark, {"data": [{"slug": "a", "title": "A", "remote": True}]} if name == "arbeitnow" else {"jobs": [{"id": 1, "title": "T"}]})
        return rows.withColumn("body", F.raise_error(F.lit("torn payload")).cast("string")) if name == "remotive" else rows

    found = registry.read_sources(spark, registry.JOB_SOURCES, {}, payload_of, folder=str(tmp_path / "sources"))
    assert "torn payload" in found.errors["remotive"] and "arbeitnow" not in found.errors
    assert [r["source_id"] for r in found.rows.filter("source = 'arbeitnow'").collect()] == ["a"] and found.rows.filter("source = 'remotive'").count() == 0
    assert [r["source_id"] for r in registry.read_sources(spark, registry.JOB_SOURCES, {}, payload_of, folder=str(tmp_path / "sources")).rows.collect()] == ["a"]


def test_payload_folder(spark, tmp_path):
    (tmp_path / "gb.json").write_text(json.dumps({"results": [{"id": 1, "title": "Remote", "redirect_url": "r"}]}))
    rows = feeds.adzuna(feeds.read_payloads(spark, str(tmp_path)))
    assert [r["source_id"] for r in rows.collect()] == ["gb:1"]


def test_trees_of_broken_markup():
    root = tree("<table><tr><td>a<td>b<tr><td>c</table><p>d<p>e<script>var x = '<p>';</script>")
    assert [n.squeezed() for n in root.all("td")] == ["a", "b", "c"] and root.lines() == ["a", "b", "c", "d", "e"]
    assert tree("").lines() == [] and F is not None


def test_mails_of_one_file_are_dealt_over_tasks(spark):
    mail = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("payload"), F.timestamp_seconds("id").alias("date"), F.lit("<p>x</p>").alias("html"))
    rows = alerts.outlined(mail).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 200 and sum(r["count"] for r in rows) == 400


def test_what_is_sorted_by_card_holds_no_outline(spark):
    mail = spark.createDataFrame([("m", "<a href='https://linkedin.com/jobs/view/1'>Dev</a>")], "payload string, html string").withColumn("date", F.timestamp_seconds(F.lit(1)))
    plan = alerts.card_postings(alerts.outlined(mail))._jdf.queryExecution().executedPlan().toString()
    aggregate = [x for x in plan.split("\n") if "partial_max_by" in x]
    assert aggregate and not any("outline" in x for x in aggregate)
