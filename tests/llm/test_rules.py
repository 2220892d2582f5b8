"""License scans, temperature mixing and URL filters."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from helpers import EDGE, SF, documents, prose

from millrace.llm import licenses, mixing, url_filter
from millrace.llm.queries import QUERIES, SQL


def known():
    return licenses.Template.all_of(licenses.TEMPLATES)


FORMS = sorted((n, t) for n, group in licenses.TEMPLATES.items() for t in group)


@pytest.mark.parametrize(("name", "form"), FORMS)
def test_every_template_is_found_inside_prose(name, form):
    text = f"{prose(1)}.\n{form}\n{prose(2)}."
    (found,) = licenses.scan(text, known())
    assert (found["license"], found["coverage"], found["missing"], found["added"], found["exact"]) == (name, 1.0, [], [], True) and found["size"] < found["plain_size"]
    assert text[found["start"] : found["end"]].strip(" .") in form


def names(text):
    return [f["license"] for f in licenses.scan(text, known())]


def test_altered_wording_is_told():
    text = licenses.TEMPLATES["MIT"][0].replace("free of charge", "at no cost").replace("merge, ", "")
    assert names(text) == []  # a negation was put in
    (found,) = licenses.scan(text.replace("at no cost", "gratis"), known())
    assert found["license"] == "MIT" and 0.9 < found["coverage"] < 1 and {"merge", "free", "of", "charge"} == set(found["missing"]) and found["added"] == ["gratis"] and not found["exact"]


@pytest.mark.parametrize(("text", "want"), [
    ("Licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 notice"]), ("Licensed under the GNU General Public License v2", ["GPL-2.0 notice"]),
    ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under the Apache License 2.0", ["Apache-2.0 notice"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0 notice"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0 notice"]), ("Available under CC BY-SA 4.0.", ["CC-BY-SA-4.0 notice"]), ("Licensed under CC BY-NC-SA 2.5.", []),
    ("This is not released under the MIT License.", []), ("It is never distributed under the MIT License.", []), ("We do not mind. Released under the MIT License.", ["MIT notice"]),
    ("Provided under the terms of the MIT licence", ["MIT notice"]), ("He lost his driving license and asked for permission.", []), ("mit freundlichen Grüßen", []), ("", []), (None, []),
    (licenses.GNU_NOTICE.format(name="GNU General Public License", version="1"), []), (licenses.GNU_NOTICE.format(name="GNU Library General Public License", version="2"), []),
])
def test_words_that_tell_licenses_apart(text, want):
    assert names(text) == want


def test_two_licenses_in_a_long_text():
    text = f"{prose(1, 5000)}\n{licenses.TEMPLATES['ISC'][0]}\n{prose(2, 5000)}.\n{licenses.TEMPLATES['MIT notice'][0]}"
    assert names(text) == ["ISC", "MIT notice"]


def test_numbered_clauses_are_the_same_license():
    text = licenses.TEMPLATES["BSD-3-Clause"][0].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    assert names(text) == ["BSD-3-Clause"] and names(text[: text.index("3. Neither")] + text[text.index("THIS SOFTWARE") :]) == ["BSD-2-Clause"]


def test_a_license_after_several_shortened_ones_is_found():
    for share in (0.6, 0.7):
        short = [" ".join(licenses.TEMPLATES[n][0].split()[: int(share * len(licenses.TEMPLATES[n][0].split()))]) + "." for n in ("MIT", "BSD-2-Clause", "Apache-2.0")]
        text = " ".join([*short, licenses.TEMPLATES["MPL-2.0"][0]])
        assert [f["coverage"] for f in licenses.scan(text, known()) if f["license"] == "MPL-2.0"] == [1.0]


def slow_cost(template, words):
    """Cost of turning the template's words into all of these, or None, by plain dynamic programming."""
    never = 10**6
    before = [0]
    for w in words:
        before.append(before[-1] + (never if template.tells(w) else 1))
    for t in template.words:
        out = never if template.tells(t) or not template.may_miss else 2
        row = [before[0] + out]
        for j, w in enumerate(words, 1):
            best = min(before[j] + out, row[j - 1] + (never if template.tells(w) else 1))
            row.append(min(best, before[j - 1]) if t == w else best)
        before = row
    return before[-1] if before[-1] <= template.limit else None


def slow_finds(text, templates):
    """All templates against all windows by alignment alone; of those that overlap, the best stays."""
    placed, found = licenses.words_of(text), []
    words = [w for w, _, _ in placed]
    for t in templates:
        for i in range(len(words)):
            for j in range(i + max(1, len(t.words) - t.may_miss), min(len(words), i + len(t.words) + t.limit) + 1):
                if words[i] in t.words and words[j - 1] in t.words and (cost := slow_cost(t, words[i:j])) is not None:
                    between = [w for k, w in enumerate(words[max(0, i - 3) : i], max(0, i - 3)) if not any(c in text[placed[k][2] : placed[i][1]] for c in (". ", "? ", "! ", "\n"))]
                    if not set(between) & licenses.NEGATIONS:
                        found.append((-(len(t.words) - cost), i, j, t.name))
    out = []
    for f in sorted(found):
        if all(f[2] <= o[1] or f[1] >= o[2] for o in out):
            out.append(f)
    return sorted((f[1], f[3]) for f in out)


@pytest.mark.parametrize("seed", range(12))
def test_finds_by_brute_force(seed):
    """Short notices, some with words put in or left out, among words of licenses."""
    r = random.Random(seed)
    templates = [t for t in known() if len(t.words) <= 8]
    near = sorted({w for t in templates for w in t.words} | {"not", "terms", "of"})
    parts = []
    for _ in range(4):
        words = list(r.choice(templates).words)
        for _ in range(r.choice([0, 0, 1, 2])):
            words.insert(r.randrange(len(words) + 1), r.choice(near))
        if r.random() < 0.3:
            words.pop(r.randrange(len(words)))
        parts += [" ".join(words), r.choice([". ", " ", "\n"]), " ".join(r.choice(near) for _ in range(r.randint(0, 5))), r.choice([". ", " "])]
    text = "".join(parts)
    placed = licenses.words_of(text)
    at = {a: i for i, (_, a, _) in enumerate(placed)}
    assert [(at[f["start"]], f["license"]) for f in licenses.scan(text, templates)] == slow_finds(text, templates)


def test_time_grows_with_the_text():
    """Five hundred copies of a license, and 5 MB of nothing but a key word, each within seconds."""
    mit = licenses.TEMPLATES["MIT"][0]
    began = time.process_time()
    found = licenses.scan("\n\n".join([mit] * 500), known())
    assert [(f["license"], f["exact"]) for f in found] == [("MIT", True)] * 500
    key = next(t.key for t in known() if t.name == "MIT")
    assert licenses.scan(f"{mit}\n" + f"{key} " * (5_000_000 // (len(key) + 1)), known())[0]["license"] == "MIT"
    assert time.process_time() - began < 40


def test_license_rows_of_edge_cases(spark):
    rows = EDGE + [(30, licenses.TEMPLATES["MIT notice"][0])] * 2 + [(None, licenses.TEMPLATES["BSD notice"][0])]
    got = licenses.find_licenses(documents(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], r["license"])) for r in got) == sorted(map(repr, [(30, "MIT notice")] * 2 + [(None, "BSD notice")]))
    assert licenses.find_licenses(documents(spark, EDGE).filter("doc_id < 0")).count() == 0


def test_license_query_against_a_plain_scan(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = [(k, f["license"], f["start"]) for k, t in texts.items() for f in licenses.scan(t, known())]
    assert sorted((r["doc_id"], r["license"], r["start"]) for r in QUERIES["op6_license_scan"](spark, SF).collect()) == sorted(want)


def table_of(sizes, seed=0):
    r, rows, source = random.Random(seed), [], []
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), "w " * r.randint(1, 30)))
            source.append(name)
    return rows, source


def best_exponent(totals, limit):
    """The least exponent whose mixture repeats no source more than the limit, by plain bisection."""

    def repeats(a):
        weight = {s: (t / max(totals.values())) ** a for s, t in totals.items()}
        passes = {s: w / t for s, (w, t) in ((s, (weight[s], totals[s])) for s in totals)}
        return max(passes.values()) / min(passes.values())

    low, high = 0.0, 1.0
    if repeats(0.0) <= limit:
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if repeats(middle) <= limit else (middle, high)
    return high


@pytest.mark.parametrize("limit", [1.5, 2.0, 4.0])
def test_mixture_meets_the_repetition_limit(spark, limit):
    rows, source = table_of({"a": 300, "b": 90, "c": 20, None: 5})
    tokens = {k: len(t.split()) for k, t in rows}
    totals = Counter()
    for (k, _), s in zip(rows, source, strict=True):
        totals[s] += tokens[k]
    got = mixing.mix(documents(spark, rows, source=source), repeat_limit=limit).collect()
    a = best_exponent(totals, limit)
    base = sum((t / max(totals.values())) ** a for t in totals.values())
    taken, times = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["tokens"]
        times[r["doc_id"]] += 1
    budget = base * max(totals.values())
    for s, t in totals.items():
        want = (t / max(totals.values())) ** a / base * budget
        assert abs(taken[s] - want) <= 31, (s, taken[s], want)
    assert set(times) == set(tokens) and max(times.values()) <= math.ceil(limit)
    assert len({(r["doc_id"], r["pass"]) for r in got}) == len(got)


def test_mixture_meets_the_entropy_and_a_budget(spark):
    rows, source = table_of({"a": 400, "b": 100, "c": 30})
    totals = Counter()
    for (_, t), s in zip(rows, source, strict=True):
        totals[s] += len(t.split())
    got = mixing.mix(documents(spark, rows, source=source), repeat_limit=None, entropy=0.9, budget=3000.0).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["tokens"]
    whole = sum(taken.values())
    assert abs(whole - 3000) <= 3 * 31
    assert abs(-sum(n / whole * math.log(n / whole) for n in taken.values()) - 0.9) < 0.02


def test_every_stretch_has_the_target_weights(spark):
    rows, source = table_of({"a": 3000, "b": 600})
    got = sorted((r["position"], r["source"], r["tokens"]) for r in mixing.mix(documents(spark, rows, source=source), repeat_limit=2.0).collect())
    share = sum(t for _, s, t in got if s == "b") / sum(t for _, _, t in got)
    for at in range(0, len(got), len(got) // 4):
        part = got[at : at + len(got) // 4]
        if len(part) > 500:
            assert abs(sum(t for _, s, t in part if s == "b") / sum(t for _, _, t in part) - share) < 0.06


def test_mixing_of_edge_cases(spark):
    docs = documents(spark, EDGE, source=["s" if i % 3 else None for i in range(len(EDGE))])
    got = mixing.mix(docs, repeat_limit=2.0).collect()
    assert Counter(repr(r["doc_id"]) for r in got if r["pass"] == 0) == Counter(repr(k) for k, _ in EDGE)
    back = mixing.mixed_documents(docs, repeat_limit=2.0)
    assert back.columns == docs.columns
    assert Counter((repr(r["doc_id"]), r["text"]) for r in back.collect()).keys() == Counter((repr(k), t) for k, t in EDGE).keys()
    assert sum(1 for _ in got) == back.count()
    assert mixing.mix(docs.filter("doc_id < 0")).count() == 0 and mixing.mixed_documents(docs.filter("doc_id < 0")).count() == 0
    blank = documents(spark, [(1, ""), (2, None)])
    assert mixing.mix(blank).count() == 2
    with pytest.raises(ValueError, match="give a repetition limit"):
        mixing.mix(docs, repeat_limit=None)


def test_mixing_takes_columns_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "a b", "s", {"k": 1}, [1]), (2, "c", "t", None, None)], "doc_id long, text string, source string, m map<string,int>, a array<int>")
    assert mixing.mixed_documents(docs, repeat_limit=2.0).select("doc_id").distinct().count() == 2


def test_mixing_plan_has_no_python(spark):
    plan = QUERIES["op7_temperature_mixing"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def slow_judge(pages, rules, edges):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]

    def rule(url):
        host, path = parts(url)
        fits = [(len(h + p), len(h), a == "allow", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else None

    near = defaultdict(set)
    for u, v in edges:
        if u is not None and v is not None:
            near[u].add(v)
            near[v].add(u)
    out = []
    for k, url in pages:
        own, seen, todo = rule(url), {url}, [url]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        acts = {rule(x)[1] for x in seen if rule(x)} if url is not None else set()
        verdict = own[1] if own else "block" if "block" in acts and "allow" not in acts else "allow"
        out.append((k, *parts(url), own[0] if own else None, verdict))
    return sorted(out, key=repr)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.example.org", "/", "block"), ("x.org", "/a", "block"), ("x.org", "/a", "allow")]


@pytest.mark.parametrize("more", [0, 100])
def test_urls_by_brute_force(spark, more):
    """With many rules they are joined by host."""
    rules = RULES + [(f"h{i}.com", "/", "block") for i in range(more)]
    r = random.Random(4)
    hosts = ["a.net", "example.net", "www.Example.NET", "example.com", "x.org", "b.example.org", "good.com", "other.io", "net", "h5.com", ".net", ""]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/x', '/de/y?q=/fr/', '/fr/#f', '?a=/', '#/x', '/a', '/x://y'])}" for _ in range(150)] + [None, "", "no scheme", "://", "mailto:x"]
    pages = list(enumerate(urls)) + [(3, urls[3]), (None, urls[4])]
    edges = [(r.choice(urls), r.choice(urls)) for _ in range(40)] + [(None, None), (urls[0], None), ("http://alias.io/", "http://a.net/"), ("http://alias.io/", "http://alias2.io/")]
    pages.append((999, "http://alias2.io/"))
    table = spark.createDataFrame([(k, u, "h", "x") for k, u in pages], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(table, rules, spark.createDataFrame(edges, "u string, v string")).collect()
    assert sorted(map(tuple, got), key=repr) == slow_judge(pages, rules, edges)


def test_urls_without_edges_and_without_rows(spark):
    table = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert sorted(map(tuple, url_filter.judge_urls(table, RULES).collect())) == [(1, "a.net", "/", "net/", "block"), (2, "", "", None, "allow")]
    assert url_filter.judge_urls(table.filter("page_id < 0"), RULES, spark.createDataFrame([], "u string, v string")).count() == 0


def test_links_of_pages(spark):
    html = [
        "<LINK href='http://a.net/?x=1&amp;y=2' rel=\"nofollow canonical\">", '<meta content="0; URL=http://b.org/x" http-equiv=refresh>', "<link rel=canonical href=/relative>",
        "<link rel=stylesheet href=http://c.org/canonical.css>", None, "", "<p>canonical</p>",
    ]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert sorted(map(tuple, url_filter.canonical_edges(pages).collect())) == [("u0", "http://a.net/?x=1&y=2"), ("u1", "http://b.org/x")]


RELATIVE = [
    ("https://Ex.org/a/b?q#f", link, want) for link, want in [
        ("/x", "https://Ex.org/x"), ("//other.net/y?z", "https://other.net/y?z"), ("x/y?z=/../#f", "https://Ex.org/a/x/y?z=/../#f"), ("?p=2", "https://Ex.org/a/b?p=2"), ("../../up/./x/../y/.", "https://Ex.org/up/y/"), ("./", "https://Ex.org/a/"),
        ("..", "https://Ex.org/"), ("#here", None), ("mailto:a@b.c", None), ("javascript:x", None), ("HTTP://Z.net/", "HTTP://Z.net/"), ("/a/../../..", "https://Ex.org/"), ("/u?x=http://y", "https://Ex.org/u?x=http://y"),
    ]
] + [("https://bare.org", "x", "https://bare.org/x"), ("https://bare.org", "?q", "https://bare.org?q"), ("no scheme", "/x", None), (None, "/x", None), (None, "http://a.b/", None), ("ftp://h/d/", "//i/", "ftp://i/")]


def test_relative_links_are_resolved(spark):
    """In Spark and in the SQL of the query, and they carry a block like any other."""
    from compare import assert_same, connect

    pages = spark.createDataFrame([(i, u, f"<link rel=canonical href='{link}'>") for i, (u, link, _) in enumerate(RELATIVE)], "page_id long, url string, html string")
    assert sorted(map(tuple, url_filter.canonical_edges(pages).filter("u is not null").collect())) == sorted((u, want) for u, _, want in RELATIVE if want and u)
    both = pages.unionByName(spark.createDataFrame([(100, "http://ok.org/de/1", "<link rel=canonical href=//www.some.net/>"), (101, "http://ok.org/x", "<meta http-equiv=refresh content='0;url=de/1'>"), (102, "http://free.org/y", "<link rel=canonical href=/z>")], pages.schema))
    c = connect(SF)
    frame = both.toPandas()  # noqa: F841
    c.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM frame")
    from millrace.llm.queries import URL_RULES

    judged = url_filter.judge_urls(both, URL_RULES, url_filter.canonical_edges(both))
    assert_same(judged, SQL["op10_url_filter"], c)
    assert {r["page_id"]: r["verdict"] for r in judged.collect() if r["page_id"] >= 100} == {100: "block", 101: "block", 102: "allow"}


def test_one_address_of_most_pages_and_many_without(spark):
    rows = [(i, "http://a.net/x" if i % 3 == 0 else None if i % 3 == 1 else f"http://free{i}.org/") for i in range(3000)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    edges = spark.createDataFrame([("http://a.net/x", "http://free2.org/")], "u string, v string")
    got = Counter((r["verdict"], r["rule"]) for r in url_filter.judge_urls(table, [("a.net", "/", "block")], edges).collect())
    assert got == {("block", "a.net/"): 1000, ("block", None): 1, ("allow", None): 1999}


def test_url_query_matches_sql(spark):
    from compare import assert_same, connect

    assert_same(QUERIES["op10_url_filter"](spark, SF), SQL["op10_url_filter"], connect(SF))
