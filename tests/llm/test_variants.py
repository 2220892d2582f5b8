from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import EDGE, SF, documents

from millrace.llm.queries import op13_spelling_variants
from millrace.llm.variants import MANGLED, near_words, spelling_variants


def one_edit(a, b):
    """By trying every edit."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows, mangled):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if mangled and h % mangled == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(rows, mangled, words=None):
    words = brute_words(rows, mangled)
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for n in (len(w), len(w) + 1):
            for o in by_length.get(n, []):
                if (n > len(w) or o > w) and one_edit(w, o):
                    near[w].append(o)
                    near[o].append(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def family(seed, n_words=60):
    """Texts of words with chains of ever rarer variants, upper and lower case, letters beyond ASCII."""
    r = random.Random(seed)
    letters = "abcdeABé×ÿÀ"
    bag = []
    for _ in range(n_words):
        word, n = "".join(r.choice(letters) for _ in range(r.randint(5, 9))), 700
        while n >= 4:
            bag += [word] * n
            at, kind = r.randrange(len(word)), r.randrange(3)
            word, n = word[:at] + ("" if kind == 0 else r.choice(letters)) + word[at + (kind != 1) :], n // r.choice([3, 5, 6])
    r.shuffle(bag)
    return [(i, " ".join(bag[i::50])) for i in range(50)]


@pytest.mark.parametrize("crowd", [2, 48])
def test_families_match_brute_force(spark, crowd):
    rows = family(1) + [(None, "étéete " * 7), (None, None), (50, "")]
    for mangled in (None, 7):
        assert rows_of(spelling_variants(documents(spark, rows), mangled=mangled, crowd=crowd)) == brute(rows, mangled)


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_pairs_match_brute_force(spark, crowd):
    """Repeated letters, where an insertion has many places; very short and very long words; crowded starts and ends."""
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(200)} | {"a" * n for n in range(1, 12)}
    if crowd > 1:
        words |= {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499, "x" * 1500 + "y" + "x" * 1500}
    words |= {"start" + c + d for c in "abcdefgh" for d in "ab"} | {c + d + "ending" for c in "abcdefgh" for d in ("", "q")} | {"überü", "überû", "überu"}
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = [tuple(x) for x in near_words(table, crowd).select("word", "near").collect()]
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_edge_cases(spark):
    rows = EDGE + [(i, "Wording wordings WORDING naïveté naïvete") for i in range(40)]
    assert rows_of(spelling_variants(documents(spark, rows), mangled=MANGLED)) == brute(rows, MANGLED)
    empty = documents(spark, [(1, "x")]).filter("doc_id = 2")
    assert spelling_variants(empty).count() == 0
    assert spelling_variants(documents(spark, [(1, "short"), (2, None)])).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(empty, times=1)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op13_spelling_variants(spark, SF))
    assert got == brute(rows, MANGLED) and any(f for _, f, *_ in got)


def test_no_crowded_entry_is_held_against_itself(spark):
    """All words share a start, so the first index has one entry for it."""
    words = [("prefix" + "".join(random.Random(i).choices("abcdefghij", k=8)), 5) for i in range(3000)]
    table = spark.createDataFrame(words, "word string, n long")
    texts = {w for w, _ in words}
    want = {(a, b) for a in texts for i in range(len(a)) for c in "abcdefghij" if (b := a[:i] + c + a[i + 1 :]) in texts and b != a}
    assert {tuple(x) for x in near_words(table, 16).select("word", "near").collect()} == want
