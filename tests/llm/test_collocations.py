from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import assert_same, connect
from helpers import EDGE, SF, documents

from millrace.llm import collocations as module
from millrace.llm.collocations import bit_table, collocations
from millrace.llm.queries import QUERIES, SQL


def brute(rows, max_words=3, min_count=10, within=50, top=2000):
    """Counts of all phrases of each group, without levels."""
    counts, totals = Counter(), Counter()
    for group, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[group or "und"] += len(words)
            for k in range(1, max_words + 1):
                counts.update((group or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= min_count}
    out = []
    for (g, p), a in found.items():
        score, k = min((10**6 * a * a // (counts[g, p[:k]] * counts[g, p[k:]]), k) for k in range(1, len(p)))
        held = any(h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= within * a for (h, q), b in found.items())
        if not held:
            out.append((g, " ".join(p), a, counts[g, p[:k]], counts[g, p[k:]], totals[g], score))
    ranked = []
    for g in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == g), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(g, i, *x[1:]) for i, x in enumerate(best, 1)]
    return sorted(ranked)


def table(spark, rows):
    docs = documents(spark, list(enumerate(t for _, t in rows)))
    langs = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "doc_id long, own string")
    return docs.join(langs, "doc_id")


def texts(seed, n=60):
    r = random.Random(seed)
    words = "the a of Big big red fox dog ran far é 漢字 x\x85y   -".split(" ")
    out = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(r.randint(0, 60)))) for _ in range(n)]
    out += [("de", "red fox ran. big dog ran, red fox: " * 9), ("en", "the big red fox; " * 12 + "the red dog of far, " * 11)]
    return out + [(g, t) for g, (_, t) in zip(["en", None, "und"], EDGE, strict=False)] + [("en", None), ("en", "a a a a a a a a a a a a a"), ("solo", "one two")]


def run(spark, rows, **options):
    got = collocations(table(spark, rows), group_col="own", **options)
    assert got.columns == ["own", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"max_words": 2, "min_count": 3, "top": 5}, {"max_words": 5, "min_count": 4, "within": 80, "top": None}, {"block": 40, "min_count": 6}])
def test_matches_brute_force(spark, options):
    rows = texts(1)
    want = brute(rows, **{k: v if v is not None or k != "top" else 10**9 for k, v in options.items() if k != "block"})
    assert run(spark, rows, **options) == want and want


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    """Where every bit is set no phrase is left out before it is counted, and the rows are the same."""
    monkeypatch.setattr(module, "bit_table", lambda phrases: np.full(8, -1, np.int64).tobytes())
    rows = texts(2)
    assert run(spark, rows, min_count=5) == brute(rows, min_count=5)


def test_bit_table_is_bounded_and_holds_every_phrase(spark):
    phrases = spark.range(5000).selectExpr("'g' as g", "concat('w', id, ' x') as phrase")
    data = bit_table(phrases, most=1 << 12)
    assert len(data) == 512
    from millrace.llm.collocations import Words

    tables = [np.full(8, 2**64 - 1, np.uint64), np.frombuffer(bit_table(phrases), np.uint64)]
    words = Words(b"w17 x\xffw4999 x y\xffno x y\xffw5 x w6 x")
    assert len(words.starts("g", 2, tables)) == 8  # all pairs within pieces, as all words are frequent
    every = sum(len(words.starts("g", 3, [tables[0], t])) for t in (np.full(8, 2**64 - 1, np.uint64), tables[1]))
    assert every < 2 * 4  # fewer than where all pairs are frequent


def test_exact_beyond_64_bits(spark):
    """The products are worked out in decimals of 38 digits."""
    from pyspark.sql import functions as F

    a = 99_999_999_999_999
    whole = lambda x: F.lit(x).cast("decimal(14,0)")
    got = spark.range(1).select(F.call_function("div", F.lit(10**6).cast("decimal(7,0)") * whole(a) * whole(a - 1), whole(a) * whole(a)).alias("x")).first().x
    assert got == 10**6 * a * (a - 1) // (a * a)


def test_empty_and_wrong(spark):
    none = table(spark, [("en", "a b")]).filter("doc_id = 5")
    assert collocations(none, group_col="own").count() == 0
    assert run(spark, [("en", None), (None, "")]) == []
    with pytest.raises(ValueError):
        collocations(none, max_words=1)


def test_query_matches_sql(spark):
    assert assert_same(QUERIES["op11_collocations"](spark, SF), SQL["op11_collocations"], connect(SF)) > 0
