"""Quality classifier, language-model scores and nearest neighbours."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, SF, documents, prose

from millrace.llm import ann, lm_scoring, quality
from millrace.llm.common import unpack
from millrace.llm.queries import QUERIES

SF_MORE = "/root/testdata/sf0.01"


def test_held_out_labels_are_told(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_classifier"](spark, SF_MORE).collect()
    assert len(rows) == spark.read.parquet(f"{SF_MORE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    told = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in told if y == 1], [s for s, y in told if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.85 and np.mean([s >= 0.3 for s in good]) > 0.95  # a few hundred training rows


def test_held_out_labels_do_not_reach_the_model(spark):
    """Labels of held-out rows are turned round; no score changes."""
    from pyspark.sql import functions as F

    from millrace.llm.queries import held_out

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x.filter(~held_out())) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)


@pytest.fixture(scope="module")
def model():
    texts = [prose(i, 30) for i in range(40)] + [f"spam {prose(i, 5)} buy now buy now" for i in range(40)]
    features = quality.Features()
    return quality.train([quality.bag_of(features, t) for t in texts], [1] * 40 + [0] * 40)


def test_scores_of_edge_cases(spark, model):
    docs = documents(spark, EDGE)
    scored = quality.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = sorted((repr(r["doc_id"]), repr(r["text"]), round(r["score"], 9)) for r in scored.collect())
    alone = [float(model.probabilities(quality.Features(), [t])[0, 1]) for _, t in EDGE]
    assert got == sorted((repr(k), repr(t), round(s, 9)) for (k, t), s in zip(EDGE, alone, strict=True))
    empty = [s for (_, t), s in zip(EDGE, alone, strict=True) if not (t or "").strip()]
    assert len(set(empty)) == 1
    assert quality.score(docs.filter("doc_id < 0"), model).count() == 0


def test_whole_text_counts(model):
    features = quality.Features()
    clean = prose(3, 200_000)  # over two pieces
    end = clean + " spam buy now buy now" * 20_000
    a, b = model.probabilities(features, [clean, end])[:, 1]
    assert a > b


def slow_features(text, bits):
    """Feature ids one by one: words and pairs of words, six times each, and 3 characters of words with a space at either end."""

    def id_of(value, kind):
        return (value + 2 * kind + 1) * quality.MIX % 2**64 >> (64 - bits)

    def polynomial(part):
        return sum((ord(c) + 7) * pow(quality.BASE, i, 2**64) for i, c in enumerate(part)) % 2**64

    words = (text or "").lower().split()
    out = [id_of(polynomial(w), 0) for w in words] + [id_of((polynomial(a) * quality.BASE + polynomial(b)) % 2**64, 1) for a, b in zip(words, words[1:])]  # noqa: B905
    out *= quality.WORD_WEIGHT
    for n in quality.GRAMS:
        out += [id_of(polynomial(p[i : i + n]), n) for p in (f" {w} " for w in words) for i in range(len(p) - n + 1)]
    return out


@pytest.mark.parametrize("piece", [quality.PIECE, 500, 7])
def test_features_by_brute_force(monkeypatch, piece):
    """However a text is cut; words longer than a piece are whole."""
    features = quality.Features(12)
    texts = [t for _, t in EDGE] + [prose(9, 300), "a a a b b", "w" * 900 + " " + "w" * 900 + " x"]
    want = [sorted(slow_features(t, 12)) for t in texts]
    monkeypatch.setattr(quality, "PIECE", piece)
    assert [sorted(features.bag(t).tolist()) for t in texts] == want
    weights = np.random.default_rng(1).normal(size=(1 << 12, 2))
    sums, number = features.sums(texts, weights)
    assert number.tolist() == [len(w) for w in want]
    assert np.allclose(sums, [weights[w].sum(0) for w in want])


def test_training_and_scores_by_brute_force():
    """Plain loops over documents, features and dimensions."""
    dim, bits, epochs, rate = 3, 8, 4, 0.5
    texts = [prose(i, 12) for i in range(10)] + [prose(i, 6) + " buy now now" for i in range(10)] + ["", None]
    labels = [1] * 10 + [0] * 10 + [0, 1]
    features = quality.Features(bits)
    model = quality.train([quality.bag_of(features, t) for t in texts], labels, dim, bits, epochs, rate, seed=5)
    rng = np.random.default_rng(5)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32).astype(float).tolist()
    out, bias, done = [[0.0] * 2 for _ in range(dim)], [0.0, 0.0], 0

    def predict(counts):
        n = sum(counts.values()) + quality.CALM
        hidden = [sum(k / n * table[f][d] for f, k in counts.items()) for d in range(dim)]
        logits = [sum(hidden[d] * out[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
        e = [math.exp(x) for x in logits]
        return hidden, [x / sum(e) for x in e], n

    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            counts = Counter(slow_features(texts[i], bits))
            step = rate * (1 - done / (epochs * len(texts)))
            done += 1
            hidden, p, n = predict(counts)
            p[labels[i]] -= 1
            back = [sum(out[d][c] * p[c] for c in (0, 1)) for d in range(dim)]
            for c in (0, 1):
                bias[c] -= 0.1 * step * p[c]
                for d in range(dim):
                    out[d][c] -= step * hidden[d] * p[c]
            for f, k in counts.items():
                for d in range(dim):
                    table[f][d] -= step * math.sqrt(len(counts)) * k / n * back[d]
    want = [predict(Counter(slow_features(t, bits)))[1] for t in texts]
    assert np.allclose(model.probabilities(features, texts), want, atol=1e-4)


def test_models_of_no_and_of_one_class(spark):
    docs = documents(spark, EDGE[:4])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, one), label=7).collect()} == {0.0}


def test_training_sample_is_bounded_and_fixed(spark):
    """At most so many rows, the same whatever the order of rows, of whole texts however long; of a repeated id one row."""
    rows = [(i, "x " * (1 + i * i)) for i in range(60)] + [(3, "other"), (3, None), (4, "more")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = [quality.training_sample(documents(spark, r, parts=p), labels, "quality", "doc_id", "text", rows=20) for r, p in ((rows, 3), (rows[::-1], 5))]
    assert len(got[0][0]) == len(got[0][1]) == 20 and got[0][1] == got[1][1]
    assert got[0][0] == got[1][0]
    whole = quality.training_sample(documents(spark, rows), labels, "quality", "doc_id", "text")
    assert len(whole[0]) == 60 and max(int(unpack(b)[1].sum()) for b in whole[0]) > 3481


END = object()


def slow_difference(rows, aims):
    """Cross-entropy difference by dictionaries of words."""

    def ids(text):
        return (text or "").lower().split()

    def counts(texts):
        one, two = Counter(), Counter()
        for t in texts:
            own = ids(t)
            one.update([*own, END])
            two.update(zip([END, *own], [*own, END], strict=True))
        return one, two

    target, background = counts(aims), counts([t for _, t in rows])
    shared = len(set(target[0]) | set(background[0]))

    def loss(model, v, w):
        one, two = model
        prior = (one[w] + lm_scoring.ADD) / (sum(one.values()) + lm_scoring.ADD * shared)
        return -math.log((two[v, w] + lm_scoring.MU * prior) / (one[v] + lm_scoring.MU))

    out = []
    for k, t in rows:
        own = ids(t)
        pairs = list(zip([END, *own], [*own, END], strict=True))
        out.append((k, len(own), sum(loss(target, *p) - loss(background, *p) for p in pairs) / len(pairs)))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 8, 500, None])
def test_scores_by_brute_force(spark, buckets):
    """Whatever the number of buckets; END in the texts is no mark."""
    rows = EDGE + [(20 + i, prose(i % 4) + " the cat") for i in range(12)]
    aims = [prose(1, 50), "the cat sat", None, "", "the cat sat END"]
    got = lm_scoring.cross_entropy_difference(documents(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id long, text string"), buckets=buckets).collect()
    want = sorted(slow_difference(rows, aims), key=repr)
    got = sorted(map(tuple, got), key=repr)
    by = lambda r: (repr(r[0]), r[1], round(r[2], 2))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 2e-6


def test_scores_of_no_documents_and_of_no_target(spark):
    docs, none = documents(spark, EDGE), spark.createDataFrame([], "item_id long, text string")
    assert lm_scoring.cross_entropy_difference(docs.filter("doc_id < 0"), none).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, none).count() == len(EDGE)


def test_documents_like_the_target_score_lower(spark):
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op2_lm_scoring"](spark, SF).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quoting = [k for k, t in docs.items() if any(i[:60] in t for i in items)]
    assert len(scores) == len(docs)
    if quoting:
        rest = [scores[k] for k in docs if k not in quoting]
        assert np.mean([scores[k] for k in quoting]) < np.mean(rest)


def slow_search(rows, queries, k):
    def sound(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)

    fine = {(i, tuple(v)) for i, v in rows if i is not None and sound(v)}
    out = []
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and sound(v)}:
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in fine if i != q)
        out += [(q, r + 1, i, round(x, 9)) for r, (x, i) in enumerate(d[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, q string").repartition(3)


def test_search_of_edge_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=4)]) for i in range(30)]
    rows += [(40 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(15)]  # ties beyond k
    rows += [(50 + 7, None), (58, [0.0] * 4), (59, [1.0, None, 2.0, 3.0]), (60, [float("nan"), 1.0, 1.0, 1.0]), (61, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), rows[0], (62, [])]
    table = vectors(spark, rows)
    asked = [x for x in rows if x[0] is not None and x[0] % 5 == 0 or x[0] in (57, 58, 60)]
    got = ann.search(table, vectors(spark, asked), k=10, recall=1.0).collect()
    assert sorted((a, b, c, round(d, 9)) for a, b, c, d in got) == slow_search(rows, asked, 10)
    assert ann.search(table, table.filter("vec_id < 0")).count() == 0
    assert ann.search(table.filter("vec_id < 0"), table).count() == 0


def test_queries_with_few_candidates_get_all(spark):
    table = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    got = ann.search(table, table.filter("vec_id = 1")).collect()
    assert [tuple(r)[:3] for r in sorted(got)] == [(1, 1, 2), (1, 2, 3)] or [tuple(r)[:3] for r in sorted(got)] == [(1, 1, 3), (1, 2, 2)]
    one = vectors(spark, [(1, [2.0]), (2, [5.0])])
    assert [tuple(r) for r in ann.search(one, one.filter("vec_id = 1")).collect()] == [(1, 1, 2, 3.0)]


@pytest.mark.parametrize("slot", [4096, 16])
def test_recall_against_brute_force(spark, slot):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = [x for x in rows if x[0] % 20 == 0]
    got = ann.search(table, table.filter("vec_id % 20 = 0"), slot=slot).collect()
    want = slow_search(rows, asked, 10)
    found = {(a, c) for a, _, c, _ in got}
    assert np.mean([(a, c) in found for a, _, c, _ in want]) >= 0.9
    exact = {(a, c): d for a, _, c, d in slow_search(rows, asked, len(rows))}
    assert all(abs(exact[a, c] - d) < 1e-9 for a, _, c, d in got)


def test_walk_is_in_order_of_summed_distance():
    r = np.random.default_rng(2)
    a, b, sizes = r.random(9), r.random(7), r.integers(0, 3, 63)
    cells = ann.walk(a, b, sizes, int(sizes.sum()))
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(sizes).tolist()


def exact_ids(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [i for i in np.lexsort((ids, d)) if i != q][:k]


@pytest.mark.parametrize(("kind", "most"), [("clusters", 0.1), ("one cloud", 0.9)])
def test_recall_of_walks_that_pass_a_part(spark, kind, most):
    """20,000 vectors in 200 clusters, and as many without clusters: walks pass a part of the entries and find nearly all neighbours."""
    r = np.random.default_rng(3)
    n, dim = 20_000, 16
    x = r.normal(size=(200, dim))[r.integers(0, 200, n)] * 3 + r.normal(size=(n, dim)) * 0.3 if kind == "clusters" else r.normal(size=(n, dim))
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()})).repartition(8)
    index = ann.build(table)
    assert index.entries < most * n and len(index.left) > 40
    index.classes.drop()
    got = {}
    for row in ann.search(table, table.filter("vec_id % 200 = 0")).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row
    assert len(got) == n // 200
    hits = 0
    for q, rows in got.items():
        assert sorted(rows) == list(range(1, 11)) and [rows[i]["score"] for i in range(1, 11)] == sorted(rows[i]["score"] for i in range(1, 11))
        hits += len({v["vec_id"] for v in rows.values()} & set(exact_ids(x, np.arange(n), q, 10)))
    print(kind, "entries", index.entries, "recall", hits / 10 / len(got))
    assert hits / 10 / len(got) >= 0.9
