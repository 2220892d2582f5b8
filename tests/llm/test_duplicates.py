"""SimHash near-duplicates and Merkle fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import EDGE, SF, documents, prose
from pyspark.sql import functions as F

from millrace.llm import common, merkle, near_copies, simhash
from millrace.llm.components import connected_components
from millrace.llm.queries import QUERIES


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= radius):
            parent[root(int(j))] = root(i)
    least = {}
    for i in range(len(x)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(x))]


def test_near_duplicates_of_edge_cases(spark):
    base = prose(5, 400).split()
    near = [(100 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, 400, 8)]
    rows = EDGE + near
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = list(zip([k for k, _ in rows], fps, slow_components(fps, [k for k, _ in rows]), strict=True))
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(documents(spark, rows).filter("doc_id < 0")).count() == 0


def test_query_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    want = [(k, f"{f:016x}", c) for (k, _), f, c in zip(docs, fps, slow_components(fps, [k for k, _ in docs]), strict=True)]
    assert sorted(map(tuple, QUERIES["op8_simhash_near_dedup"](spark, SF).select("doc_id", "fingerprint", "component_id").collect())) == want


@pytest.mark.parametrize("crowd", [10, 8192])
def test_crowded_entries_lose_no_link(spark, crowd):
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 12, dtype=np.uint64)
    numbers = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in r.choice(64, r.integers(1, 9), replace=False):
                x ^= 1 << int(b)
            numbers.add(x)
    numbers = sorted(numbers)
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in numbers], "fp long")
    parts = {r["node"] % 2**64: r["component"] for r in connected_components(simhash.near_links(table, crowd=crowd)).collect()}
    want = slow_components(numbers, list(range(len(numbers))))
    groups = {}
    for x, w in zip(numbers, want, strict=True):
        groups.setdefault(w, []).append(x)
    for members in groups.values():
        assert len({parts.get(x, x) for x in members}) == 1
    assert len({(parts.get(x), x)[parts.get(x) is None] for x in numbers}) == len(groups)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_pair_within_the_radius_meets_under_a_mask(radius):
    r = np.random.default_rng(1)
    masks = simhash.covering_masks(list(range(64)), radius)
    for _ in range(2000):
        bits = r.choice(64, radius, replace=False)
        assert any(all(not m >> int(b) & 1 for b in bits) for m in masks)


def slow_groups(texts, similarity=0.8):
    """Class numbers of texts by links of shingle sets."""

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = prose(seed * 100 + i, 1)
    return " ".join(words)


#: Bases with near copies of few edits, a text of a third of its words changed, and short texts.
FAMILIES = [(1000 + 10 * f + i, edited(prose(90 + f, 200), n, f * 10 + i)) for f in range(8) for i, n in enumerate((0, 1, 2, 3, 4))] + [(2000, edited(prose(90, 200), 70, 1)), (2001, "a b c"), (2002, "A B c"), (2003, "a b d")]


def test_near_copies_by_brute_force(spark):
    rows = EDGE + FAMILIES
    got = near_copies.near_copy_groups(documents(spark, rows)).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(k) for k, _ in rows)
    by = {}
    for k, g in zip([k for k, _ in rows], slow_groups([t for _, t in rows]), strict=True):
        by.setdefault(g, []).append(k)
    found = {}
    for r in got:
        found.setdefault(r["group"], []).append(r["doc_id"])
    assert sorted(sorted(map(repr, v)) for v in found.values()) == sorted(sorted(map(repr, v)) for v in by.values())
    assert near_copies.near_copy_groups(documents(spark, EDGE).filter("doc_id < 0")).count() == 0


def groups_of(got):
    found = {}
    for r in got:
        found.setdefault(r["group"], []).append(r["doc_id"])
    return sorted(sorted(v) for v in found.values())


def slow_groups_of(rows):
    by = {}
    for (k, _), g in zip(rows, slow_groups([t for _, t in rows]), strict=True):
        by.setdefault(g, []).append(k)
    return sorted(sorted(v) for v in by.values())


def test_near_copies_with_a_stretch_added_or_cut(spark):
    rows = []
    for i in range(120):
        n = (40, 100, 300)[i % 3]
        more = n * (10, 15, 20)[i // 3 % 3] // 100
        rows += [(2 * i, prose(5000 + i, n)), (2 * i + 1, prose(5000 + i, n) + " " + prose(6000 + i, more) if i % 2 else prose(5000 + i, n).rsplit(" ", more)[0])]
    want = slow_groups_of(rows)
    assert len(want) < 200
    assert groups_of(near_copies.near_copy_groups(documents(spark, rows)).collect()) == want


@pytest.mark.parametrize("block", [near_copies.BLOCK_TEXTS, 16])
def test_families_that_touch_are_settled_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", block)
    base = prose(77, 200)
    origins = [base] + [edited(base, 8, 300 + f) for f in range(3)]
    rows = [(100 * f + i, edited(origin, 4 if i else 0, 40000 + 100 * f + i)) for f, origin in enumerate(origins) for i in range(90)]
    assert groups_of(near_copies.near_copy_groups(documents(spark, rows)).collect()) == slow_groups_of(rows)


def test_bands_miss_few_pairs_at_the_threshold():
    r, bands = np.random.default_rng(3), near_copies.bands_for(0.8)
    pool = r.integers(-(2**31), 2**31, (400, 120), np.int64).astype(np.int32)
    one, two = (near_copies.band_keys([np.unique(x[side]) for x in pool], bands) for side in (slice(0, 108), slice(12, 120)))
    agree = (one == two).mean()
    assert abs(agree - 0.8**near_copies.LEAST) < 0.03 and (one == two).any(1).all()


def test_a_large_family_gives_few_pairs():
    r = np.random.default_rng(5)
    base = int(r.integers(0, 2**62))
    group = sorted({base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in r.integers(0, 62, (900, 2))})
    mask = simhash.covering_masks(list(range(64)))[0]
    links = near_copies.neighbours(4).func(pd.Series([group]), pd.Series([np.uint64(mask).view(np.int64)]))[0]
    assert 0 < len(links) <= 5 * len(group)
    assert all(bin(x["u"] ^ x["v"]).count("1") <= 4 and x["u"] > x["v"] for x in links)


def test_one_of_each_keeps_the_first(spark):
    rows = EDGE + FAMILIES + [(50, prose(6)), (40, prose(6)), (None, prose(6))]
    docs = documents(spark, rows)
    kept = near_copies.one_of_each(docs)
    least = {}
    for (k, _), g in zip(rows, slow_groups([t for _, t in rows]), strict=True):
        least[g] = min(least.get(g, 10**6), 10**6 if k is None else k)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((k if k < 10**6 else None for k in least.values()), key=repr)
    assert kept.columns == docs.columns
    assert near_copies.one_of_each(docs.filter("doc_id < 0")).count() == 0


def test_texts_are_shuffled_once_for_the_rows_that_stay(spark):
    docs = documents(spark, EDGE + FAMILIES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_copies.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the rows with their texts, and the keys of those that stay
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


def test_shingles_that_no_pair_asks_for_are_not_shuffled(spark, monkeypatch):
    fetched, join = [], near_copies.join_unique

    def counted(rows, unique, key, *more, **named):
        if "s" in rows.columns:
            fetched.append(rows.count())
        return join(rows, unique, key, *more, **named)

    monkeypatch.setattr(near_copies, "join_unique", counted)
    rows = [(i, prose(3000 + i)) for i in range(400)] + [(1000 + i, edited(prose(90, 200), i, i)) for i in range(4)]
    assert groups_of(near_copies.near_copy_groups(documents(spark, rows)).collect()) == slow_groups_of(rows)
    assert fetched and 4 <= max(fetched) <= 40


def test_a_table_of_hashes_has_all_of_them_and_few_others(spark):
    own = spark.range(3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("h"))
    for most, others in ((common.TABLE_BITS, 3000), (1 << 12, 30_000)):
        passed = {r["id"] for r in rows.filter(common.perhaps_among(own, most)("h")).collect()}
        assert set(range(3000)) <= passed and len(passed) <= 3000 + others
    assert rows.filter(common.perhaps_among(own.filter("false"))("h")).count() == 0


def test_components_of_a_chain_a_star_and_strings(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(5, 5), (None, 3), (7, None), (2, 1), (1, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + noise, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    named = connected_components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "u string, v string"))
    assert {r["node"]: r["component"] for r in named.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_tree(text):
    """(root, [(section digest, [(paragraph digest, length, [(leaf value, length)])])]) by the definition, a character at a time."""

    def branch(parts):
        return hashlib.blake2b(b"".join(parts), digest_size=16, person=b"branch").digest()

    sections, now, above = [], [], []
    lines = text.splitlines(keepends=True)
    for number, line in enumerate(lines, 1):
        leaves, start = [], 0
        for i in range(len(line)):
            h = 0
            for c in line[max(0, i - 3) : i + 1]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            cut = i >= 3 and h * 0x9E3779B1 % 2**32 < 2**32 // 14
            if cut or i + 1 == len(line) or i + 1 - start == 40:
                leaves.append(line[start : i + 1])
                start = i + 1
        digests = [hashlib.blake2b(x.encode("utf-32-le"), digest_size=16).digest() for x in leaves]
        digest = branch(digests)
        now.append((digest, len(line), [(int.from_bytes(d[:4], "big") // 128 * 128 + len(x), len(x)) for d, x in zip(digests, leaves, strict=True)]))
        if number == len(lines) or not line.strip() or digest[-1] % 16 == 0:
            above.append(branch([p[0] for p in now]))
            sections.append((above[-1], now))
            now = []
    return branch(above), sections


def slow_likeness(a, b):
    """Shared length over all length: whole sections, then whole paragraphs, then leaves, pairing off equal ones."""
    if a[0] == b[0]:
        return 1.0

    def pair_off(x, y):
        x, y, shared = list(x), list(y), []
        for item in list(x):
            twin = next((v for v in y if v[0] == item[0]), None)
            if twin is not None:
                x.remove(item)
                y.remove(twin)
                shared.append(item)
        return x, y, shared

    x, y, whole = pair_off(a[1], b[1])
    same = sum(n for _, paragraphs in whole for _, n, _ in paragraphs)
    x, y, whole = pair_off([p for s in x for p in s[1]], [p for s in y for p in s[1]])
    same += sum(n for _, n, _ in whole)
    _, _, whole = pair_off([leaf for p in x for leaf in p[2]], [leaf for p in y for leaf in p[2]])
    same += sum(n for _, n in whole)
    return 2 * same / sum(n for t in (a, b) for s in t[1] for _, n, _ in s[1])


def slow_compare(rows):
    """Expected rows; a fingerprint stands by its root."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = map(slow_tree, (t, edited, after))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), a[0].hex(), b[0].hex(), slow_likeness(a, b), slow_likeness(a, c)))
    return out


def assert_near(got, want):
    """The same rows, and likenesses that are exact unless a text has more leaves than are kept."""
    got = sorted(((*r[:3], r[3].split(":")[0], r[4].split(":")[0], r[5], r[6]) for r in map(tuple, got)), key=repr)
    want = sorted(want, key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    longest = max(r[1] for r in want)
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-8 if longest < 6000 else 0.06)
    assert sum(g[5:] != pytest.approx(w[5:], abs=1e-8) for g, w in zip(got, want, strict=True)) <= len(want) / 4


@pytest.fixture
def whole_sketch(monkeypatch):
    """Every leaf is kept, as in texts of few leaves, so that likeness is exact at any length."""
    monkeypatch.setattr(merkle, "SKETCH", 1 << 30)


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_comparison_with_the_next(spark, buckets):
    for rows in (EDGE, EDGE[:1], [(None, "a"), (None, "b")], [(3, "x")] * 4 + [(4, "y y")]):
        got = merkle.compare_with_next(documents(spark, rows), buckets=buckets).collect()
        assert_near(got, slow_compare(rows))
        assert all(r["fingerprint"] == str(merkle.Tree.of({repr(k): t for k, t in rows}[repr(r["doc_id"])] or "")) for r in got if rows is EDGE and r["doc_id"] is not None)
    assert merkle.compare_with_next(documents(spark, EDGE).filter("doc_id < 0")).count() == 0


def test_merkle_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert_near(QUERIES["op9_merkle_fingerprints"](spark, SF).collect(), slow_compare(docs))


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="must be numbers"):
        merkle.compare_with_next(documents(spark, [("a", "x")], kind="string"))


def test_likeness_by_brute_force(whole_sketch):
    texts = [t or "" for _, t in EDGE] + ["\n".join(prose(i % 7, 9) for i in range(n)) for n in (3, 40, 60)] + [prose(5, 300), prose(5, 290), "a" * 1000, "b\n\n" * 50]
    trees, slow = [merkle.Tree.of(t) for t in texts], [slow_tree(t) for t in texts]
    for a, x in zip(trees, slow, strict=True):
        assert a.root == x[0].hex() and [len(s.paragraphs) for s in a.sections] == [len(p) for _, p in x[1]]
        for b, y in zip(trees, slow, strict=True):
            assert merkle.likeness(a, b) == pytest.approx(slow_likeness(x, y))


def test_samples_of_long_texts_are_bounded_and_near():
    words = prose(1, 40_000).split()
    a, b = " ".join(words), " ".join(words[:30_000] + prose(2, 10_000).split())
    x, y = merkle.Tree.of(a), merkle.Tree.of(b)
    assert len(str(x)) < 8 * merkle.SKETCH < len(a) / 20
    assert abs(merkle.likeness(x, y) - slow_likeness(slow_tree(a), slow_tree(b))) < 0.06


def test_trees_tell_equality_and_place_edits():
    lines = [prose(i, 30) + "." for i in range(50)]
    a = "\n".join(lines)
    b = "\n".join([*lines[:20], "something else entirely.", *lines[21:]])
    x, y = merkle.Tree.of(a), merkle.Tree.of(b)
    assert str(x) == str(merkle.Tree.of(a)) != str(y)
    assert merkle.edits(str(x), str(x)) == []
    places = [(i, j) for i, s in enumerate(x.sections) for j in range(len(s.paragraphs))]
    assert merkle.edits(str(x), str(y)) == [places[20]]
    moved = merkle.Tree.of("\n".join(["a new first line.", *lines]))
    assert len(merkle.edits(str(moved), str(x))) == 1 and merkle.edits(str(x), str(moved)) == []
    assert 0.9 < merkle.likeness(x, y) < 1
    assert merkle.likeness(x, merkle.Tree.of("")) == 0 and merkle.likeness(merkle.Tree.of(""), merkle.Tree.of("")) == 1
    assert str(merkle.Tree.parse(str(y))) == str(y)


@pytest.mark.parametrize("size", [40, 120, 500, 512, 513, 641, 3000])
def test_texts_of_any_two_lengths_have_common_leaves(size):
    text = " ".join(prose(i, 12) + "." for i in range(60))[:size]
    whole = merkle.Tree.of(text)
    for n in (size - 1, size - 4, 3 * size // 4):
        least = (2 * n - 2 * merkle.LONGEST) / (size + n) if size < 300 else 0.6
        assert merkle.likeness(whole, merkle.Tree.of(text[:n])) > max(0.2, least)
    assert merkle.likeness(whole, merkle.Tree.of(text[: size - size // 4] + "q" * (size // 2))) > (0.1 if size < 300 else 0.4)


def test_fingerprints_of_equal_texts_are_equal(spark):
    got = {}
    for r in merkle.fingerprint(documents(spark, EDGE)).collect():
        got.setdefault(r["fingerprint"], []).append(r["doc_id"])
    texts = {}
    for k, t in EDGE:
        texts.setdefault(t or "", []).append(k)
    assert sorted(sorted(map(repr, v)) for v in got.values()) == sorted(sorted(map(repr, v)) for v in texts.values())
