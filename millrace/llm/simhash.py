"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a vector of r + 1 binary digits; each of the 2^(r+1) - 1 masks keeps the bits whose
vector has an odd product with the mask's own. The vectors of r differing bits span at most r dimensions, so some mask
is orthogonal to them all: every pair within radius r agrees on all kept bits of some mask, and meets in its table.
A crowded table entry is covered again over its free bits, which halve each time, so no entry is compared whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Saved, join_unique, shuffle_partitions
from millrace.llm.components import connected_components
from millrace.ship import ship

WORDS, SEED, RADIUS = 4, 42, 4
#: Entries with more fingerprints than this are covered again instead of compared.
CROWD = 8192


def simhash(text: str | None, words: int = WORDS) -> int:
    """The fingerprint, unsigned: a bit is set if it is in over half the shingles' hashes. No words: 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts, stops = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = np.array([simhash(t) for t in part.column(part.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*part.columns[:-1], pa.array(found)], [*part.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keys: list[Column], text_col: str = "text") -> DataFrame:
    """The key columns and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(*keys, F.col(text_col).alias("fp"))
    return rows.mapInArrow(_fingerprints, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bits so that two numbers that differ in at most radius of them agree under some mask.

    Unit vectors come first: with more than radius bits they span all dimensions, and every mask keeps a bit.
    """
    top = 2 ** (radius + 1) - 1
    vectors = sorted(range(1, top + 1), key=lambda x: (x.bit_count() != 1, x))
    vector = {bit: vectors[i % top] for i, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, top + 1)]


def _cover(radius: int):
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, mask, k) for each covering of the free bits of (fp, mask): the wider mask and the bits that it keeps."""
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            fp, mask = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
            for m in np.unique(mask).tolist():
                if m not in known:
                    known[m] = np.array([m | x for x in covering_masks([b for b in range(64) if not m >> b & 1], radius)], np.uint64)
                own = fp[mask == m]
                wider = np.tile(known[m], len(own))
                fps = np.repeat(own, len(known[m]))
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (fps, wider, fps & wider)], ["fp", "mask", "k"])

    return cover


def _spanning(radius: int):
    def links(groups: pd.Series) -> pd.Series:
        """Per entry, (member, least member of its part) for the parts that links within the radius join."""
        out = []
        for group in groups:
            rest, found = np.sort(np.asarray(group, np.int64)), []
            while len(rest) > 1:
                root, front, rest = int(rest[0]), rest[:1], rest[1:]
                while len(front) and len(rest):
                    near = np.zeros(len(rest), bool)
                    for i in range(0, len(front), 256):
                        near |= (np.bitwise_count(front[i : i + 256, None].view(np.uint64) ^ rest[None, :].view(np.uint64)) <= radius).any(0)
                    front, rest = rest[near], rest[~near]
                    found += [{"u": int(x), "v": root} for x in front]
            out.append(found)
        return pd.Series(out)

    return F.pandas_udf(links, "array<struct<u:long,v:long>>")


def near_links(numbers: DataFrame, radius: int = RADIUS, crowd: int = CROWD, within: Callable | None = None) -> DataFrame:
    """Links (u, v) that join the same distinct 64-bit numbers (column fp) as all pairs within the radius would.

    within: a function of an entry's numbers and its mask that gives other links within the entry.
    """
    ship(numbers.sparkSession)
    todo, links = numbers.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        # each row becomes one a mask, so the few bytes that go in are dealt over all tasks
        dealt = todo.repartition(shuffle_partitions(numbers.sparkSession), "fp")
        keyed = dealt.mapInArrow(_cover(radius), "fp long, mask long, k long")
        sizes = Saved(keyed.groupBy("mask", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1")).df
        pairs = sizes.filter("n = 2").filter(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        many = join_unique(keyed, sizes.filter("n > 2").select("mask", "k", "lo", "n", F.col("n").alias("size")), ["mask", "k"]).withColumnRenamed("size", "n")
        close = F.bit_count(F.bitwise_not("mask")) <= radius
        alike = many.filter(close).select(F.col("fp").alias("u"), F.col("lo").alias("v"))
        few = many.filter(~close & (F.col("n") <= crowd)).groupBy("mask", "k").agg(F.collect_list("fp").alias("group"))
        inside = _spanning(radius)("group") if within is None else within("group", "mask")
        spanned = few.select(F.explode(inside).alias("l")).select("l.u", "l.v")
        found = pairs.unionAll(alike).unionAll(spanned)
        links = found if links is None else links.unionAll(found)
        if sizes.filter((F.col("n") > crowd) & ~close).isEmpty():
            return links.filter("u != v").distinct()
        todo = many.filter(~close & (F.col("n") > crowd)).select("fp", "mask").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(id, fp, component) of every row: its fingerprint and the least id reachable over links within the radius.

    Texts that are null, empty or blank have fingerprint 0 and are linked like any other; texts of fewer words than a
    shingle are one shingle. Repeated rows give a row each. A null id belongs to its component but never names it. An
    empty table gives no rows; other columns are not read.
    """
    rows = Saved(fingerprints(docs, [F.col(id_col).alias("id")], text_col)).df
    least = Saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))).df
    parts = connected_components(near_links(least.select("fp"), radius, crowd)).select(F.col("node").alias("fp"), "component")
    named = Saved(least.join(parts, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("part"))).df
    names = Saved(named.groupBy("part").agg(F.min("least").alias("component"), F.count("*").alias("n"))).df
    of_print = Saved(join_unique(named.withColumnRenamed("n", "rows"), names, ["part"]).select("fp", "component", F.col("rows").alias("n"))).df
    return join_unique(rows, of_print, ["fp"]).select(F.col("id").alias(id_col), "fp", "component")
