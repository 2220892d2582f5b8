"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook, so K centroids a half make K x K cells. A query walks pairs of
centroids by the sum of their squared distances with a heap (the multi-sequence walk) until the cells that it has
passed hold enough entries, and those entries are ranked again by exact distance. Equal vectors are one entry with a
short list of ids, so copies cost nothing. Codebooks are fitted on a bounded sample; every row is indexed. How many
entries a walk must pass for the wanted recall is measured on the whole index: the exact neighbours of some probes are
found in one pass over all rows, and their cells are placed in the probes' walks. Vectors in clusters need few entries,
vectors without structure many, whatever the method.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Saved, shuffle_partitions
from millrace.ship import ship

#: Codebooks are fitted on at most so many distinct vectors, with at least so many of these for each centroid.
SAMPLE, PER_CENTROID = 20_000, 8
#: The recall that walks are measured for, and the number of probes of that measure.
RECALL, PROBES = 0.95, 200
#: A slot, the unit that a task ranks, has about so many entries.
SLOT = 4096
#: Fixed value: an odd multiplier that deals cells over slots.
DEAL = 2654435761


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from k distinct rows; a centroid without rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        near, d = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for i, far in zip(np.flatnonzero(n == 0), np.argsort(-d), strict=False):
            centres[i] = x[far]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, centres)
    i = d.argmin(1)
    return i, d[np.arange(len(x)), i]


def walk(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells i * len(b) + j by ascending a[i] + b[j] until they hold enough entries."""
    by_a, by_b, width = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist(), len(b)
    heap, seen, cells, held = [(a[by_a[0]] + b[by_b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = by_a[i] * width + by_b[j]
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(by_a) and q < len(by_b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[by_a[p]] + b[by_b[q]], p, q))
    return cells


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest_rows(probes: np.ndarray, k: int, dim: int):
    """Task-wise: (probe, dist, cell) of the k + 1 rows nearest to each probe among those of a task."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_c = np.full((len(probes), k + 1), np.inf), np.zeros((len(probes), k + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = np.hstack([best_d, distances(probes, _matrix(part.column(0), dim))])
                cell = np.hstack([best_c, np.broadcast_to(part.column(1).to_numpy(), (len(probes), part.num_rows))])
                keep = np.argpartition(d, k, 1)[:, : k + 1]
                best_d, best_c = np.take_along_axis(d, keep, 1), np.take_along_axis(cell, keep, 1)
        of, at = np.nonzero(np.isfinite(best_d))
        yield pa.record_batch([pa.array(of, pa.int32()), pa.array(best_d[of, at]), pa.array(best_c[of, at])], ["probe", "dist", "cell"])

    return near


def entries_to_walk(index: DataFrame, probes: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray, k: int, recall: float) -> int:
    """Entries that a walk has to pass to meet that part of the k nearest rows of all probes, over the whole index."""
    half = left.shape[1]
    rows = index.select("v", F.col("cell").cast("long")).mapInArrow(_nearest_rows(probes, k, probes.shape[1]), "probe int, dist double, cell long")
    nearest_k = rows.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy("dist", "cell"))).filter(F.col("rank").between(2, k + 1))  # the first is the probe
    passed = []
    for probe, group in nearest_k.select("probe", "cell").toPandas().groupby("probe"):  # at most k rows a probe
        q = probes[probe][None, :]
        sums = (distances(q[:, :half], left)[0][:, None] + distances(q[:, half:], right)[0][None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        held = np.concatenate([[0], np.cumsum(counts[order])])
        passed.extend(held[np.searchsorted(sums[order], sums[group["cell"]], "right")].tolist())
    return int(np.quantile(passed, recall, method="higher")) if passed else int(counts.sum())


@dataclass
class Index:
    """classes: distinct vectors with their ids and cells; left, right: codebooks; counts: entries of each cell; entries: how many a walk passes."""

    classes: Saved
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    entries: int

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]


def _sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def build(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> Index | None:
    """The index of all rows that search() takes for candidates, or None without any.

    Twice the cube root of the number of distinct vectors is the number of centroids a half, as far as the sample goes.
    """
    rows = _sound(vectors, id_col, vector_col)
    widest = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if widest is None:
        return None
    dim, half = widest["dim"], (widest["dim"] + 1) // 2
    # the k + 1 smallest ids of a vector are all that a query can return of it
    first = Window.partitionBy("v").orderBy("id")
    kept = rows.filter(F.size("v") == dim).withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
    classes = Saved(kept.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    n = classes.df.count()
    chosen = classes.df.orderBy(F.xxhash64("v")).limit(sample).select("v").toArrow()
    x = _matrix(chosen.column("v").combine_chunks(), dim)
    size = max(1, min(len(x) // PER_CENTROID, round(2 * n ** (1 / 3))))
    left, right = kmeans(x[:, :half], size), kmeans(x[:, half:], size) if dim > 1 else np.zeros((1, 0))
    books = rows.sparkSession.sparkContext.broadcast((left, right))  # bounded by the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            cell = nearest(m[:, :half], a)[0] * len(b) + nearest(m[:, half:], b)[0]
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    v_kind = dict(classes.df.dtypes)["v"]
    index = Saved(classes.df.mapInArrow(assign, f"v {v_kind}, ids array<long>, cell int"))
    classes.drop()
    counts = np.zeros(len(left) * len(right), np.int64)
    for r in index.df.groupBy("cell").count().collect():  # at most one row a cell
        counts[r["cell"]] = r["count"]
    probes = x[np.linspace(0, len(x) - 1, min(PROBES, len(x)), dtype=np.int64)]
    return Index(index, left, right, counts, entries_to_walk(index.df, probes, left, right, counts, k, recall))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, slot: int = SLOT) -> DataFrame:
    """(query_id, rank, id, score): for each query the k nearest rows found with another id, by Euclidean distance.

    score is the exact distance in double precision; ties go to the smaller id. Vectors that are null, all zero, hold
    null or non-finite components, or are not of the table's most frequent length (the shorter of two) take no part,
    nor do null ids. Repeated rows count once. A query with fewer candidates gets them all; empty tables give no rows;
    other columns are not read.
    """
    spark = ship(vectors.sparkSession)
    index = build(vectors, k, id_col, vector_col, recall, sample)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
    dim, half, entries, n = index.dim, index.left.shape[1], index.entries, int(index.counts.sum())
    asked = _sound(queries, id_col, vector_col).filter(F.size("v") == dim)
    v_kind = dict(asked.dtypes)["v"]
    books, cells = (spark.sparkContext.broadcast(x) for x in ((index.left, index.right), index.counts))
    slots = max(1, -(-n // slot))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each slot that holds cells of a query's walk; a cell over the size of a slot is dealt over several."""
        a, b = books.value
        held = cells.value
        parts = np.maximum(1, -(-held // slot))
        for batch in batches:
            m = _matrix(batch.column(1), dim)
            da, db = distances(m[:, :half], a), distances(m[:, half:], b)
            of, places, lists = [], [], []
            for i in range(len(m)):
                walked = np.array(walk(da[i], db[i], held, entries), np.int64)
                n_parts = parts[walked]
                cell = np.repeat(walked, n_parts)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                place = (cell * DEAL + part) % slots
                for p in np.unique(place).tolist():
                    of.append(i)
                    places.append(p)
                    lists.append(np.unique(cell[place == p]))
            yield pa.record_batch([pa.array(places, pa.int64()), batch.column(0).take(pa.array(of, pa.int64())), batch.column(1).take(pa.array(of, pa.int64())), pa.array(lists, pa.list_(pa.int32()))], ["slot", "query_id", "q", "cells"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with their slots: a cell over the size of a slot is dealt over several by a hash of the vector."""
        parts = np.maximum(1, -(-cells.value // slot)).astype(np.uint64)
        for batch in batches:
            cell = batch.column(2).to_numpy().astype(np.int64)
            part = (batch.column(3).to_numpy().view(np.uint64) % parts[cell]).astype(np.int64)
            yield pa.record_batch([pa.array((cell * DEAL + part) % slots), batch.column(2), batch.column(0), batch.column(1)], ["slot", "cell", "v", "ids"])

    dealt = index.classes.df.select("v", "ids", "cell", F.xxhash64("v")).mapInArrow(place, f"slot long, cell int, v {v_kind}, ids array<long>")
    # walks cost much more than their bytes, so queries are dealt over all tasks rather than gathered by size
    spread = asked.distinct().repartition(shuffle_partitions(spark), "id").select("id", "v")
    sent = spread.mapInArrow(visit, f"slot long, query_id long, q {v_kind}, cells array<int>")

    def rank(of: pa.Table, held: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(of) and len(held):
            m, ids = _matrix(held.column("v").combine_chunks(), dim), held.column("ids").to_pylist()
            cell, q = held.column("cell").to_numpy(), _matrix(of.column("q").combine_chunks(), dim)
            for at, (query, wanted) in enumerate(zip(of.column("query_id").to_pylist(), of.column("cells"), strict=True)):
                mine = np.flatnonzero(np.isin(cell, wanted.values.to_numpy()))
                d = np.sqrt(((m[mine] - q[at]) ** 2).sum(1))
                if len(d) > k + 1:  # the k + 1 nearest entries and all that tie with the last
                    mine, d = mine[d <= np.partition(d, k)[k]], d[d <= np.partition(d, k)[k]]
                found = sorted((dist, x) for dist, i in zip(d.tolist(), mine.tolist(), strict=True) for x in ids[i] if x != query)[:k]
                for dist, x in found:
                    for column, value in zip(out, (query, q[at].tobytes(), dist, x), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.float64(), pa.int64()), strict=True)], ["query_id", "q", "score", "id"])

    ranked = sent.groupBy("slot").cogroup(dealt.groupBy("slot")).applyInArrow(rank, "query_id long, q binary, score double, id long")
    order = Window.partitionBy("query_id", "q").orderBy("score", "id")
    best = ranked.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
