"""Cross-entropy difference of documents under a target and a background language model.

Both are word bigram models of the same form over one shared vocabulary, so their losses are comparable token by
token: P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU), with P(w) from unigram counts plus ADD. A document's score is the
mean over its tokens of the target's loss less the background's; the lower, the more it is like the target.

The vocabulary is all words of both corpora, and neither words nor bigrams are ever gathered in one place. A block of
documents sends one row to each bucket of a 48-bit hash, with its distinct words and bigrams and how often it has them;
the bucket's task adds up the counts of all blocks of both corpora and sends each block the totals of its own entries;
the block's task scores its documents with them. There are as many buckets as the corpora are large, and a very common
word or bigram is one entry a block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Saved, blocks, from_ipc, pack, shuffle_partitions, to_ipc, unpack
from millrace.ship import ship

MU, ADD = 8.0, 0.5
#: A bucket gets the entries of about so many bytes of text.
BUCKET_BYTES = 8_000_000
#: Odd multipliers of a 64-bit hash of two words.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Hashes of words and bigrams have so many bits.
BITS = 48


def _pair_hashes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(FIRST) + w
    x ^= x >> np.uint64(29)
    return x * np.uint64(SECOND) >> np.uint64(64 - BITS)


@dataclass
class Block:
    """Texts as word numbers of their own, one after the other with the mark of the beginning before and that of the end after each."""

    hashes: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Block:
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        each = [np.fromiter(map(number.__getitem__, t.lower().split()), np.int64) for t in texts]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - BITS) for w in number), np.uint64, len(number))
        return cls(hashes, np.concatenate(each), np.array([len(x) for x in each], np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first and second words of all bigrams; a text of n words has n + 1. The marks follow the words."""
        n, begin = len(self.hashes), np.cumsum(self.sizes + 1) - self.sizes - 1
        v, w = (np.empty(len(self.numbers) + len(self.sizes), np.int64) for _ in range(2))
        last = begin + self.sizes
        inside_v, inside_w = np.ones(len(v), bool), np.ones(len(v), bool)
        inside_v[begin], inside_w[last] = False, False
        v[begin], v[inside_v], w[last], w[inside_w] = n, self.numbers, n + 1, self.numbers
        return v, w

    def with_marks(self) -> np.ndarray:
        return np.concatenate([self.hashes, np.array([(1 << BITS) + 1, (1 << BITS) + 2], np.uint64)])


def _halves(hashes: np.ndarray) -> list[np.ndarray]:
    """High and low parts; the high ones of sorted hashes compress to nothing."""
    return [hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)]


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def _send(buckets: int, is_target: bool) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block, a home row (bucket -1) with its ids and texts as numbers, and a row for each bucket of its entries."""
        for number, ids, texts in blocks(batches):
            block = Block.of(texts)
            v, w = block.pairs()
            marked = block.with_marks()
            pairs, of_pair = np.unique(_pair_hashes(marked[v], marked[w]), return_counts=True)
            words, inverse = np.unique(block.hashes, return_inverse=True)
            of_word = np.bincount(inverse, np.bincount(block.numbers, minlength=len(block.hashes)), len(words)).astype(np.int64)
            home = b"" if is_target else pack(np.frombuffer(to_ipc(pa.record_batch([ids], ["id"])), np.uint8), *_halves(block.hashes), block.numbers, block.sizes)
            rows = [(-1, len(texts), len(block.numbers), home)]
            cuts = []
            for hashes in (words, pairs):
                bucket = (hashes >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
                cuts.append(np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)))
            for b in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist():
                some = [x[slice(*c[b : b + 2])] for x, c in ((words, cuts[0]), (of_word, cuts[0]), (pairs, cuts[1]), (of_pair, cuts[1]))]
                rows.append((b, 0, 0, pack(*_halves(some[0]), some[1], *_halves(some[2]), some[3])))
            bucket, n_docs, n_words, data = zip(*rows, strict=True)
            same = [pa.array([x] * len(rows), t) for x, t in ((number, pa.int64()), (is_target, pa.bool_()))]
            yield pa.record_batch([pa.array(bucket, pa.int32()), *same, pa.array(n_docs, pa.int64()), pa.array(n_words, pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "aim", "n_docs", "n_words", "data"])

    return send


def _count(table: pa.Table) -> pa.Table:
    """Totals of a bucket's words and bigrams for each background block that has them, and the number of different words."""
    aims, rows = table.column("aim").to_pylist(), [unpack(x.as_py()) for x in table.column("data")]
    out: list[list[np.ndarray]] = [[] for _ in rows]
    n_words = 0
    for first in (0, 3):
        hashes = [_whole(r[first], r[first + 1]) for r in rows]
        distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
        n_words = n_words or len(distinct)
        ends = np.cumsum([len(h) for h in hashes])
        of = [where[e - len(h) : e] for e, h in zip(ends, hashes, strict=True)]
        totals = [np.zeros(len(distinct), np.int64) for _ in range(2)]
        for aim, mine, r in zip(aims, of, rows, strict=True):
            totals[not aim][mine] += r[first + 2].astype(np.int64)
        for mine, o in zip(of, out, strict=True):
            o += [t[mine] for t in totals]
    kept = [i for i, aim in enumerate(aims) if not aim]
    block = table.column("block").take(pa.array(kept, pa.int64())).to_pylist()
    bucket = table.column("bucket")[0].as_py()
    rows_out = [(bucket, b, 0, pack(*out[i])) for i, b in zip(kept, block, strict=True)] + [(bucket, None, n_words, None)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "n_words", "data"])


@dataclass
class Sizes:
    """Of the target and of the background: words and documents; shared: different words of both."""

    words: tuple[int, int]
    docs: tuple[int, int]
    shared: int


def _score(sizes: Sizes) -> Callable:
    def score(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bucket").to_numpy(), kind="stable")  # the home row is first
        home, *rest = (unpack(table.column("data")[i].as_py()) for i in order.tolist())
        ids = from_ipc(home[0].tobytes()).column("id")
        block = Block(_whole(home[1], home[2]), home[3].astype(np.int64), home[4].astype(np.int64))
        v, w = block.pairs()
        marked = block.with_marks()
        of_pair = np.unique(_pair_hashes(marked[v], marked[w]), return_inverse=True)[1]
        of_word = np.unique(block.hashes, return_inverse=True)[1]
        diff = np.zeros(len(v))
        for i, sign in ((0, 1.0), (1, -1.0)):
            words = np.concatenate([r[i] for r in rest]).astype(np.float64)[of_word] if len(of_word) else np.empty(0)
            words = np.append(words, [sizes.docs[i]] * 2)  # a mark is as frequent as documents are
            prior = (words + ADD) / (sizes.words[i] + sizes.docs[i] + ADD * sizes.shared)
            pairs = np.concatenate([r[2 + i] for r in rest]).astype(np.float64)[of_pair]
            diff -= sign * np.log((pairs + MU * prior[w]) / (words[v] + MU))
        n = block.sizes + 1
        mean = np.add.reduceat(diff, np.cumsum(n) - n) / n
        return pa.table({"id": ids, "n_words": pa.array(block.sizes), "score": pa.array(np.round(mean, 6))})

    return score


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_words, score) of every row of docs, which is also the background corpus; target is the target corpus.

    Counts are taken over all documents of both. The score, rounded to 6 digits, is the mean loss difference in nats
    over the words and the end of the document. A null or empty text has no words and the score of an end alone;
    repeated rows give a row each; an empty target leaves the uniform model; an empty table gives no rows; other
    columns are not read. Blocks are written down before they are counted, so ids and texts of a block stay together
    whatever task is lost and however the input's rows are ordered when it is read again.
    """
    spark = ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    if not buckets:
        n_bytes = sum(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0 for df in (docs, target))
        buckets = max(64, shuffle_partitions(spark), -(-n_bytes // BUCKET_BYTES))
    schema = "bucket int, block long, aim boolean, n_docs long, n_words long, data binary"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_send(buckets, False), schema)
    aims = target.select(F.lit(None).cast(kind).alias("id"), F.col(text_col).alias("text")).mapInArrow(_send(buckets, True), schema)
    sent = Saved(rows.unionAll(aims)).df
    counted = Saved(sent.filter("bucket >= 0").select("bucket", "block", "aim", "data").groupBy("bucket").applyInArrow(_count, "bucket int, block long, n_words long, data binary")).df
    totals = {r["aim"]: r for r in sent.filter("bucket < 0").groupBy("aim").agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).collect()}
    shared = counted.filter("block is null").agg(F.sum("n_words")).first()[0] or 0
    sizes = Sizes(*(tuple(totals[a][c] if a in totals else 0 for a in (True, False)) for c in ("words", "docs")), shared + 1)  # and the end
    found = sent.filter("bucket < 0 and not aim").select("bucket", "block", "data").unionAll(counted.filter("block is not null").select("bucket", "block", "data"))
    return found.groupBy("block").applyInArrow(_score(sizes), f"id {kind}, n_words long, score double").withColumnRenamed("id", id_col)
