"""Quality classifier of supervised subword embeddings.

Words, pairs of words next to each other and the character n-grams of words, ends included, all in lower case, are hashed to
rows of one embedding table. A document is the weighted mean of its rows, in which a word or pair counts WORD_WEIGHT times
as much as a character n-gram, a softmax layer turns that into class probabilities, and both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. The layer is linear, so a trained model is folded into
one number for each row and class, and scoring sums gathered numbers over a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pack, unpack
from millrace.ship import ship

BITS, DIM = 17, 16
#: Lengths of character n-grams.
GRAMS = (3,)
#: Of words and pairs of words; character n-grams weigh 1.
WORD_WEIGHT = 6
#: The sample: at most so many labelled rows, whatever the length of their texts.
TRAIN_ROWS = 4000
EPOCHS, RATE = 12, 2.0
#: So many features without weight are added to each text: a few words alone don't decide.
CALM = 16
#: Odd multipliers of a 64-bit multiplicative hash and a prime base for polynomial hashes.
MIX, BASE = 0x9E3779B97F4A7C15, 0x100000001B3
#: A text is scored in pieces of so many code points, or of one longer word.
PIECE = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Features:
    """Hashed feature ids of texts, by prefix hashes over code points; arithmetic is modulo 2^64."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift, self.up, self.down = np.uint64(64 - bits), *_powers(PIECE + 64)

    def _reach(self, n: int) -> None:
        """Powers for n code points: more than usual where a word is longer than a piece."""
        if n > len(self.up):
            self.up, self.down = _powers(n)

    def _ids(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        return (((hashes + np.uint64(kind * 2 + 1)) * np.uint64(MIX)) >> self.shift).astype(np.int32)

    def _of(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(positions, ids, weight) of features in code points that begin and end with a space."""
        n = len(codes)
        self._reach(n)
        space = codes == 32
        gaps = np.cumsum(space, dtype=np.int32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * self.up[:n], dtype=np.uint64)])
        starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        words = (sums[ends] - sums[starts]) * self.down[starts]
        yield starts, self._ids(words, 0), WORD_WEIGHT
        next_to = np.flatnonzero(starts[1:] - ends[:-1] == 1) + 1  # texts and pieces are two spaces apart
        yield starts[next_to], self._ids(words[next_to - 1] * np.uint64(BASE) + words[next_to], 1), WORD_WEIGHT
        for size in GRAMS:
            if n >= size:
                # a space may only be the first or last character of an n-gram
                inner = gaps[size - 2 : n - 1] - gaps[: n - size + 1]
                at = np.flatnonzero(inner == 0)
                yield at, self._ids((sums[at + size] - sums[at]) * self.down[at], size), 1

    def pieces(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """The lower-case text's code points with every run of white space as one space, in pieces cut at spaces.

        A piece begins with the last word of the piece before, which makes a pair with its first own word; features
        from the given position on are the piece's own. A word longer than a piece is a piece.
        """
        codes = np.frombuffer(" ".join(["", *(text or "").lower().split(), ""]).encode("utf-32-le"), np.uint32)
        spaces = np.flatnonzero(codes == 32)
        last, before = 0, 0  # numbers of the space that the piece begins with, and of the one before
        while last < len(spaces) - 1:
            end = max(last + 1, int(np.searchsorted(spaces, spaces[last] + PIECE, "right")) - 1)
            yield int(spaces[last] - spaces[before]), codes[spaces[before] : spaces[end] + 1]
            last, before = end, end - 1

    def bag(self, text: str | None) -> np.ndarray:
        """Feature ids, each as often as it weighs."""
        found = [np.repeat(ids[at >= own], weight) for own, codes in self.pieces(text) for at, ids, weight in self._of(codes)]
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def sums(self, texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the weighted sum of its features' rows of the table and the sum of their weights."""
        total, number = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
        group: list[np.ndarray] = []
        owners: list[int] = []
        skipped: list[int] = []

        def flush() -> None:
            if group:
                codes = np.concatenate(group)
                bounds = np.cumsum([0, *map(len, group)])
                first = bounds[:-1] + np.asarray(skipped)
                for at, ids, weight in self._of(codes):
                    part = np.searchsorted(bounds, at, "right") - 1
                    if any(skipped):
                        mine = at >= first[part]
                        part, ids = part[mine], ids[mine]
                    own = np.asarray(owners)[part]
                    number[:] += weight * np.bincount(own, minlength=len(texts))
                    for c in range(weights.shape[1]):
                        total[:, c] += weight * np.bincount(own, weights[ids, c], len(texts))
                for held in (group, owners, skipped):
                    held.clear()

        size = 0
        for i, text in enumerate(texts):
            for skip, codes in self.pieces(text):
                if size + len(codes) > PIECE:
                    flush()
                    size = 0
                group.append(codes)
                owners.append(i)
                skipped.append(skip)
                size += len(codes)
        flush()
        return total, number


@dataclass
class Model:
    """classes in order; weights: log-odds parts of each hashed row and class; bias: of each class."""

    classes: list[int]
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, features: Features, texts: list[str | None]) -> np.ndarray:
        total, number = features.sums(texts, self.weights)
        logits = total / (number + CALM)[:, None] + self.bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def bag_of(features: Features, text: str | None) -> bytes:
    """Distinct feature ids of a text, as steps from each to the next, and their counts, packed."""
    ids, counts = np.unique(features.bag(text), return_counts=True)
    return pack(np.diff(ids, prepend=np.int32(0)), counts)


def train(bags: Sequence[bytes], labels: list[int], dim: int = DIM, bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """Stochastic gradient descent over shuffled documents, given by their bags; the rate falls to nothing. One class alone is certain.

    Bags stay packed but for the one in use, which bounds the driver's memory.
    """
    classes, y = np.unique(np.asarray(labels, np.int64), return_inverse=True)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    if not len(classes):
        return Model([], np.zeros((1 << bits, 1), np.float32), np.zeros(1, np.float32))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            steps_between, counts = unpack(bags[i])
            ids = np.cumsum(steps_between, dtype=np.int64)
            step = rate * (1 - done / steps)
            done += 1
            share = (counts / (counts.sum() + CALM)).astype(np.float32)
            rows = table[ids]
            hidden = share @ rows
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            table[ids] = rows - (step * len(ids) ** 0.5) * share[:, None] * back
    return Model(classes.tolist(), table @ out, bias)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            data = [bag_of(features, t) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.record_batch([*part.columns[:-1], pa.array(data, pa.binary())], [*part.schema.names[:-1], "bag"])


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> tuple[list[bytes], list[int]]:
    """Bags and labels of the labelled rows that come first by a hash of their id, at most so many.

    The labels are ranked alone, so only the chosen ids, bounded by rows, meet the documents; whole texts become bags
    where they are, and a bag has at most 2 ** BITS ids whatever the text. Of labels and of texts that repeat an id
    the least counts, of texts by a hash.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", F.xxhash64("text").alias("h"), "text")
    kinds = ", ".join(f"{c} {t}" for c, t in own.dtypes[:-1])
    bags = own.mapInArrow(_bags, f"{kinds}, bag binary").groupBy("id").agg(F.min(F.struct("h", "label", "bag")).alias("first"))
    found = bags.orderBy("id").select("first.label", "first.bag").toArrow()
    return found.column("bag").to_pylist(), found.column("label").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labels, from at most rows labelled rows. A null text is an empty one."""
    return train(*training_sample(docs, labels, label_col, id_col, text_col, rows))


def score(docs: DataFrame, model: Model, label: int = 1, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns of docs and score, the probability of the label for the whole text, in place of any such column.

    A null or empty text gets the model's bias alone; a model without classes gives 0.5; an unknown label gives 0. Rows
    stay as they are, repeated or not.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c.lower() != score_col.lower()], F.col(text_col).alias(score_col))

    def probability(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = sent.value, Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if not model.classes:
                    found = np.full(part.num_rows, 0.5)
                elif label not in model.classes:
                    found = np.zeros(part.num_rows)
                else:
                    found = model.probabilities(features, part.column(part.num_columns - 1).to_pylist())[:, model.classes.index(label)]
                yield pa.record_batch([*part.columns[:-1], pa.array(found, pa.float64())], part.schema.names)

    return rows.mapInArrow(probability, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + f", `{score_col}` double")
