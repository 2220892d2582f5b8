"""Phrase collocations by level-wise passes over the texts, as in the Apriori algorithm.

Level k counts phrases of k words. From level 2 on, a pass emits a phrase only where both of its overlapping parts of
k - 1 words are frequent, as it learns from a broadcast bit table of their hashes; a part that is taken for frequent by
a shared bit costs a counted phrase and changes nothing, as counts are exact and a frequent phrase has frequent parts
only. The bit table has TABLE_BITS bits at most, however many frequent phrases there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Saved
from millrace.ship import ship

#: Most bits of a table of frequent phrases: 16 MB.
TABLE_BITS = 1 << 27
#: Characters that end a piece, and those between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: 0xFF is in no UTF-8 text, so it stands for the end of a piece.
_PLAIN = bytes(0xFF if c in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\xff"
#: Texts are counted together up to about so many bytes, and one longer text in stretches that end with a piece.
BLOCK = 4_000_000
SEED = 42


def _stretches(text: bytes, size: int) -> Iterator[bytes]:
    """A text in stretches of about size bytes that end where a piece ends."""
    at = 0
    while len(text) - at > size:
        cut = text.find(END, at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _by_group(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(group, text) with the texts of a group joined to about size bytes, pieces ended by END."""
    for batch in batches:
        held: dict[str, list[bytes]] = defaultdict(list)
        n: dict[str, int] = defaultdict(int)
        for i in range(batch.num_rows):
            group, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for part in _stretches(text.encode().translate(_PLAIN), size):
                held[group].append(part)
                n[group] += len(part)
                if n[group] >= size:
                    yield group, END.join(held.pop(group))
                    n[group] = 0
        for group, parts in held.items():
            yield group, END.join(parts)


class Words:
    """The words of a stretch: at has their numbers from 1 in order, 0 where a piece ends, and names what they are."""

    def __init__(self, text: bytes) -> None:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[END]
        parts = text.replace(END, b" \xff ").split()
        self.at = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        self.names = list(number)

    def starts(self, group: str, k: int, tables: list[np.ndarray]) -> np.ndarray:
        """Where phrases of k words begin whose parts of k - 1 words are frequent, as their own parts are."""
        own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.names), np.uint64, len(self.names))[self.at]
        runs, hashes = self.at != 0, np.full(len(own), xxhash.xxh64_intdigest(group.encode(), SEED), np.uint64)
        for level in range(1, k):
            n = max(0, len(own) - level + 1)
            hashes = (hashes[:n] << np.uint64(1) | hashes[:n] >> np.uint64(63)) ^ own[level - 1 :]
            runs = runs[:n] & _frequent(hashes, tables[level - 1])
            runs = runs[:-1] & runs[1:]
        return np.flatnonzero(runs)

    def counts(self, starts: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """The different phrases of k words that begin there, and how often each does."""
        keys, most = self.at[starts], len(self.names)
        for i in range(1, k):
            if most > (1 << 62) // len(self.names):
                keys = np.unique(keys, return_inverse=True)[1].reshape(-1)
                most = len(starts)
            keys, most = keys * len(self.names) + self.at[starts + i], most * len(self.names)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        names = pa.array(self.names[1:], pa.binary()).cast(pa.string())
        parts = [names.take(pa.array(self.at[starts[first] + i] - 1)) for i in range(k)]
        return (pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]), counts


def _frequent(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    h = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def level_counts(group: str, text: bytes, k: int, tables: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Phrases of k words in a stretch whose parts of k - 1 words are frequent, and their counts."""
    words = Words(text)
    return words.counts(words.starts(group, k, tables), k)


def _count(k: int, sent: list[Broadcast], size: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(s.value, np.uint64) for s in sent]
        for group, text in _by_group(batches, size):
            phrases, counts = level_counts(group, text, k, tables)
            if k == 1:  # the group's words in all, under no phrase
                phrases, counts = pa.concat_arrays([pa.array([None], pa.string()), phrases]), np.concatenate([[counts.sum()], counts])
            for at in range(0, len(phrases), 65536):
                part = phrases.slice(at, 65536)
                yield pa.record_batch([pa.array([group] * len(part), pa.string()), part, pa.array(counts[at : at + 65536], pa.int64())], ["g", "phrase", "n"])

    return count


def bit_table(phrases: DataFrame, most: int = TABLE_BITS) -> bytes:
    """A table of bits, set at the hash of each (g, phrase): 32 bits a phrase if these are no more than most."""
    n = phrases.count()
    bits = min(most, max(1 << 16, 1 << (32 * n).bit_length()))
    turned = lambda h: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
    hashed = F.aggregate(F.split("phrase", " ", -1), F.xxhash64("g"), lambda h, w: turned(h).bitwiseXOR(F.xxhash64(w)))
    at = hashed.bitwiseAND(F.lit(bits - 1))
    words = phrases.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found, table = words.toArrow(), np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def _slice(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", no_group: str = "und", max_words: int = 3, min_count: int = 10, within: int = 50, top: int | None = 2000, block: int = BLOCK) -> DataFrame:
    """The top phrases of each group, by their lowest-scoring cut: (group, rank, phrase, a, l, r, n, score).

    A text, with A-Z lower-cased, is pieces between any of BREAKS, and a piece is words between blanks. n: words of the group. a: occurrences of the
    phrase, at least min_count, of 2 to max_words words. l, r: those of the two parts that the cut makes; score:
    floor(1000000 * a * a / (l * r)) in exact decimals. A phrase goes if a longer candidate holds it and has at least
    within hundredths of its occurrences. Ties: greater a, then the phrase in byte order. top: of each group, None for all.

    A null group counts as no_group, a null or empty text has no words, and a group without candidates gives no rows.
    Repeated rows count as often as they are there; an empty table gives none; other columns are not read. Memory of a
    task grows with block and the longest piece, not with texts.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words at least, and counts start at 1")
    spark = ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(no_group)).alias("g"), F.col(text_col).alias("text")).filter("text is not null")
    levels: list[DataFrame] = []
    sent: list[Broadcast] = []
    for k in range(1, max_words + 1):
        counted = rows.mapInArrow(_count(k, list(sent), block), "g string, phrase string, n long")
        # a stretch has each phrase once, so little is gained by adding up before the exchange
        found = Saved(counted.repartition("g", "phrase").groupBy("g", "phrase").agg(F.sum("n").alias("f")).filter(F.col("phrase").isNull() | (F.col("f") >= min_count))).df
        levels.append(found.filter("phrase is not null"))
        if k == 1:
            totals = found.filter("phrase is null").select("g", F.col("f").alias("n"))
        if k < max_words:
            sent.append(spark.sparkContext.broadcast(bit_table(levels[-1])))
    counts = reduce(DataFrame.unionAll, levels)
    phrases = reduce(DataFrame.unionAll, (d.withColumn("k", F.lit(i + 2)) for i, d in enumerate(levels[1:])))
    words = F.split("phrase", " ", -1)
    cuts = phrases.select("g", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("g", "phrase", "a", "cut", _slice(F.col("w"), 1, F.col("cut")).alias("left"), _slice(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    # inner joins with an exchange after them: adaptive execution splits a word that begins or ends very many phrases
    priced = cuts.join(counts.select("g", F.col("phrase").alias("left"), F.col("f").alias("l")), ["g", "left"]).join(counts.select("g", F.col("phrase").alias("right"), F.col("f").alias("r")), ["g", "right"])
    # counts have up to 14 digits, so that a million times a product of two has no more than 38
    whole = lambda c: F.col(c).cast("decimal(14,0)")
    score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * whole("a") * whole("a"), whole("l") * whole("r"))
    scored = priced.select("g", "phrase", "a", "cut", "l", "r", score.alias("score"))
    lowest = scored.groupBy("g", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("low")).select("g", "phrase", "low.a", "low.l", "low.r", "low.score")
    if max_words > 2:
        longer = phrases.filter("k > 2").select("g", F.col("f").alias("outer"), words.alias("w"), "k")
        sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
        inner = sizes.select("g", "outer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
        held = inner.groupBy("g", _slice(F.col("w"), F.col("from"), F.col("size")).alias("phrase")).agg(F.max("outer").alias("outer"))
        lowest = lowest.join(held, ["g", "phrase"], "left").filter(F.coalesce(F.col("outer") * 100 < F.col("a") * within, F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = lowest.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "g").select(F.col("g").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
