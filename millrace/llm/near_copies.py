"""Near copies by SimHash over words, covering locality-sensitive hashing and an exact check of shingles.

Texts that share four fifths of their five-word shingles differ in a few words, so the SimHash for them is over single
words, weighted by the square root of their count: a changed word moves few bits, and very common words don't make all
texts of a language alike. A pair within the radius meets in some covering table. There each text names its nearest
neighbours and the least, so a group of any size gives a few pairs a text. Every pair is then held against the shingles
of its texts. Confirmed pairs are joined up.

That finds most copies early, but not those with a long stretch added or cut, nor all in large families. So each text also
has bands of least shingle hashes: two texts at the similarity agree on none with a chance of at most MISS, whatever the
kind of edit. Texts that agree on a band and are not in one group yet are first held against the least of them; all pairs
that are in different groups still are then held against each other, in blocks where the entry is large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import HOT, Saved, free_name, join_unique, perhaps_among, temporary
from millrace.llm.components import connected_components
from millrace.llm.simhash import RADIUS, covering_masks, near_links
from millrace.ship import ship

#: A near copy shares so large a part of the shingles of so many words.
WORDS, SIMILARITY = 5, 0.8

#: A text is held against so many nearest neighbours of each table entry.
NEAREST = 4
#: A band is so many least hashes; there are as many bands as leave a pair at the similarity this chance to agree on none.
LEAST, MISS = 4, 1e-6
#: Entries of at most FEW texts give pairs; larger ones are compared in blocks of at most so many texts and, unless one has more, shingles.
FEW, BLOCK_TEXTS, BLOCK_SHINGLES = 32, 1024, 1 << 20
#: Shingles of a text that very many pairs ask for are kept so many times, each for its share of the pairs.
COPIES = 32
#: Odd multipliers of 64-bit hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """64-bit hash of a word; forgets all when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def hashes(text: str | None, known: Words) -> np.ndarray:
    """Of the lower-case words of a text, in order."""
    own = (text or "").lower().split()
    return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))


def word_fingerprint(words: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashed words, each weighted by the square root of its count; no words give zero."""
    distinct, counts = np.unique(words, return_counts=True)
    weights, ones = np.sqrt(counts.astype(np.float32)), np.zeros(64, np.float32)
    for at in range(0, len(distinct), 4096):
        bits = np.unpackbits(distinct[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        ones += weights[at : at + 4096] @ bits.astype(np.float32)
    return int(np.packbits(2 * ones > weights.sum()).view(np.int64)[0])


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct 32-bit hashes of the shingles of n hashed words; a shorter text is one shingle."""
    n = max(1, min(n, len(words)))
    x = np.zeros(max(1, len(words) - n + 1), np.uint64)
    for k in range(min(n, len(words))):
        x = (x ^ x >> np.uint64(29)) * STEP + words[k : k + len(x)]
    x = (x ^ x >> np.uint64(32)) * MIX
    return np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def _prints(words: int, bands: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In place of the text: its fingerprint, its shingles and the keys of its bands."""
        known = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                own = [hashes(t, known) for t in part.column(part.num_columns - 1).to_pylist()]
                fps, sets = np.array([word_fingerprint(x) for x in own], np.int64), [shingles(x, words) for x in own]
                keys = pa.ListArray.from_arrays(np.arange(0, bands * len(own) + 1, bands, dtype=np.int32), band_keys(sets, bands).ravel())
                yield pa.record_batch([*part.columns[:-1], pa.array(fps), pa.array(sets, pa.list_(pa.int32())), keys], [*part.schema.names[:-1], "fp", "s", "keys"])

    return prints


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.99) ** LEAST))


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """For each non-empty set of 32-bit hashes, the keys of its bands."""
    r = np.random.default_rng(7)
    times, plus = r.integers(0, 1 << 32, (2, bands * LEAST), np.uint32)
    times |= np.uint32(1)
    mix = r.integers(0, 1 << 64, (bands, LEAST), np.uint64) | np.uint64(1)
    out, at = [], 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= 32768:
            size += len(sets[end])
            end += 1
        x, sizes = np.concatenate(sets[at:end]).view(np.uint32), np.array([len(s) for s in sets[at:end]])
        starts = np.cumsum(sizes) - sizes
        least = np.stack([np.minimum.reduceat(x * t + p, starts) for t, p in zip(times, plus, strict=True)], 1)
        keys = (least.reshape(-1, bands, LEAST).astype(np.uint64) * mix).sum(2, dtype=np.uint64) + mix[:, 0]
        out.append(keys.view(np.int64))
        at = end
    return np.concatenate(out) if out else np.empty((0, bands), np.int64)


def neighbours(radius: int):
    """Per entry, each member with its nearest neighbours and the least within the radius; of equally near ones the least.

    A pair is given only under the first of the outermost masks on which it agrees: who is among the nearest of all is
    among the nearest there too.
    """
    top = np.array(covering_masks(list(range(64)), radius), np.uint64)

    def links(groups: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for group, mask in zip(groups, masks, strict=True):
            x = np.sort(np.asarray(group, np.int64))
            u = x.view(np.uint64)
            before = top[: int(np.flatnonzero(top == np.int64(mask).view(np.uint64))[0])] if np.int64(mask).view(np.uint64) in top else top[:0]
            found = set()
            for i in range(0, len(u), 256):
                d = np.bitwise_count(u[i : i + 256, None] ^ u[None, :])
                d[np.arange(len(d)), np.arange(i, i + len(d))] = 255
                rows = np.arange(i, i + len(d))
                key = d.astype(np.int32) * len(u) + np.arange(len(u), dtype=np.int32)
                nearest = np.argpartition(key, NEAREST, 1)[:, :NEAREST] if len(u) > NEAREST else np.tile(np.arange(len(u)), (len(d), 1))
                for to in (*nearest.T, (d <= radius).argmax(1)):
                    near = d[np.arange(len(d)), to] <= radius
                    a, b = rows[near], to[near]
                    if len(before):
                        late = ((u[a] ^ u[b])[:, None] & before[None, :] == 0).any(1)
                        a, b = a[~late], b[~late]
                    found.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))
            out.append([{"u": int(x[a]), "v": int(x[b])} for a, b in sorted(found)])
        return pd.Series(out)

    return F.pandas_udf(links, "array<struct<u:long,v:long>>")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a has in common with each of b."""
    values, column = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    in_a, in_b = (np.bincount(column[side], minlength=len(values)) > 0 for side in (row < len(a), row >= len(a)))
    both = in_a & in_b
    place = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(both.sum()), 4096):
        some = slice(*np.searchsorted(column, (c, c + 4096)))
        dense = np.zeros((len(a) + len(b), 4096), np.float32)
        dense[row[some], column[some] - c] = 1
        common += dense[: len(a)] @ dense[len(a) :].T
    return common.astype(np.int64)


def _across(similarity: float):
    def links(table: pa.Table) -> pa.Table:
        """(u, v) of the groups that a pair of texts joins, of a block's texts with those of another block, or with each other."""
        sets = [np.asarray(s.values.to_numpy(), np.int32) for s in table.column("s")]
        group, left = table.column("g").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        two = two if len(two) else one
        common = _common([sets[i] for i in one], [sets[i] for i in two])
        size = np.array([len(s) for s in sets])
        alike = common >= similarity * (size[one][:, None] + size[two][None, :] - common)
        x, y = np.nonzero(alike & (group[one][:, None] != group[two][None, :]))
        found = np.unique(np.stack([group[one][x], group[two][y]], 1), axis=0) if len(x) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return links


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, h, group) of every row: h is a hash of its text, group that of the group's texts, null texts being empty ones.

    A group joins equal texts and, over any number of steps, texts that share the given part of their shingles. Each
    pair at the similarity or above is missed with a chance of at most MISS, over the choice of hashes; no pair below it
    is joined. Repeated rows and null ids have a row each; an empty table gives none; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("t"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    # z: how many shingles a text has, which goes with its hash wherever pairs are made
    prints = Saved(rows.mapInArrow(_prints(words, bands_for(similarity)), kinds + ", fp long, s array<int>, keys array<long>").withColumn("z", F.size("s"))).df
    copies = Saved(prints.groupBy("h").agg(F.count("*").alias("n"))).df

    def sets(asked: DataFrame) -> DataFrame:
        """(h, s) of the texts asked for; rows of a text that very many have are not gathered before they are one a task.

        Few texts are asked for, and shingles are most of what is written: those of other texts stay where they are.
        """
        held = prints.select("h", "s").filter(perhaps_among(asked)("h"))
        return join_unique(held, copies.join(asked, "h", "left_semi"), ["h"]).groupBy("h").agg(F.first("s").alias("s"))

    def grouped(sure: DataFrame) -> Saved:
        return Saved(connected_components(sure, "a", "b").select(F.col("node").alias("h"), F.col("component").alias("g")))

    least = Saved(prints.groupBy("fp").agg(F.min(F.struct("h", "z")).alias("least"), F.count("*").alias("n")))
    # written, so that no plan holds all tables' joins
    close = Saved(near_links(least.df.select("fp"), radius, within=neighbours(radius)))
    named = least.df.select("fp", "least")
    far = close.df.join(named.toDF("u", "a"), "u").join(named.toDF("v", "b"), "v").select("a", "b")
    same = join_unique(prints.select("h", "z", "fp"), least.df, ["fp"]).select(F.struct("h", "z").alias("a"), F.col("least").alias("b"))
    # texts that agree on a band are first held against the least of them; equal texts are one from here on
    alike = _of_several_groups(prints.select("h", "z", F.col("h").alias("g"), F.explode("keys").alias("key")))
    sure = _confirmed(far.unionAll(same).unionAll(alike.df.select(F.struct("h", "z").alias("a"), F.col("first").alias("b"))), sets, similarity).df
    for done in (least, close):
        done.drop()
    # then all pairs of those that are in different groups still
    parts = grouped(sure)
    left = _of_several_groups(alike.df.select("h", "z", "key").join(parts.df, "h", "left").select("h", "z", F.coalesce("g", "h").alias("g"), "key"))
    for done in (parts, alike):
        done.drop()
    few = left.df.filter(F.col("of") <= FEW)
    two = few.select("key", F.struct("h", "z").alias("a"), F.col("g").alias("ga")).join(few.select("key", F.struct("h", "z").alias("b"), F.col("g").alias("gb")), "key").filter("a.h > b.h and ga != gb")
    sure = sure.unionAll(_confirmed(two.select("a", "b"), sets, similarity).df).unionAll(_in_blocks(left.df.filter(F.col("of") > FEW), sets, similarity))
    parts = grouped(sure)
    named = Saved(copies.join(parts.df, "h", "left").select("h", F.coalesce("g", "h").alias("group"), "n"))
    for done in (parts, left):
        done.drop()
    return join_unique(prints.select("id", "h"), named.df, ["h"]).select(F.col("id").alias(id_col), "h", "group")


def _confirmed(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> Saved:
    """The different pairs (a, b) of texts whose shingles are so similar, among pairs of (h, z) structs.

    A pair whose numbers of shingles alone keep it below the similarity goes before any shingles are fetched. Sets that
    very many pairs ask for are kept in several copies.
    """
    near = F.least("a.z", "b.z") >= F.lit(similarity - 1e-9) * F.greatest("a.z", "b.z")
    asking = Saved(pairs.filter((F.col("a.h") != F.col("b.h")) & near).select(F.greatest("a.h", "b.h").alias("a"), F.least("a.h", "b.h").alias("b")).distinct())
    pairs = asking.df
    asked = Saved(pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("n")))
    total = asked.df.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(asked.df.filter(F.col("n") * HOT > total).select("h", F.lit(COPIES).alias("copies"))) if total > HOT * FEW else asked.df.filter("false").select("h", F.lit(COPIES).alias("copies"))
    kept = Saved(sets(asked.df.select("h")).join(hot, "h", "left").select("h", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), "s"))

    def meets(side: str, other: str, out: str, held: DataFrame) -> DataFrame:
        copy = F.coalesce(F.pmod(F.xxhash64(other), F.col("copies").cast("long")), F.lit(0)).cast("int").alias("copy")
        dealt = held.join(hot.withColumnRenamed("h", side), side, "left").select(*held.columns, copy)
        return dealt.join(kept.df.select(F.col("h").alias(side), "copy", F.col("s").alias(out)), [side, "copy"]).drop("copy")

    held = meets("b", "a", "sb", meets("a", "b", "sa", pairs))
    common = F.size(F.array_intersect("sa", "sb"))
    found = Saved(held.filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    for done in (asking, asked, kept):
        done.drop()
    return found


def _of_several_groups(keyed: DataFrame) -> Saved:
    """Of (h, z, g, key), the different rows of keys that texts of more than one group have, with the least text and about the number of texts."""
    entries = keyed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min(F.struct("h", "z")).alias("first"), F.count("*").alias("n")).filter("lo != hi")
    kept = Saved(entries.select("key", "first", "n", F.col("n").alias("of")))
    found = Saved(join_unique(keyed, kept.df, ["key"]).distinct())
    kept.drop()
    return found


def _in_blocks(many: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a, b) of groups that a pair of texts joins, among all pairs of an entry's texts in different groups.

    An entry's texts are dealt over blocks by a hash; a group that is larger than a block has blocks of its own, which
    are not compared with each other.
    """
    own_sets = Saved(sets(many.select("h").distinct()))
    sized = Saved(many.join(own_sets.df.select("h", F.size("s").alias("size")), "h").select("key", "h", "g", "size")).df
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("size") / BLOCK_SHINGLES))
    own = Saved(sized.groupBy("key", "g").agg(F.count("*").alias("n"), F.sum("size").alias("size")).withColumn("blocks", n_blocks)).df
    large = own.filter("blocks > 1").select("key", "g", "blocks", "n")
    small = [F.sum(F.when(F.col("blocks") > 1, 0).otherwise(F.col(c))).alias(c) for c in ("n", "size")]
    shared = own.groupBy("key").agg(F.sum("n").alias("all"), *small).select("key", F.greatest(n_blocks, F.lit(1)).alias("shared"), F.col("all").alias("n"))
    dealt = join_unique(join_unique(sized, Saved(large).df, ["key", "g"], how="left"), Saved(shared).df, ["key"])
    block = F.when(F.col("blocks").isNull(), F.concat(F.lit("/"), F.pmod(F.xxhash64("g"), "shared"))).otherwise(F.concat("g", F.lit("/"), F.pmod(F.xxhash64("h"), "blocks")))
    dealt = Saved(dealt.select("key", "h", "g", block.alias("block"))).df
    ends = Saved(dealt.groupBy("key", "block").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))).df
    other = ends.select("key", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = ends.join(other, "key").filter("block <= other and (lo != hi or lo2 != hi2 or lo != lo2)").select("key", "block", "other")
    sides = meet.select("key", "block", "other", F.lit(True).alias("left"), F.col("block").alias("at")).unionAll(meet.filter("block != other").select("key", "block", "other", F.lit(False).alias("left"), F.col("other").alias("at")))
    placed = sides.join(dealt.withColumnRenamed("block", "at"), ["key", "at"]).join(own_sets.df, "h").select("key", "block", "other", "left", "g", "s")
    found = Saved(placed.groupBy("key", "block", "other").applyInArrow(_across(similarity), "a long, b long")).df
    own_sets.drop()
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without those of a group of near copies but its first: by id, nulls last, then by a hash of the text.

    Groups are chosen over ids and hashes alone; texts move once, to meet the rows that stay. Of rows that repeat each
    other in id and text, one stays. Columns of any name stay as they are.
    """
    own_key, own_n = free_name(docs, "first_key"), free_name(docs, "first_n")
    first = F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "h")).alias("first")
    with temporary() as made:  # ids and hashes of those that stay are all that is kept
        groups = near_copy_groups(docs, id_col, text_col, words, similarity, radius)
        kept = Saved(groups.groupBy("group").agg(first).select(F.struct("first.id", "first.h").alias(own_key)))
        made.remove(kept)
    # the join and the window have one key of one type, a struct that is never null, so that texts are shuffled once for both
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    mine = docs.withColumn(own_key, own.cast(kept.df.schema[own_key].dataType))
    joined = mine.join(kept.df, own_key)
    return joined.withColumn(own_n, F.row_number().over(Window.partitionBy(own_key).orderBy(F.lit(1)))).filter(F.col(own_n) == 1).select(*docs.columns)
