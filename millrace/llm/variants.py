"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length L is cut into two segments, of L // 2 code points and the rest. One edit leaves one of them whole, so
a word of length L or L + 1 that is near has the first segment at its start or the second at its end. Both segments are
the index, and each word probes the index of its own length and of the length below. What is between the agreed start
and end is one edit apart again: where an index entry and its probes are too many to hold against each other, they are
dealt on by the halves of what is between, down to entries whose words differ in one place only, which are as many as
there are letters. Candidates are verified where they are joined, so no list of candidates is ever made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Saved, join_unique
from millrace.ship import ship

#: Fixed value: a run of these, after A-Z are lower-cased, is a word.
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Of so many runs one loses a letter, by its hash.
MANGLED = 199
#: Entries of more words are dealt on.
CROWD = 48


def doc_words(key: object, text: str, mangled: int | None, shortest: int) -> Counter:
    """Words of a text and how often each occurs, one code point gone where the hash says so; a null key is an empty one."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    found: Counter = Counter()
    for run, n in Counter(LETTERS.findall(text.encode().lower().decode())).items():
        if mangled and not (h := zlib.crc32(run.encode(), start)) % mangled:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= shortest:
            found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mangled: int | None = None, shortest: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of all texts, for words of at least shortest code points and min_count occurrences."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            size = 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                held.update(doc_words(batch.column(0)[i].as_py(), text, mangled, shortest))
                size += len(text)
                if size > 8_000_000 or i == batch.num_rows - 1:
                    yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held, size = Counter(), 0

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _entry(longer: int, head: Column, tail: Column, length: Column, word: Column) -> Column:
    """What words of an index entry share: the indexed length, what is longer in probes, and the agreed start and end."""
    return F.concat_ws("|", length, F.lit(str(longer)), F.substring(word, F.lit(1), head), F.when(tail > 0, F.substring(word, F.char_length(word) - tail + 1, tail)).otherwise(""))


def _halves(longer: int) -> list[Column]:
    """The two (head, tail) that one edit between the agreed head and tail of the indexed word leaves, as structs."""
    between = F.col("length") - F.col("head") - F.col("tail")
    first = F.greatest(F.lit(longer), F.floor(between / 2).cast("int"))  # a probe of one more has one of the two ends right
    second = F.greatest(F.lit(longer), (between - F.floor(between / 2)).cast("int"))
    return [F.struct((F.col("head") + first).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + second).alias("tail"))]


def _dealt(states: DataFrame, longer: int) -> DataFrame:
    parts = states.withColumn("part", F.explode(F.array(*_halves(longer)))).withColumn("head", F.col("part.head")).withColumn("tail", F.col("part.tail")).drop("part")
    return parts.withColumn("entry", _entry(longer, F.col("head"), F.col("tail"), F.col("length"), F.col("word")))


def _pairs(states: DataFrame, longer: int, crowd: int) -> DataFrame:
    """(word, n, near, near_n), each pair once or more, of states (word, n, probe, length, head, tail)."""
    found: DataFrame | None = None
    while True:
        keyed = Saved(_dealt(states, longer)).df
        between = F.col("length") - F.col("head") - F.col("tail")
        sizes = keyed.groupBy("entry").agg(F.count("*").alias("rows"), F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("indexed"), F.max(between).alias("between"))
        met = Saved(sizes.filter("probes > 0 and indexed > 0" if longer else "rows > 1")).df
        # words that differ in the place of the edit only are near as they are
        crowded = (F.col("rows") > crowd) & (F.col("between") > (0 if longer else 1))
        sized = join_unique(keyed, met.select("entry", "rows", crowded.alias("crowded")), ["entry"], n="rows")
        held = sized.filter(~F.col("crowded"))
        left = held.filter(~F.col("probe")) if longer else held
        right = held.filter("probe") if longer else held
        order = F.lit(True) if longer else F.col("x.word") < F.col("y.word")
        near = left.alias("x").join(right.alias("y"), (F.col("x.entry") == F.col("y.entry")) & order & (F.levenshtein("x.word", "y.word", 1) == 1))
        some = near.select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
        found = some if found is None else found.unionAll(some)
        if met.filter(crowded).isEmpty():
            return found
        states = sized.filter("crowded").select("word", "n", "probe", "length", "head", "tail")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n): all pairs of different words of (word, n) that one edit makes equal, both ways round."""
    size = F.char_length("word")
    base = words.select("word", "n", size.alias("size"))
    zero = [F.lit(0).alias("head"), F.lit(0).alias("tail")]
    equal = base.select("word", "n", F.lit(False).alias("probe"), F.col("size").alias("length"), *zero)
    longer = base.withColumn("probe", F.explode(F.array(F.lit(False), F.lit(True)))).select("word", "n", "probe", (F.col("size") - F.col("probe").cast("int")).alias("length"), *zero)
    pairs = _pairs(equal, 0, crowd).unionAll(_pairs(longer, 1, crowd))
    both = pairs.unionAll(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that following forms comes to. Each round doubles the steps taken."""
    at = Saved(forms.select("word", F.col("form").alias("root")))
    while True:
        uses = at.df.groupBy("root").agg(F.count("*").alias("uses"))
        onward = at.df.select(F.col("word").alias("at"), F.col("root").alias("onward")).join(uses.withColumnRenamed("root", "at"), "at")
        if onward.isEmpty():
            return at.df
        moved = join_unique(at.df.withColumnRenamed("root", "at"), onward, ["at"], n="uses")
        still = at.df.join(moved.select("word"), "word", "left_anti")
        after = Saved(moved.select("word", F.col("onward").alias("root")).unionByName(still))
        at.drop()
        at = after


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mangled: int | None = None, shortest: int = 6, min_count: int = 5, times: int = 5, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least shortest code points and min_count occurrences.

    n_near: words one inserted, deleted or replaced code point away. form: the near word of largest n, ties to the
    smallest, if that n is at least times the word's n; root: where following forms ends, the word itself without form.
    mangled: of so many runs one loses a code point before it is counted (None: none does); by a hash of id and run, so
    repeated rows lose the same. A null id counts as an empty one; a null or empty text has no words; a table without
    words gives no rows; other columns are not read. A word may be as long as its text. times must be over 1.
    """
    if times <= 1:
        raise ValueError("forms lead to more frequent words only if times is over 1")
    words = Saved(word_counts(docs, id_col, text_col, mangled, shortest, min_count)).df
    best = near_words(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = F.when(-F.col("best.less") >= F.col("own") * times, F.col("best"))
    known = Saved(best.select("word", "n_near", chosen["near"].alias("form"), (-chosen["less"]).alias("form_n"))).df
    ends = roots(known.filter("form is not null"))
    return words.join(known, "word", "left").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
