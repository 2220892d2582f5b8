"""Mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source's weight is its share of tokens to the power a, normalised. The exponent is bisected to
meet a target entropy of the weights or a limit on how often any source is repeated. Weights become a budget of tokens
for each source, that is a number of passes over it. Each pass reads the source's documents in an order of its own, by
a hash seeded with the pass, dealt into blocks; all passes but the last take every document, and the last takes
documents in that order while their middle is within what is left of the budget. Running sums go over block totals and then inside
each block, so no task ever holds a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Saved, free_name

#: A block has about so many documents.
BLOCK = 4096
#: Each pass over the source totals looks at so many exponents at once, which is three bisections.
POINTS, PASSES = 7, 12


def words(text: Column) -> Column:
    """Words of a text, the default measure of tokens; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass
class Temperature:
    """exponent of the shares; base: sum of (share / largest share) ** exponent; largest: tokens of the largest source; budget in tokens."""

    exponent: float
    base: float
    largest: float
    budget: float

    def passes(self, tokens: Column) -> Column:
        """How often a source of so many tokens is read: weight * budget / tokens. One without tokens is read once."""
        weight = F.pow(tokens / F.lit(self.largest), F.lit(self.exponent)) / F.lit(self.base)
        return F.when(tokens > 0, weight * F.lit(self.budget) / tokens).otherwise(F.lit(1.0))


def temperature(totals: DataFrame, repeat_limit: float | None, entropy: float | None, budget: float | None) -> Temperature:
    """The exponent in [0, 1] for totals (source, tokens).

    With a repetition limit: the flattest mixture that repeats no source more often. With an entropy (in nats): the
    mixture that has it, or the nearest that an exponent in [0, 1] gives. Without a budget each mixture gets the
    smallest one that reads every document at least once.
    """
    if (repeat_limit is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    some = totals.filter("tokens > 0")
    first = some.agg(F.max("tokens"), F.min("tokens")).first()
    if first[0] is None:
        return Temperature(1.0, 1.0, 1.0, 0.0)
    largest, least = float(first[0]), math.log(first[1] / first[0])
    x = F.ln(F.col("tokens") / F.lit(largest))

    def at(points: list[float]) -> list[tuple[float, float]]:
        row = some.agg(*[f for a in points for f in (F.sum(F.exp(F.lit(a) * x)), F.sum(x * F.exp(F.lit(a) * x)))]).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(points))]

    def flat_enough(a: float, base: float, slope: float) -> bool:
        """Whether the mixture may be flatter still: the exponent sought is at most a."""
        if entropy is not None:
            return math.log(base) - a * slope / base <= entropy
        return (budget or base * largest) * math.exp((a - 1) * least) / (base * largest) <= repeat_limit * (1 + 1e-12)

    low, high = 0.0, 1.0
    ends = at([low, high])
    if entropy is None and not flat_enough(high, *ends[1]):
        raise ValueError("the budget repeats every source more often than the limit")
    if flat_enough(low, *ends[0]):
        high = low
    else:
        for _ in range(PASSES):
            points = [low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
            for a, sums in zip(points, at(points), strict=True):
                if flat_enough(a, *sums):
                    high = a
                    break
                low = a
    base = at([high])[0][0]
    return Temperature(high, base, largest, budget or base * largest)


def mix(docs: DataFrame, repeat_limit: float | None = 2.0, entropy: float | None = None, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, seed: int = 0) -> DataFrame:
    """A row for each document and pass that the mixture takes it in.

    Returns id, source, tokens, pass (from 0), block, position and row_key. Sorting by position gives a mixture whose
    every stretch has about the target weights. row_key is a struct that tells rows with the same id and text apart
    (key, other, nth), so the rows can be joined to docs. A null source is a source; null and empty texts have no
    tokens and cost nothing; repeated rows are documents of their own; an empty table gives no rows.
    """
    measure = words(F.col(text_col)) if tokens is None else tokens
    keyed = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), measure.alias("tokens"), *row_keys(docs))
    rows = Saved(keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "other").orderBy(F.lit(1))))).df
    totals = Saved(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))).df
    t = temperature(totals, repeat_limit, entropy, budget)
    plan = totals.select(F.col("source").alias("s"), F.col("tokens").alias("total"), t.passes(F.col("tokens")).alias("passes"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    # a share of a pass too small for its rounding to matter is none
    plan = plan.withColumn("whole", F.floor(F.col("passes") + 1e-9)).withColumn("left", F.greatest(F.lit(0.0), F.col("passes") - F.col("whole")) * F.col("total"))
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"]))
    passes = joined.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("left") > 0, 0).otherwise(1))))
    place = F.shiftrightunsigned(F.xxhash64("key", "other", "nth", "pass", F.lit(seed)), 11) / F.lit(float(1 << 53))
    dealt = passes.withColumn("place", place).withColumn("block", F.floor(F.col("place") * F.col("blocks")))
    blocks = dealt.groupBy("source", "pass", "block").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source", "pass").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "pass", "block").orderBy("place", "key", "other", "nth").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("inside", inside)
    summed = ranked.join(starts, ranked["source"].eqNullSafe(starts["s"]) & (ranked["pass"] == starts["p"]) & (ranked["block"] == starts["b"]))
    end = F.col("start") + F.col("inside")
    kept = summed.filter((F.col("pass") < F.col("whole")) | (end - F.col("tokens") / 2 <= F.col("left")))
    read = F.when(F.col("total") > 0, (end - F.col("tokens")) / F.col("total")).otherwise(F.col("place"))
    return kept.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", F.col("pass").cast("int").alias("pass"), "block", ((F.col("pass") + read) / F.col("passes")).alias("position"), F.struct("key", "other", "nth").alias("row_key"))


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes over all columns; rows that agree in both are taken for repeats of each other. Columns with maps count as JSON."""
    values = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return [F.xxhash64(F.lit(1), *values).alias("key"), F.xxhash64(F.lit(2), *values).alias("other")]


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with the columns of docs."""
    taken = mix(docs, text_col=text_col, **options)
    counts = taken.groupBy("row_key").count()
    key_col, other_col, nth, times, copy = (free_name(docs, n) for n in ("row_key", "row_other", "row_nth", "row_times", "row_copy"))
    by_row = counts.groupBy(F.col("row_key.key").alias(key_col), F.col("row_key.other").alias(other_col)).agg(F.map_from_entries(F.collect_list(F.struct("row_key.nth", "count"))).alias(times))
    key, other = row_keys(docs)
    joined = docs.withColumns({key_col: key, other_col: other}).join(by_row, [key_col, other_col])
    numbered = joined.withColumn(nth, F.row_number().over(Window.partitionBy(key_col, other_col).orderBy(F.lit(1))))
    taken_times = F.coalesce(F.try_element_at(times, F.col(nth)), F.lit(0).cast("long"))
    return numbered.withColumn(copy, F.explode(F.array_repeat(F.lit(True), taken_times.cast("int")))).select(*docs.columns)
