"""Connected components of a link table, by alternating large-star and small-star rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Saved, join_unique


def _star(pairs: DataFrame, shape: Callable[[DataFrame], DataFrame]) -> Saved:
    """Links that shape makes of (u, v) pairs with the least v of each u as m. The pairs of a hub stay dealt over all tasks."""
    least = Saved(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    done = Saved(shape(join_unique(pairs, least.df, ["u"])).filter("u != v").distinct())
    least.drop()
    return done


def _large(hooked: DataFrame) -> DataFrame:
    return hooked.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(hooked: DataFrame) -> DataFrame:
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hooked.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of every node in a link between two different nodes; component is the least node reachable.

    Nodes are of any ordered type. Null ends, self links and repeated links are ignored. Each round is written to the
    shared folder, so a lost executor costs a round at most.
    """
    current = Saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    while True:
        # every node has one link to a lesser one and none from a greater one, or none to a lesser one: the links are stars
        ends = current.df.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(current.df.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            return current.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(current.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        large = _star(current.df.select("u", "v").unionAll(current.df.select(F.col("v").alias("u"), F.col("u").alias("v"))), _large)
        current.drop()
        current = _star(large.df, _small)
        large.drop()
