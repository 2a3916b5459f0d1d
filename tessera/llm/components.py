"""Connected components by alternating large-star and small-star steps.

Every step keeps the components and moves links towards the smallest node; the number
of rounds grows with the logarithm of the longest path, not with its length. All work
is joins and grouped minima over the link table; each round is written to the shared
checkpoint folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .hot import join_hot


def _pull(links: DataFrame, total: int) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and its partners v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")) \
        .select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(links, least, ["u"], "n", total).select("u", "v", "m")


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _pull(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    p = _pull(links, total)
    return p.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .union(p.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b; a > b): component is the
    smallest node reachable. A node in no link is not returned."""
    now = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    total, seen = now.count(), None
    while total:
        star = materialize(_large_star(now, total), "links")
        now = materialize(_small_star(star, total), "links")
        # equal sums mean equal tables: a round that moves a link lowers its partner
        state = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(20,0)")),
                        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        total, seen = state[0], state
    ends = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(ends.select("node", F.col("node").alias("component")))
