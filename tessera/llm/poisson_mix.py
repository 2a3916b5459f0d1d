"""Mixing sources to target weights by Poisson replication (operator 7).

A source with target weight w is to make up the share w of the mixture's characters.
Its mean repetition rate is ``w * all characters / its characters`` (times ``size``, the
length of the mixture relative to the input). Every document draws how often it occurs
from a Poisson distribution with that mean by inverting the distribution at a number
hashed from the seed and its id, so the draw is repeatable and needs no state. The
document is exploded by its count and the copies are put in a global random order, by
hash.

Only DataFrame functions are used. The one large shuffle is the global order itself: it
is a range exchange on a hash, even for any input. Rates are one row per source; that
table is broadcast if it has at most ``MAX_BROADCAST_SOURCES`` rows, else the rows of
hot sources meet it by broadcast and the others by a shuffle (``hot.join_hot``).

A mean above ``STEP`` is drawn as a sum of independent draws with means of at most
``STEP``, which has the same distribution and keeps exp(-mean) in range.

Cases: a null source is a source of its own; a source without a weight, or without any
characters, has rate 0 (with equal weights an empty source has no share); null text has
0 characters; a null doc_id draws like the empty string; repeated rows draw alike; an
empty table gives an empty mixture. Columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .hot import join_hot

STEP = 8.0                        # largest mean drawn at once
TERMS = 64                        # P(X > 64) < 1e-32 at mean 8, less than a draw can tell
BITS = 52                         # of a draw: 13 hex digits
MAX_BROADCAST_SOURCES = 100_000   # rows of the table of rates, of under 1 kB each


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts joined by '-'."""
    text = F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, n, steps, rate, cdf): one row per source with its mean repetition rate,
    the number of draws it is split into and the distribution function of one draw.
    ``weights`` None: every source that has characters gets an equal share."""
    per = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("mass"))
    per = materialize(per, "source-mass")          # one small row per source, read three times
    if weights is None:
        weight = F.when(F.col("mass") > 0, 1.0).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    per = per.withColumn("w", weight)
    sums = per.agg(F.sum("mass").alias("m"), F.sum(F.when(F.col("mass") > 0, F.col("w"))).alias("w")).first()
    mass, total = sums["m"] or 0, sums["w"] or 1.0
    rate = F.when((F.col("mass") > 0) & (F.col("w") > 0),
                  F.col("w") * F.lit(float(size)) * F.lit(float(mass)) / F.lit(float(total))
                  / F.col("mass").cast("double")).otherwise(0.0)
    per = per.withColumn("rate", rate).withColumn("steps", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("steps")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf")), lambda acc: acc["cdf"])
    return per.select("source", "n", "steps", "rate", cdf.alias("cdf"))


def copies(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0, seed: str = "mix",
           id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` exploded by the drawn counts, with ``copy`` (from 0) and ``order_key``, the
    hash that orders the mixture; not yet shuffled."""
    docs = docs.drop("copy", "order_key")
    table = rates(docs, weights, size, source_col, text_col).withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))) \
        .select("__s", F.col("n").alias("__n"), F.col("steps").alias("__steps"), F.col("cdf").alias("__cdf"))
    keyed = docs.withColumn("__s", F.coalesce(F.concat(F.lit("="), source_col), F.lit("null")))
    if table.count() <= MAX_BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(table), "__s")
    else:
        joined = join_hot(keyed, table, ["__s"], "__n")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), "__steps"), lambda i: unit(seed, name, i.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("__cdf", lambda c: c < u)))
    out = joined.withColumn("__k", count).where("__k > 0") \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    key = F.md5(F.concat_ws("-", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string")))
    return out.select(*[docs[c] for c in docs.columns], "copy", key.alias("order_key"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture: every copy of every document, globally sorted by ``order_key``."""
    return copies(docs, weights, size, seed, id_col, source_col, text_col).orderBy("order_key")
