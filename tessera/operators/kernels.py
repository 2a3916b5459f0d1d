"""Exact ranks and prefix sums without a one-partition window.

A ``row_number() over (order by k)`` with no partition sends every row to one task.
Both kernels below split the order into buckets, aggregate per bucket (a table whose
size is fixed by the bucket count, not by the data), prefix-sum that small table, and
finish with a window *inside* each bucket. A group that holds a third of all rows is
spread over all its buckets, so no task gets the hot group whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hex_prefix_value
from ..session import materialize


ROWS_PER_BUCKET = 200_000
SKETCHED = 64                # quantiles taken along with the row count


def index_digits(n: int) -> int:
    """Leading hex digits that cut ``n`` evenly spread keys into buckets of at most about
    ROWS_PER_BUCKET rows (at least 16 buckets)."""
    return max(1, math.ceil(math.log(max(n, 1) / ROWS_PER_BUCKET, 16)))


def global_index(df: DataFrame, order_key: str, by: Sequence[str] = (), digits: int | None = None,
                 index_col: str = "idx", total_col: str | None = None,
                 min_total_col: str | None = None) -> DataFrame:
    """1-based rank of each row by the hex string ``order_key`` (md5), within ``by``.

    Buckets are the first ``digits`` hex characters; by default as many as the row count
    asks for, so that the bucket table -- the only one a window without partitions sees --
    has one row for about ROWS_PER_BUCKET rows of data.
    Optional outputs: ``total_col`` = rows in the group, ``min_total_col`` = smallest
    group size over all groups (for balanced sampling).
    """
    by = list(by)
    if digits is None:
        digits = index_digits(df.count())
    b = hex_prefix_value(F.col(order_key), digits)
    counts = df.groupBy(*by, b.alias("_bkt")).agg(F.count(F.lit(1)).alias("_n"))
    grp = Window.partitionBy(*by) if by else Window.partitionBy()
    offsets = counts.select(
        *by, "_bkt",
        F.coalesce(F.sum("_n").over(grp.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_n").over(grp).alias("_tot"))
    if min_total_col:
        # smallest group size: a window over the bucket table (bounded), no data-sized window
        offsets = offsets.withColumn("_mintot", F.min("_tot").over(Window.partitionBy()))
    j = df.withColumn("_bkt", b).join(offsets, [*by, "_bkt"])
    inner = Window.partitionBy(*by, "_bkt").orderBy(order_key)
    out = j.withColumn(index_col, (F.col("_off") + F.row_number().over(inner)).cast("long"))
    if total_col:
        out = out.withColumnRenamed("_tot", total_col)
    if min_total_col:
        out = out.withColumnRenamed("_mintot", min_total_col)
    return out.drop("_bkt", "_off", "_tot", "_mintot")


def prefix_aggregate(df: DataFrame, by: Sequence[str], order_col: str, values: Sequence[str],
                     how: str = "sum", buckets: int | None = None, descending: bool = False,
                     suffix: str = "_cum", totals: bool = False) -> DataFrame:
    """Running ``sum``/``max``/``min`` of ``values`` ordered by the numeric ``order_col``
    within ``by`` (inclusive of the current row, ties broken by nothing: give a unique order).

    Buckets are approximate-quantile ranges of ``order_col`` (at most ``buckets``
    boundaries reach the driver; by default the count sets about ROWS_PER_BUCKET rows per
    bucket, at least two buckets, and both are found in one pass), assigned with the ML
    ``Bucketizer`` (binary search in the JVM). Quantile ranges keep buckets balanced when
    the values crowd into a narrow range, where equal-width ranges would put most rows
    into one bucket (one task). Output: input columns + ``<value><suffix>`` for each value
    and ``<value>_prev``, the running value *before* the row (on a group's first row: 0
    for a sum, else null); with ``totals`` also ``<value>_total``, the group's value.
    """
    by = list(by)
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    cuts = None
    if buckets is None:                      # rows and quantiles in one pass, if these are enough
        probs = [i / SKETCHED for i in range(1, SKETCHED)]
        r = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(order_col).cast("double"), probs, 20 * SKETCHED).alias("q")).first()
        buckets = max(2, math.ceil(r["n"] / ROWS_PER_BUCKET))
        if buckets <= SKETCHED:
            cuts = [r["q"][i * SKETCHED // buckets - 1] for i in range(1, buckets)] if r["q"] else []
    if cuts is None:
        probs = [i / buckets for i in range(1, buckets)]
        cuts = df.approxQuantile(order_col, probs, 1.0 / (2 * buckets)) if probs else []
    splits = [float("-inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    x = df.withColumn("_o", F.col(order_col).cast("double"))
    x = Bucketizer(splits=splits, inputCol="_o", outputCol="_bd", handleInvalid="keep").transform(x)
    raw = F.col("_bd").cast("int")
    x = x.withColumn("_bkt", F.lit(len(splits) - 2) - raw if descending else raw).drop("_o", "_bd")
    per = x.groupBy(*by, "_bkt").agg(*[agg(v).alias(f"_b_{v}") for v in values])
    grp = Window.partitionBy(*by) if by else Window.partitionBy()      # over the bucket table
    before = grp.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    cols = [agg(f"_b_{v}").over(before).alias(f"_o_{v}") for v in values]
    if totals:
        cols += [agg(f"_b_{v}").over(grp).alias(f"{v}_total") for v in values]
    y = x.join(per.select(*by, "_bkt", *cols), [*by, "_bkt"])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inner = Window.partitionBy(*by, "_bkt").orderBy(order)
    run_incl = inner.rowsBetween(Window.unboundedPreceding, 0)
    run_excl = inner.rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        off = F.col(f"_o_{v}")
        y = y.withColumn(f"{v}{suffix}", _combine(how, off, agg(v).over(run_incl)))
        prev = F.col(f"{v}{suffix}") - F.coalesce(v, F.lit(0)) if how == "sum" else _combine(how, off, agg(v).over(run_excl))
        y = y.withColumn(f"{v}_prev", prev)
    return y.drop("_bkt", *[f"_o_{v}" for v in values])


def _combine(how: str, a: Column, b: Column) -> Column:
    """Combine a bucket offset with a within-bucket running value; nulls mean 'nothing yet'."""
    if how == "sum":
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    f = F.greatest if how == "max" else F.least
    return f(a, b)  # greatest/least skip nulls


def row_index(df: DataFrame, order_col: str, by: Sequence[str] = (), index_col: str = "idx",
              buckets: int | None = None) -> DataFrame:
    """1-based position of each row in numeric ``order_col`` order (unique values), via
    a K2 running count: a positional row number without a one-partition window."""
    x = df.withColumn("_one", F.lit(1).cast("long"))
    c = prefix_aggregate(x, list(by), order_col, ["_one"], "sum", buckets)
    return c.withColumnRenamed("_one_cum", index_col).drop("_one", "_one_prev")


def rank_threshold(df: DataFrame, order_key: str, k: int | Callable[[int], int], digits: int = 3,
                   max_boundary_rows: int = 10_000,
                   first_digits: int = 3) -> tuple[str | None, int]:
    """The k-th smallest value of the hex string ``order_key`` (1-based), exactly, and n.

    Counts rows per leading-hex bucket (a partial aggregate; at most 16**3 = 4096 small
    rows reach the driver per pass), walks the cumulative counts to the bucket holding
    rank k, and repeats inside that bucket with ``digits`` more hex characters until it
    holds at most ``max_boundary_rows`` rows; the exact value is then taken from that
    bucket alone. That is two passes over the input: a bucket that is to be refined and has
    a small part of the rows (1/16 at most; 1/4096 of evenly spread keys) is written as a
    table of its keys, which later passes read instead of the input.
    ``k`` may be a function of the row count n (known after the first pass). Returns
    (None, n) when k <= 0 and (largest key + '~', n) when k >= n. Each pass is a
    filtered scan plus a tiny aggregate; no row is shuffled, no window spans the data.
    """
    prefix, offset, n = "", 0, None
    while True:
        part = df if not prefix else df.where(F.substring(order_key, 1, len(prefix)) == F.lit(prefix))
        step = first_digits if not prefix else digits
        cnt = sorted(part.groupBy(F.substring(order_key, 1, len(prefix) + step).alias("b"))
                     .agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["b"])
        if n is None:
            n = left = sum(r["n"] for r in cnt)
            k = k(n) if callable(k) else k
            if k <= 0:
                return None, n
            if k >= n:
                return (cnt[-1]["b"] + "~" if cnt else None), n
        cum, chosen = offset, None
        for r in cnt:
            if cum + r["n"] >= k:
                chosen = r
                break
            cum += r["n"]
        prefix, offset = chosen["b"], cum
        if chosen["n"] > max_boundary_rows and len(prefix) < 32 and chosen["n"] * 16 <= left:
            df = materialize(df.where(F.substring(order_key, 1, len(prefix)) == F.lit(prefix)).select(order_key), "boundary")
            left = chosen["n"]
        if chosen["n"] <= max_boundary_rows or len(prefix) >= 32:
            row = df.where(F.substring(order_key, 1, len(prefix)) == F.lit(prefix)) \
                .select(order_key).orderBy(order_key).offset(k - offset - 1).limit(1).collect()
            return row[0][0], n
