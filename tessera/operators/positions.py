"""Symbol-by-position distributions and histograms (NumPy binning rules)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chars, relative_position
from ..session import MAX_BROADCAST_ROWS, broadcast_small, materialize

CHAINS = (("a", "chain_a"), ("b", "chain_b"))


def residue_positions(df: DataFrame, extra: Sequence[str] = ("tags",)) -> DataFrame:
    """(seq_id, *extra, chain, idx, len, aa, position): every symbol of both chains with
    its 0-based relative position idx/len (own chain length)."""
    parts = F.array(*[F.struct(F.lit(ch).alias("chain"), F.col(col).alias("s"))
                      for ch, col in CHAINS])
    x = df.select("seq_id", *extra, F.explode(parts).alias("c"))
    return _placed(x.select("seq_id", *extra, "c.chain", "c.s"), ["seq_id", *extra])


def _placed(x: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(*keep, chain, idx, len, aa, position) of the symbols of strings (*keep, chain, s)."""
    x = x.select(*keep, "chain", F.length("s").cast("long").alias("len"), F.posexplode(chars(F.lower("s"))).alias("idx", "aa"))
    return x.select(*keep, "chain", F.col("idx").cast("long").alias("idx"), "len", "aa",
                    relative_position(F.col("idx"), F.col("len")).alias("position"))


def counted_positions(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``residue_positions`` without seq_id, of the distinct chains: ``_n`` tells how many rows
    each stands for. What is counted by symbol and position reads it as well."""
    parts = F.array(*[F.struct(F.lit(ch).alias("chain"), F.col(col).alias("s")) for ch, col in CHAINS])
    x = df.select(*extra, F.explode(parts).alias("c")).select(*extra, "c.chain", "c.s").where("s <> ''")
    return _placed(x.groupBy(*extra, "chain", "s").agg(F.count(F.lit(1)).alias("_n")), [*extra, "_n"])


def _bin_expr(x: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """NumPy equal-width bin: (x - lo) * (bins / (hi - lo)), last bin closed.
    A zero range is widened to lo-0.5 .. hi+0.5 as NumPy does."""
    same = hi == lo
    lo2 = F.when(same, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(same, hi + F.lit(0.5)).otherwise(hi)
    raw = F.floor((x - lo2) * (bins.cast("double") / (hi2 - lo2)))
    return F.least(raw, bins - F.lit(1)).cast("int")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """(*by, *extra, value, _w): the one pass over the data every histogram needs
    (partial aggregation before the shuffle); the rest runs on this table, which is
    small when values repeat (relative positions take few distinct values). A row with a
    column ``_n`` stands for so many."""
    n = F.sum("_n") if "_n" in df.columns else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*by, *extra, value).agg(n.alias("_w"))


def hist_fixed(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 20,
               stat: str = "probability") -> DataFrame:
    """Equal-width histogram over each group's own [min, max], all bins (empty ones too).

    Output: *by, bin, n, prob. The data is read once (``value_counts``); bounds and bins
    are computed on the value-count table.
    """
    by = list(by)
    vc = materialize(value_counts(df, value, by), "value-counts")      # bounds and bins both read it
    stats = vc.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                F.sum("_w").alias("_tot"))
    if by:
        x = vc.join(broadcast_small(stats), by)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:                                  # two scalars, fetched as literals
        r = stats.first()
        x = vc
        lo, hi = F.lit(r["_lo"]), F.lit(r["_hi"])
    counted = x.groupBy(*by, _bin_expr(F.col(value), lo, hi, F.lit(bins)).alias("bin")) \
        .agg(F.sum("_w").alias("n"))
    # every bin of every group, empty ones included (groups x bins rows)
    grid = stats.select(*by, "_tot", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counted, [*by, "bin"], "left").fillna(0, ["n"])
    if stat == "probability":
        out = out.withColumn("prob", F.round(F.col("n") / F.col("_tot"), 6))
    return out.drop("_tot")


QUARTILES = (0.25, 0.75)
CELLS = 1024          # ranges that a pass of ``exact_quantiles`` cuts a group's values into


def exact_quantiles(counts: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], weight: str = "_w") -> DataFrame:
    """(*by, _n, _lo, _hi, _q): rows, bounds and the quantiles of a value-count table, with
    linear interpolation between neighbouring values (NumPy's rule), for finite numbers.

    The ranks are found by narrowing: a pass cuts the range that holds a rank into ``CELLS``
    equal ones, sums the weights in each by a shuffle, and goes on with the one that holds the
    rank, from its smallest to its largest value, until that is one value. No task holds more
    of a group than ``CELLS`` sums, whatever the number of its values; a hot group's rows are
    added up where they are. ``counts`` is read once a pass, so give a table that is written."""
    by = list(by)
    stats = counts.groupBy(*by).agg(F.sum(weight).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array(*[F.struct(F.lit(2 * i + j).alias("k"), (f(at(p)).cast("long") + 1).alias("rank"))
                      for i, p in enumerate(probs) for j, f in enumerate((F.floor, F.ceil))])
    stats = materialize(stats, "group-bounds")
    met = F.broadcast if stats.count() * 2 * len(probs) <= MAX_BROADCAST_ROWS else (lambda d: d)
    open_ = stats.select(*by, F.explode(ranks).alias("_t"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b")) \
        .select(*by, F.col("_t.k").alias("_k"), F.col("_t.rank").alias("_rank"), "_a", "_b")
    done = []
    while True:
        x = counts.select(*by, F.col(value).alias("_v"), F.col(weight).alias("_x")).join(met(open_), by) if by else \
            counts.select(F.col(value).alias("_v"), F.col(weight).alias("_x"), F.lit(0).alias("_g")).join(
                F.broadcast(open_.withColumn("_g", F.lit(0))), "_g").drop("_g")
        cell = F.when(F.col("_b") > F.col("_a"), F.least(F.floor(
            (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2) * CELLS), F.lit(CELLS - 1))).otherwise(0)
        sums = x.where((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b"))) \
            .groupBy(*by, "_k", "_rank", cell.alias("_cell")).agg(F.sum("_x").alias("_s"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy(*by, "_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("_upto", F.sum("_s").over(w))
        found = materialize(upto.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_s") < F.col("_rank"))).select(
            *by, "_k", (F.col("_rank") - F.col("_upto") + F.col("_s")).alias("_rank"), "_a", "_b"), "quantile-cells")
        done.append(found.where("_a = _b"))
        open_ = found.where("_a < _b")
        if open_.isEmpty():
            break
    values = done[0]
    for d in done[1:]:
        values = values.unionByName(d)
    per = values.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, F.col("_a"))).alias(f"_v{k}") for k in range(2 * len(probs))])
    joined = stats.join(per, by) if by else stats.withColumn("_g", F.lit(0)).join(per.withColumn("_g", F.lit(0)), "_g").drop("_g")
    q = [F.when(F.floor(at(p)) == F.ceil(at(p)), F.col(f"_v{2 * i}")).otherwise(
        (F.ceil(at(p)) - at(p)) * F.col(f"_v{2 * i}") + (at(p) - F.floor(at(p))) * F.col(f"_v{2 * i + 1}")) for i, p in enumerate(probs)]
    return joined.select(*by, "_n", "_lo", "_hi", F.array(*q).alias("_q"))


def _auto_width(n: Column, lo: Column, hi: Column, q: Column) -> tuple[Column, Column, Column]:
    n = n.cast("double")
    iqr = q[1] - q[0]
    fd = F.lit(2.0) * iqr * F.pow(n, F.lit(-1.0 / 3.0))
    st = (hi - lo) / (F.log2(n) + F.lit(1.0))
    width = F.when(fd > 0, F.least(fd, st)).otherwise(st)
    nb = F.when(width > 0, F.ceil((hi - lo) / width)).otherwise(F.lit(1))
    return iqr, width, nb.cast("int")


def auto_bin_stats(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """NumPy 'auto' bins per group: min(Freedman-Diaconis, Sturges) width, Sturges when
    the IQR is 0; n_bins = ceil(range / width), 1 when the width is 0. Quartiles are exact,
    or those of a sketch of 10,000 values (``exact=False``, for rows that stand for themselves alone)."""
    if exact:
        s = exact_quantiles(materialize(value_counts(df, value, by), "value-counts"), value, by, QUARTILES)
    else:
        s = df.groupBy(*by).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                F.percentile_approx(F.col(value), list(QUARTILES), 10000).cast("array<double>").alias("_q"))
    iqr, width, nb = _auto_width(F.col("_n"), F.col("_lo"), F.col("_hi"), F.col("_q"))
    return s.select(*by, F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.round(iqr, 6).alias("iqr"),
                    F.round(width, 6).alias("width"), nb.alias("n_bins"))


def hist2d(df: DataFrame, value: str, discrete: str, by: Sequence[str]) -> DataFrame:
    """Joint distribution of a binned ``value`` (auto bins per group) and a discrete
    column, as probability of the group: *by, bin, discrete, n, prob (non-empty cells).
    One pass over the data (value counts per discrete symbol); the rest is on that table."""
    by = list(by)
    vc = materialize(value_counts(df, value, by, [discrete]), "value-counts")
    stats = exact_quantiles(vc, value, by, QUARTILES)
    _, _, nb = _auto_width(F.col("_n"), F.col("_lo"), F.col("_hi"), F.col("_q"))
    stats = stats.select(*by, "_n", "_lo", "_hi", nb.alias("_nb"))
    x = vc.join(stats, by)
    b = _bin_expr(F.col(value), F.col("_lo"), F.col("_hi"), F.col("_nb"))
    out = x.groupBy(*by, b.alias("bin"), discrete).agg(F.sum("_w").alias("n"), F.first("_n").alias("_n"))
    return out.withColumn("prob", F.round(F.col("n") / F.col("_n"), 6)).drop("_n")
