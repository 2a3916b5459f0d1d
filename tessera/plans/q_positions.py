"""Stage D queries: symbol positions and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions as P
from .q_labels import seq
from .registry import query, with_views


def positions(spark, sf):
    return P.residue_positions(seq(spark, sf))


@query("residue_positions", with_views("""
SELECT seq_id, chain, idx, aa, position FROM positions""", "positions"))
def residue_positions(spark, sf):
    return positions(spark, sf).select("seq_id", "chain", "idx", "aa", "position")


@query("positions_by_symbol", with_views("""
SELECT chain, aa, position, count(*) AS n FROM positions GROUP BY chain, aa, position""",
                                         "positions"))
def positions_by_symbol(spark, sf):
    # the list of positions per symbol, as a multiset (position, n): bounded per symbol
    return P.counted_positions(seq(spark, sf)).groupBy("chain", "aa", "position").agg(F.sum("_n").alias("n"))


_HIST20 = """
WITH st AS (SELECT chain, aa, min(position) AS lo, max(position) AS hi, count(*) AS tot
            FROM positions GROUP BY chain, aa),
     b AS (SELECT p.chain, p.aa,
                  CAST(least(floor((p.position - CASE WHEN st.hi = st.lo THEN st.lo - 0.5E0 ELSE st.lo END)
                       * (20.0E0 / (CASE WHEN st.hi = st.lo THEN st.hi + 0.5E0 ELSE st.hi END
                                   - CASE WHEN st.hi = st.lo THEN st.lo - 0.5E0 ELSE st.lo END))), 19) AS INT) AS bin
           FROM positions p JOIN st ON p.chain = st.chain AND p.aa = st.aa),
     c AS (SELECT chain, aa, bin, count(*) AS n FROM b GROUP BY chain, aa, bin),
     g AS (SELECT chain, aa, tot, CAST(unnest(range(0, 20)) AS INT) AS bin FROM st)
SELECT g.chain, g.aa, g.bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / g.tot, 6) AS prob
FROM g LEFT JOIN c ON g.chain = c.chain AND g.aa = c.aa AND g.bin = c.bin"""


@query("hist20_by_symbol", with_views(_HIST20, "positions"))
def hist20_by_symbol(spark, sf):
    return P.hist_fixed(P.counted_positions(seq(spark, sf)), "position", ["chain", "aa"], bins=20)


_AUTO = """
SELECT chain, aa, n, lo, hi, round(iqr, 6) AS iqr, round(width, 6) AS width,
       CAST(CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END AS INT) AS n_bins
FROM (SELECT *, CASE WHEN fd > 0 THEN least(fd, st) ELSE st END AS width
      FROM (SELECT *, 2.0E0 * iqr * pow(CAST(n AS DOUBLE), -1.0E0 / 3.0E0) AS fd,
                   (hi - lo) / (log2(CAST(n AS DOUBLE)) + 1.0E0) AS st
            FROM (SELECT chain, aa, count(*) AS n, min(position) AS lo, max(position) AS hi,
                         quantile_cont(position, 0.75) - quantile_cont(position, 0.25) AS iqr
                  FROM positions GROUP BY chain, aa) a) b) c"""


@query("auto_bins", with_views(_AUTO, "positions"))
def auto_bins(spark, sf):
    return P.auto_bin_stats(P.counted_positions(seq(spark, sf)), "position", ["chain", "aa"])


_HIST2D = """
WITH p AS (SELECT chain, tags AS label, aa, position FROM positions
           WHERE tags IN ('Q', 'T', 'X', 'negative')),
     st AS (SELECT chain, label, n, lo, hi,
                   CAST(CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END AS INT) AS nb
            FROM (SELECT *, CASE WHEN fd > 0 THEN least(fd, st) ELSE st END AS width
                  FROM (SELECT *, 2.0E0 * iqr * pow(CAST(n AS DOUBLE), -1.0E0 / 3.0E0) AS fd,
                               (hi - lo) / (log2(CAST(n AS DOUBLE)) + 1.0E0) AS st
                        FROM (SELECT chain, label, count(*) AS n, min(position) AS lo,
                                     max(position) AS hi,
                                     quantile_cont(position, 0.75) - quantile_cont(position, 0.25) AS iqr
                              FROM p GROUP BY chain, label) a) b) c)
SELECT chain, label, bin, aa, count(*) AS n, round(count(*) / min(n_grp), 6) AS prob
FROM (SELECT p.chain, p.label, p.aa, st.n AS n_grp,
             CAST(least(floor((p.position - CASE WHEN st.hi = st.lo THEN st.lo - 0.5E0 ELSE st.lo END)
                  * (CAST(st.nb AS DOUBLE) / (CASE WHEN st.hi = st.lo THEN st.hi + 0.5E0 ELSE st.hi END
                                 - CASE WHEN st.hi = st.lo THEN st.lo - 0.5E0 ELSE st.lo END))),
                  st.nb - 1) AS INT) AS bin
      FROM p JOIN st ON p.chain = st.chain AND p.label = st.label) x
GROUP BY chain, label, bin, aa"""


@query("hist2d_symbol_position", with_views(_HIST2D, "positions"))
def hist2d_symbol_position(spark, sf):
    p = P.counted_positions(seq(spark, sf), ["tags"]).where(F.col("tags").isin("Q", "T", "X", "negative")) \
        .withColumnRenamed("tags", "label")
    return P.hist2d(p, "position", "aa", ["chain", "label"])
