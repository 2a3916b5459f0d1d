"""Randomised properties of the rank / prefix kernels (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import kernels as KN

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10_000), st.sampled_from(["a", "b", "c"])),
                min_size=1, max_size=300, unique_by=lambda t: t[0]))
def test_global_index_is_row_number(spark, rows):
    df = spark.createDataFrame(rows, "k long, g string").withColumn("h", F.md5(F.col("k").cast("string")))
    got = KN.global_index(df, "h", by=["g"], digits=1).select("k", "idx").collect()
    want = df.select("k", F.row_number().over(Window.partitionBy("g").orderBy("h")).alias("idx")).collect()
    assert sorted(got) == sorted(want)


@SETTINGS
@given(st.sets(st.integers(0, 100_000), min_size=1, max_size=400), st.floats(0.0, 1.0))
def test_rank_threshold_is_kth_smallest(spark, keys, frac):
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(F.md5(F.col("k").cast("string")).alias("h"))
    hs = sorted(r["h"] for r in df.collect())
    k = max(1, min(len(hs) - 1, int(frac * len(hs)))) if len(hs) > 1 else 1
    got, n = KN.rank_threshold(df, "h", k, digits=1, max_boundary_rows=20, first_digits=1)
    assert n == len(hs)
    if k < n:
        assert got == hs[k - 1]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["r1", "r2"]), st.integers(-5, 5)), min_size=1, max_size=300),
       st.booleans())
def test_prefix_sum_is_window(spark, rows, desc):
    data = [(g, i, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    got = KN.prefix_aggregate(df, ["g"], "o", ["v"], "sum", buckets=7, descending=desc) \
        .select("g", "o", "v_cum").collect()
    order = F.col("o").desc() if desc else F.col("o")
    w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "o", F.sum("v").over(w).alias("v_cum")).collect()
    assert sorted(got) == sorted(want)
