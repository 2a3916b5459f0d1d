"""Exact quantiles by narrowing, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import positions as P


@pytest.mark.parametrize("cells", [2, 7, 1024])
def test_quantiles_equal_numpy(spark, monkeypatch, cells):
    monkeypatch.setattr(P, "CELLS", cells)
    r = np.random.default_rng(cells)
    groups = {"even": r.random(400), "crowded": 1.0 + r.random(300) * 1e-9, "one": np.array([2.5]), "two": np.array([-1.0, 4.0]),
              "ties": r.integers(0, 4, 500).astype(float), "wide": np.concatenate([r.standard_normal(50), [1e300, -1e300]]),
              "same": np.full(90, 3.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {x.g: x for x in P.exact_quantiles(P.value_counts(df, "v", ["g"]), "v", ["g"], probs).collect()}
    for g, vs in groups.items():
        assert got[g]._n == len(vs) and (got[g]._lo, got[g]._hi) == (vs.min(), vs.max())
        assert np.allclose(got[g]._q, np.quantile(vs, probs), rtol=1e-12, atol=0)
    whole = P.exact_quantiles(P.value_counts(df, "v"), "v", [], [0.25, 0.75]).first()
    assert np.allclose(whole._q, np.quantile([v for _, v in rows], [0.25, 0.75]), rtol=1e-12, atol=0)


def test_no_aggregate_holds_the_values_of_a_group(spark, small_dir):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7).alias("v"))
    plan = P.auto_bin_stats(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
