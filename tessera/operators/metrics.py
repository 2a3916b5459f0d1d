"""Multi-label evaluation: threshold, confusion, accuracies, precision/recall, loss, ROC.

Inputs are the wide form the reference uses (one row per item, ``prob`` and ``target``
arrays of L labels) or its long form (one row per item and label). Every metric is a
single grouped aggregate (partial aggregation before the shuffle); ROC uses the K2
prefix-sum kernel instead of a global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import argmax, bce, check_threshold, round_even, safe_ratio
from ..session import materialize
from .kernels import prefix_aggregate


def predict(df: DataFrame, t: float = 0.5, round_digits: int | None = None,
            prob: str = "prob", out: str = "pred") -> DataFrame:
    """0/1 array, strict p > t after optional half-even rounding."""
    check_threshold(t)
    return df.withColumn(out, F.transform(
        prob, lambda p: (round_even(p, round_digits) > F.lit(t)).cast("int")))


def to_long(df: DataFrame, labels: Sequence[str], keep: Sequence[str] = ("seq_id",),
            arrays: Sequence[str] = ("prob", "target", "pred")) -> DataFrame:
    """N x L arrays -> one row per (item, label)."""
    present = [a for a in arrays if a in df.columns]
    z = F.arrays_zip(*[F.col(a) for a in present], F.array(*[F.lit(x) for x in labels]).alias("label"))
    x = df.select(*keep, F.explode(z).alias("_z"))
    return x.select(*keep, *[F.col(f"_z.{a}").alias(a) for a in present], F.col("_z.label").alias("label"))


def confusion_long(df: DataFrame, by: Sequence[str] = ("label",), pred: str = "pred",
                   target: str = "target") -> DataFrame:
    """tn, fp, fn, tp per group of a long table."""
    p, t = F.col(pred), F.col(target)
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*by).agg(s((p == 0) & (t == 0)).alias("tn"), s((p == 1) & (t == 0)).alias("fp"),
                               s((p == 0) & (t == 1)).alias("fn"), s((p == 1) & (t == 1)).alias("tp"))


def _cell(i: int, c: str) -> Column:
    return F.col(c)[i]


def metric_bundle(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ("split",),
                  digits: int = 6) -> DataFrame:
    """One pass: rows, subset accuracy, element accuracy, BCE loss, recall and precision
    per label (0 on an empty denominator). Needs ``prob``, ``target``, ``pred`` arrays."""
    L = len(labels)
    exact = F.avg((F.col("pred") == F.col("target").cast("array<int>")).cast("double"))
    hits = F.aggregate(F.zip_with("pred", "target", lambda p, t: (p == t).cast("int")),
                       F.lit(0), lambda a, v: a + v)
    loss = F.aggregate(F.zip_with("target", "prob", lambda t, p: bce(t, p)), F.lit(0.0),
                       lambda a, v: a + v)
    aggs = [F.count(F.lit(1)).alias("n"), exact.alias("indv_acc"),
            (F.sum(hits) / (F.count(F.lit(1)) * L)).alias("acc"),
            (F.sum(loss) / (F.count(F.lit(1)) * L)).alias("loss")]
    for i, lb in enumerate(labels):
        p, t = _cell(i, "pred"), _cell(i, "target")
        aggs += [F.sum(p * t).alias(f"_tp{i}"), F.sum(p * (1 - t)).alias(f"_fp{i}"),
                 F.sum((1 - p) * t).alias(f"_fn{i}")]
    g = df.groupBy(*by).agg(*aggs)
    cols = [*by, "n", F.round("indv_acc", digits).alias("indv_acc"),
            F.round("acc", digits).alias("acc"), F.round("loss", digits).alias("loss")]
    for i, lb in enumerate(labels):
        tp, fp, fn = F.col(f"_tp{i}"), F.col(f"_fp{i}"), F.col(f"_fn{i}")
        cols += [F.round(safe_ratio(tp, tp + fn), digits).alias(f"recall_{lb}"),
                 F.round(safe_ratio(tp, tp + fp), digits).alias(f"precision_{lb}")]
    return g.select(*cols)


def correct_count(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows whose arg-max probability is the arg-max (first positive) of the target."""
    hit = (argmax("prob") == argmax(F.col("target").cast("array<double>"))).cast("long")
    return df.groupBy(*by).agg(F.sum(hit).alias("n_correct"), F.count(F.lit(1)).alias("n"))


def roc_curve(long: DataFrame, by: Sequence[str] = ("label",), score: str = "prob",
              target: str = "target", buckets: int | None = None) -> DataFrame:
    """ROC points per group: one row per distinct score (descending) with cumulative
    fpr/tpr, plus the previous point (for the trapezoid). Ties share one point.

    The per-score table feeds several consumers (count, quantiles, bucket sums, the final
    pass), so it is written once to the shared checkpoint folder and read back. The group
    totals come with the bucket offsets; no row is joined on its label."""
    by = list(by)
    per_score = materialize(long.groupBy(*by, score).agg(
        F.sum(F.col(target)).cast("long").alias("pos"),
        F.sum(F.lit(1) - F.col(target)).cast("long").alias("neg")), "roc-per-score")
    x = prefix_aggregate(per_score, by, score, ["pos", "neg"], "sum", buckets, descending=True, totals=True)
    P, N = F.col("pos_total"), F.col("neg_total")
    return x.select(*by, F.col(score).alias("threshold"), safe_ratio(F.col("neg_cum"), N).alias("fpr"),
                    safe_ratio(F.col("pos_cum"), P).alias("tpr"), safe_ratio(F.col("neg_prev"), N).alias("fpr_prev"),
                    safe_ratio(F.col("pos_prev"), P).alias("tpr_prev"))


def with_origin(points: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """ROC points (*by, threshold, fpr, tpr) with the start point (0, 0) of every group, at
    a threshold above all scores."""
    start = points.select(*by).distinct().select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.select(*by, "threshold", "fpr", "tpr").unionByName(start)


def roc_auc(long: DataFrame, by: Sequence[str] = ("label",), score: str = "prob",
            target: str = "target", buckets: int | None = None) -> DataFrame:
    pts = roc_curve(long, by, score, target, buckets)
    area = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / 2.0
    return pts.groupBy(*by).agg(F.round(F.sum(area), 6).alias("auc"))


def batch_macro(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ("split",),
                batch: str = "batch_id") -> DataFrame:
    """Metric per batch, then the mean of the batch values (the deprecated loop's rule)."""
    per = metric_bundle(df, labels, by=[*by, batch], digits=15)
    metrics = [c for c in per.columns if c not in (*by, batch, "n")]
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"),
                                *[F.round(F.avg(c), 6).alias(c) for c in metrics])
