"""Run logs: scalar-log tables, running loss, records, best step, summaries, trials.

Per-run ordered computations use the K2 prefix kernel, so a run holding a third of
all log rows is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import prefix_aggregate

# The hyper-parameter search space of the reference optimiser.
BATCH_SIZES = (8, 16, 24, 32)                 # integer range 8..32, step 8
DROPOUTS = (0.1, 0.2, 0.3, 0.4, 0.5)          # range 0.1..0.5, step 0.1
LEARNING_RATE_STEP = 1e-5                     # range 1e-5..1e-3, step 1e-5
LEARNING_RATE_STEPS = 100
WEIGHT_DECAYS = (0.0, 0.001, 0.01, 0.1)
TRIAL_SEED = 1964


def running_mean(log: DataFrame, by: Sequence[str] = ("run", "tag"), order: str = "step",
                 value: str = "value", buckets: int | None = None,
                 fixed_scale: int | None = None) -> DataFrame:
    """Mean of all values up to and including each row, in ``order`` within ``by``.

    ``fixed_scale``: the values are fixed-point with that many decimals; the prefix sums
    then run on exact integers and the mean is one division, so the result does not
    depend on the summation order (float sums do, in the last bits).
    """
    if fixed_scale is None:
        x = log.withColumn("_v", F.col(value))
        unit = 1.0
    else:
        unit = float(10 ** fixed_scale)
        x = log.withColumn("_v", F.round(F.col(value) * F.lit(unit)).cast("long"))
    x = x.withColumn("_one", F.lit(1).cast("long"))
    c = prefix_aggregate(x, list(by), order, ["_v", "_one"], "sum", buckets)
    return c.withColumn("running_mean", F.col("_v_cum") / (F.col("_one_cum") * F.lit(unit))) \
        .drop("_v", "_v_cum", "_v_prev", "_one", "_one_cum", "_one_prev")


def epoch_loss(log: DataFrame, epoch: str = "epoch", by: Sequence[str] = ("run", "tag"),
               value: str = "value", fixed_scale: int | None = None) -> DataFrame:
    """Per epoch: the mean of that epoch's values (the deprecated trainer, reset each
    epoch) and the running mean over all values up to the epoch's last row (the current
    trainer's logged value, never reset). One grouped aggregate per (group, epoch); the
    cumulative part is a window over that per-epoch table, not over the rows."""
    by = list(by)
    if fixed_scale is None:
        v, unit = F.col(value), 1.0
    else:
        unit = float(10 ** fixed_scale)
        v = F.round(F.col(value) * F.lit(unit)).cast("long")
    per = log.groupBy(*by, epoch).agg(F.sum(v).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*by, epoch, "_n",
                      (F.col("_s") / (F.col("_n") * F.lit(unit))).alias("epoch_mean"),
                      (F.sum("_s").over(w) / (F.sum("_n").over(w) * F.lit(unit))).alias("running_mean")) \
        .withColumnRenamed("_n", "n")


def records(log: DataFrame, by: Sequence[str] = ("run", "tag"), order: str = "step",
            value: str = "value", minimise: bool = True, buckets: int | None = None) -> DataFrame:
    """Best value so far and a 'record broken' flag (strictly better than all earlier)."""
    how = "min" if minimise else "max"
    c = prefix_aggregate(log, list(by), order, [value], how, buckets)
    prev = F.col(f"{value}_prev")
    better = (F.col(value) < prev) if minimise else (F.col(value) > prev)
    return c.withColumn("best", F.col(f"{value}_cum")) \
        .withColumn("is_record", F.when(prev.isNull() | better, 1).otherwise(0)) \
        .drop(f"{value}_cum", f"{value}_prev")


def best_step(log: DataFrame, by: Sequence[str] = ("run", "tag"), order: str = "step",
              value: str = "value") -> DataFrame:
    """Row with the highest value per group, first (lowest ``order``) on ties."""
    key = F.struct(F.col(value), -F.col(order))
    return log.groupBy(*by).agg(F.max_by(F.col(order), key).alias("best_step"),
                                F.max(value).alias("best_value"))


def uniform(param: str, key: Column) -> Column:
    """Seeded uniform in [0, 1) from md5('seed-param-key')."""
    h = F.md5(F.concat(F.lit(f"{TRIAL_SEED}-{param}-"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def trial_table(runs: DataFrame, run_col: str = "run") -> DataFrame:
    """One random hyper-parameter draw per run: choices from the fixed lists, the
    learning rate on its step grid."""
    r = runs.select(run_col).distinct()
    k = F.col(run_col)
    bs = F.element_at(F.array(*[F.lit(v) for v in BATCH_SIZES]),
                      (F.floor(uniform("batch_size", k) * len(BATCH_SIZES)) + 1).cast("int"))
    do = F.element_at(F.array(*[F.lit(v) for v in DROPOUTS]),
                      (F.floor(uniform("dropout", k) * len(DROPOUTS)) + 1).cast("int"))
    wd = F.element_at(F.array(*[F.lit(v) for v in WEIGHT_DECAYS]),
                      (F.floor(uniform("weight_decay", k) * len(WEIGHT_DECAYS)) + 1).cast("int"))
    lr = (F.floor(uniform("learning_rate", k) * LEARNING_RATE_STEPS) + 1) * F.lit(LEARNING_RATE_STEP)
    return r.select(run_col, bs.alias("batch_size"), F.round(lr, 8).alias("learning_rate"),
                    do.alias("dropout"), wd.alias("weight_decay"))


def summary(log: DataFrame, by: Sequence[str] = ("run", "tag"), value: str = "value") -> DataFrame:
    """(run, tag, n, max_value, mean_value): aggregates of each tag by itself."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"),
                                F.round(F.avg(value), 6).alias("mean_value"))


# The tags of the reference's scalar log are those of ``metrics_long``.
def metrics_long(wide: DataFrame, labels: Sequence[str], split_col: str = "split",
                 step_col: str | None = None) -> DataFrame:
    """Wide metrics row -> (split, tag, step, value) scalar-log rows with the logger's tags."""
    cells = [("Loss/{s}:", "loss"), ("Accuracy/{s}:", "acc"), ("Individual Accuracy/{s}:", "indv_acc")]
    for lb in labels:
        cells += [(f"Recall/{lb}_{{s}}", f"recall_{lb}"), (f"Precision/{lb}_{{s}}", f"precision_{lb}")]
    s = F.col(split_col)
    arr = F.array(*[F.struct(F.regexp_replace(F.lit(t), r"\{s\}", s).alias("tag"),
                             F.col(c).cast("double").alias("value")) for t, c in cells])
    step = F.col(step_col) if step_col else F.lit(0).cast("long")
    return wide.select(split_col, step.alias("step"), F.explode(arr).alias("_c")) \
        .select(split_col, F.col("_c.tag").alias("tag"), "step", F.col("_c.value").alias("value"))
