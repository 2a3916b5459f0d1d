"""Stage F queries on run logs: running loss, records, best step, summaries, trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import runs as R
from ..session import materialize, scratch_path
from ..sources import files as FS
from ..sources import tables as T
from ..sources.tables import LABEL_NAMES
from .q_scoring import EPOCH_SQL, model_scores
from .registry import add_view, query, with_views

add_view("trials", ("runs",), """
  SELECT run,
         [8, 16, 24, 32][CAST(floor(u_bs * 4) AS INT) + 1] AS batch_size,
         round((floor(u_lr * 100) + 1) * 1e-5::DOUBLE, 8) AS learning_rate,
         [0.1E0, 0.2E0, 0.3E0, 0.4E0, 0.5E0][CAST(floor(u_do * 5) AS INT) + 1] AS dropout,
         [0.0E0, 0.001E0, 0.01E0, 0.1E0][CAST(floor(u_wd * 4) AS INT) + 1] AS weight_decay
  FROM (SELECT run,
               CAST(CAST('0x' || substr(md5(concat('1964-batch_size-', run)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0E0 AS u_bs,
               CAST(CAST('0x' || substr(md5(concat('1964-learning_rate-', run)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0E0 AS u_lr,
               CAST(CAST('0x' || substr(md5(concat('1964-dropout-', run)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0E0 AS u_do,
               CAST(CAST('0x' || substr(md5(concat('1964-weight_decay-', run)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0E0 AS u_wd
        FROM (SELECT DISTINCT run FROM runs) d) u""")


def runs(spark, sf):
    return T.runs(spark, sf)


@query("running_loss", with_views("""
SELECT run, tag, step,
       sum(CAST(round(value * 10000) AS BIGINT)) OVER w / (count(*) OVER w * 10000.0E0) AS running_mean
FROM runs
WINDOW w AS (PARTITION BY run, tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "runs"))
def running_loss(spark, sf):
    # the log values are cents / 100: fixed-point with 4 decimals
    r = R.running_mean(runs(spark, sf), fixed_scale=4)
    return r.select("run", "tag", "step", "running_mean")


@query("epoch_loss", with_views("""
SELECT run, tag, epoch, n, s / (n * 10000.0E0) AS epoch_mean,
       sum(s) OVER w / (sum(n) OVER w * 10000.0E0) AS running_mean
FROM (SELECT user_id AS run, event_type AS tag, CAST(ts AS DATE) AS epoch, count(*) AS n,
             sum(CAST(round(value / 100 * 10000) AS BIGINT)) AS s
      FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)) p
WINDOW w AS (PARTITION BY run, tag ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def epoch_loss(spark, sf):
    """Loss per epoch (one epoch = one UTC day of a run's log): per-epoch mean and the
    never-reset running mean logged at the epoch's end."""
    ev = T.table(spark, sf, "events")
    log = ev.select(F.col("user_id").alias("run"), F.col("event_type").alias("tag"),
                    F.to_date("ts").alias("epoch"), (F.col("value") / 100).alias("value"))
    return R.epoch_loss(log, fixed_scale=4)


@query("best_so_far", with_views("""
SELECT run, tag, step, round(min(value) OVER w, 6) AS best,
       CASE WHEN min(value) OVER p IS NULL OR value < min(value) OVER p THEN 1 ELSE 0 END AS is_record
FROM runs
WINDOW w AS (PARTITION BY run, tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       p AS (PARTITION BY run, tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "runs"))
def best_so_far(spark, sf):
    r = R.records(runs(spark, sf))
    return r.select("run", "tag", "step", F.round("best", 6).alias("best"), "is_record")


@query("best_epoch", with_views("""
SELECT run, tag, step AS best_step, value AS best_value
FROM (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY value DESC, step) AS rn FROM runs) r
WHERE rn = 1""", "runs"))
def best_epoch(spark, sf):
    return R.best_step(runs(spark, sf))


@query("trial_table", with_views("SELECT * FROM trials", "trials"))
def trial_table(spark, sf):
    return R.trial_table(runs(spark, sf))


@query("run_summary", with_views("""
SELECT s.run, s.tag, s.n, s.max_value, s.mean_value, t.batch_size, t.learning_rate, t.dropout, t.weight_decay
FROM (SELECT run, tag, count(*) AS n, max(value) AS max_value, round(avg(value), 6) AS mean_value
      FROM runs GROUP BY run, tag) s JOIN trials t ON s.run = t.run""", "runs", "trials"))
def run_summary(spark, sf):
    """Parameters of every run with the aggregates of each of its tags, written and read back."""
    r = runs(spark, sf)
    path = scratch_path(spark, "run-summary")
    R.summary(r).join(R.trial_table(r), "run").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("leaderboard", with_views("""
SELECT run, round(avg(value), 6) AS test_loss FROM runs WHERE tag = 'error'
GROUP BY run ORDER BY test_loss, run LIMIT 3""", "runs"))
def leaderboard(spark, sf):
    # top-3 experiments minimising the objective (a limit is the feature: top-k)
    r = runs(spark, sf).where(F.col("tag") == "error")
    s = r.groupBy("run").agg(F.round(F.avg("value"), 6).alias("test_loss"))
    return s.orderBy("test_loss", "run").limit(3)


_LONG_CELLS = [("'Loss/' || split || ':'", "loss"), ("'Accuracy/' || split || ':'", "acc"),
               ("'Individual Accuracy/' || split || ':'", "indv_acc")]
for _lb in LABEL_NAMES:
    _LONG_CELLS += [(f"'Recall/{_lb}_' || split", f"recall_{_lb}"),
                    (f"'Precision/{_lb}_' || split", f"precision_{_lb}")]
THRESHOLDS = (0.4, 0.5, 0.6)       # of the steps of the written log
METRICS_LONG_SQL = "WITH " + ",\n".join(
    f"em{e} AS (" + EPOCH_SQL.strip().replace("0.5E0", f"{t}E0") + ")" for e, t in enumerate(THRESHOLDS)) + "\n" + "\nUNION ALL\n".join(
    f"SELECT split, {t} AS tag, CAST({e} AS BIGINT) AS step, CAST({c} AS DOUBLE) AS value FROM em{e}"
    for e in range(len(THRESHOLDS)) for t, c in _LONG_CELLS)


@query("metrics_long", with_views(METRICS_LONG_SQL, "model_scores"))
def metrics_long(spark, sf):
    """Scalar-log rows of each step, over the whole of both splits with a threshold of its
    own, written to a log folder step by step; the last is written twice, as after a retry."""
    path = scratch_path(spark, "metrics-log")
    scores = materialize(model_scores(spark, sf).select("split", "prob", "target"), "scores")     # read by every step
    for e in (*range(len(THRESHOLDS)), len(THRESHOLDS) - 1):
        wide = M.metric_bundle(M.predict(scores, THRESHOLDS[e]), LABEL_NAMES, by=["split"]) \
            .withColumn("epoch", F.lit(e).cast("long"))
        FS.append_metrics(R.metrics_long(wide, LABEL_NAMES, step_col="epoch"), path, run="scorer")
    return FS.read_metrics(spark, path).select("split", "tag", "step", "value")


@query("run_logs_scan", with_views("SELECT run, tag, step, value FROM runs", "runs"))
def run_logs_scan(spark, sf):
    """Write the scalar log as one folder per run (JSON), then load every run of the
    folder tree into one table; the run comes from each file's path."""
    path = scratch_path(spark, "run-logs")
    FS.write_run_logs(runs(spark, sf), path)
    back = spark.read.schema("tag string, step long, value double") \
        .option("recursiveFileLookup", "true").json(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"run=(-?\d+)", 1).cast("long")
    return back.select(run.alias("run"), "tag", "step", "value")
