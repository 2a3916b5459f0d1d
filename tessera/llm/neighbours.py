"""Rows beside their successor in the order of an id, without a window over all rows.

The ids are cut into ranges at sampled quantiles. One exchange brings the rows of a
range together, sorted; the first row of each range is also sent to the range before
it (the very first to the last), marked as a guest. A task then only has to read its
rows in order: every row's successor follows it. Ranges are a few times as many as
shuffle partitions, so they even out; each holds a bounded share of distinct ids.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES_PER_PARTITION = 16
MAX_RANGES = 20_000        # first ids that reach the driver; more rows make longer ranges


def in_order(rows: DataFrame, id_col: str, tie_col: str) -> DataFrame:
    """``rows`` with non-null integer ids plus ``__range`` and ``__guest``, partitioned by
    range and sorted by range, guests last, id, ``tie_col``. The successor of a row that
    is no guest is the row after it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MAX_RANGES, parts * RANGES_PER_PARTITION)
    ids = rows.select(F.col(id_col).cast("double").alias("__x"), F.col(id_col).alias("__id"))
    cuts = ids.agg(F.percentile_approx("__x", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or [0.0]
    split = Bucketizer(inputCol="__x", outputCol="__range",
                       splits=[float("-inf"), *sorted(set(cuts)), float("inf")])
    heads = split.transform(ids).groupBy("__range").agg(F.min("__id").alias("__id")).orderBy("__range").collect()
    before = [(h["__id"], heads[i - 1]["__range"]) for i, h in enumerate(heads)]
    before = F.broadcast(spark.createDataFrame(before, f"__id {dict(rows.dtypes)[id_col]}, __before double"))
    placed = split.transform(rows.withColumn("__x", F.col(id_col).cast("double"))).drop("__x") \
        .join(before, F.col(id_col) == F.col("__id"), "left").drop("__id")
    stays = F.struct(F.col("__range").alias("r"), F.lit(False).alias("g"))
    goes = F.struct(F.col("__before").alias("r"), F.lit(True).alias("g"))
    both = F.explode(F.when(F.col("__before").isNull(), F.array(stays)).otherwise(F.array(stays, goes)))
    return placed.withColumn("__z", both) \
        .select(*rows.columns, F.col("__z.r").alias("__range"), F.col("__z.g").alias("__guest")) \
        .repartition(parts, "__range").sortWithinPartitions("__range", "__guest", id_col, tie_col)
