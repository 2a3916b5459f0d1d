"""Score sequence files as they arrive: readStream -> stateless scoring -> parquet sink."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import flags_inclusive
from ..operators.scoring import LogOddsModel, score_log_odds
from ..sources.files import SEQUENCE_SCHEMA


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                 model: LogOddsModel, threshold: float = 0.5, fmt: str = "parquet",
                 available_now: bool = True):
    """Start a query that scores every new sequence file under ``source``.

    No state is kept (no watermark needed); the checkpoint folder (on shared storage in
    a cluster) records which files were processed, so a restarted query resumes.
    """
    schema = T.StructType([*SEQUENCE_SCHEMA.fields, T.StructField("split", T.StringType())])
    src = spark.readStream.schema(schema).format(fmt).load(source)
    scored = score_log_odds(flags_inclusive(src), model)
    out = scored.withColumn("pred", F.transform("prob", lambda p: (p > F.lit(threshold)).cast("int")))
    w = out.writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
