"""Session helpers: one place for the Spark settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and partition counts from
# measured sizes, so broadcasts of data-dependent tables are decided at run time.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "tessera", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the session the platform gives you."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**BASE_CONF, **(extra_conf or {})}.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform to a shared file system and is only
    read here. Only when it is unset (local tests) a private folder is created.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        return d
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):       # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage: checkpoints "
                           "and materialized tables must survive the loss of an executor")
    d = tempfile.mkdtemp(prefix="tessera-ckpt-")   # local mode only (tests)
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for sinks that are read back."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


#: Writer options for tables with rows of some MB. A reader takes a whole row group, and sends it
#: to Python at once, so it gets few rows, whatever their size is when compressed.
LARGE_ROWS = {"parquet.block.row.count.limit": "2"}


def materialize(df, name: str, options: dict[str, str] | None = None):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back:
    cuts the lineage for a table that several later jobs read (survives executor loss,
    unlike a local checkpoint). Returns the re-read DataFrame. ``options``: of the writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return df.sparkSession.read.parquet(path)


MAX_BROADCAST_ROWS = 100_000


def broadcast_small(df, max_rows: int = MAX_BROADCAST_ROWS):
    """``df`` with a broadcast hint if it is seen to have at most ``max_rows`` (narrow)
    rows; otherwise as it is, so that the join shuffles and AQE splits hot keys."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
