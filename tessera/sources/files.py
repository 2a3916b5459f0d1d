"""File sources and sinks: sequence CSVs, partitioned tables, vocabulary JSON, lookup
matrices, delta stores and scorer weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_small

SEQUENCE_SCHEMA = T.StructType([
    T.StructField("seq_id", T.LongType()),
    T.StructField("chain_a", T.StringType()),
    T.StructField("chain_b", T.StringType()),
    T.StructField("tags", T.StringType()),
])


CORRUPT = "_corrupt"


def read_sequences(spark: SparkSession, path: str, schema: T.StructType = SEQUENCE_SCHEMA,
                   fmt: str = "csv") -> DataFrame:
    """Sequence files with a header and a declared schema (no inference). Rows that cannot be
    read, and those with a null chain, are left out (``read_checked`` returns and counts them);
    an empty chain, written as "", is kept."""
    return read_checked(spark, path, schema, fmt)[0]


def read_checked(spark: SparkSession, path: str, schema: T.StructType = SEQUENCE_SCHEMA,
                 fmt: str = "csv", header: bool = True) -> tuple[DataFrame, DataFrame, Observation]:
    """(good rows, rejects, counts). Rejects (raw, reason) are lines that do not fit the schema
    (``corrupt``: the line; other formats: rows without an id) and rows without a chain
    (``null chain``: the row as JSON). The counts (rows, corrupt, null_chain) are taken as the
    good rows are read, in the same pass, and are known once an action on them has run."""
    names = schema.fieldNames()
    if fmt == "csv":
        # an empty chain is written as "" and read as ''; nothing between the commas is null
        raw = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])) \
            .option("header", header).option("emptyValue", "").option("nullValue", "\0").option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    else:
        raw = spark.read.schema(schema).format(fmt).load(path)
        whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        raw = raw.withColumn(CORRUPT, F.when(F.col(names[0]).isNull(), whole))
    corrupt = F.col(CORRUPT).isNotNull()
    missing = ~corrupt & F.greatest(*[F.col(c).isNull() for c in names if c.startswith("chain")])
    seen = Observation("rows read")
    marked = raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(corrupt, 1)).alias("corrupt"),
                         F.count(F.when(missing, 1)).alias("null_chain"))
    good = marked.where(~corrupt & ~missing).select(*names)
    as_json = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rejects = raw.where(corrupt | missing).select(
        F.when(corrupt, F.col(CORRUPT)).otherwise(as_json).alias("raw"), F.when(corrupt, "corrupt").otherwise("null chain").alias("reason"))
    return good, rejects, seen


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)         # '' is written as "", null as nothing
    else:
        w.format(fmt).save(path)


def write_corpus(lines: DataFrame, path: str) -> None:
    """One text line per row (the tokenizer training file)."""
    lines.select("line").write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of a corpus folder, empty ones included."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def append_metrics(rows: DataFrame, path: str, run: str) -> None:
    """Add the scalar-log rows (split, tag, step, value) of a run to a log folder. The folders
    of the steps written, run=/step=, are replaced and no others, so an epoch that is tried
    again is in the log once."""
    rows.withColumn("run", F.lit(run)).repartition("step").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("run", "step").parquet(path)


def read_metrics(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(run, split, tag, step, value) of a log folder, or of one run's folder in it."""
    log = spark.read.schema("split string, tag string, value double, run string, step long").parquet(path)
    return log if run is None else log.where(F.col("run") == run)


def write_run_logs(log: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A scalar log as one JSON folder per run. Each run is dealt to as many tasks as its
    rows need (one file each), so a run that holds most rows isn't one task's. The tasks put
    their files in place themselves: the driver would move those of all runs one by one."""
    n = log.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    part = F.pmod(F.xxhash64(*[c for c in log.columns if c != "run"]), F.col("_files")).cast("int")
    dealt = log.join(broadcast_small(n), "run").withColumn("_part", part).drop("_files")
    dealt.repartition("run", "_part").drop("_part").write.mode("overwrite").partitionBy("run") \
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def vocab_to_json(vocab: DataFrame) -> DataFrame:
    """One row holding the tokenizer-style JSON document of a (bounded) vocabulary."""
    # entries in id order, so the document is the same however the rows were partitioned
    entries = F.array_sort(F.collect_list(F.struct("id", "token")))
    m = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["token"], e["id"])))
    doc = F.to_json(F.struct(F.struct(F.lit("WordLevel").alias("type"), m.alias("vocab"),
                                      F.lit("<unk>").alias("unk_token")).alias("model")))
    return vocab.agg(doc.alias("json"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab_to_json(vocab).coalesce(1).write.mode("overwrite").text(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Tokenizer JSON -> (token, id); merges (if any) -> see ``read_merges``."""
    doc = spark.read.option("wholetext", True).text(path)
    schema = "model struct<vocab: map<string,int>, merges: array<string>>"
    j = doc.select(F.from_json("value", schema).alias("j"))
    return j.select(F.explode("j.model.vocab").alias("token", "id"))


def write_bpe(spark: SparkSession, ids: dict[str, int], merges: Sequence[tuple[str, str]],
              path: str) -> None:
    """Tokenizer-style JSON of a trained BPE: vocabulary (in id order) and merges as
    'left right' strings in rank order. Both are bounded by the merge budget."""
    vocab = sorted(ids.items(), key=lambda kv: kv[1])
    doc = spark.createDataFrame([(vocab, [f"{a} {b}" for a, b in merges])],
                                "v array<struct<token:string,id:int>>, merges array<string>")
    m = F.map_from_entries(F.transform("v", lambda e: F.struct(e["token"], e["id"])))
    out = doc.select(F.to_json(F.struct(F.struct(F.lit("BPE").alias("type"), m.alias("vocab"),
                                                  F.col("merges")).alias("model"))).alias("json"))
    out.coalesce(1).write.mode("overwrite").text(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.option("wholetext", True).text(path)
    j = doc.select(F.from_json("value", "model struct<merges: array<string>>").alias("j"))
    m = j.select(F.posexplode("j.model.merges").alias("rank", "m"))
    parts = F.split("m", " ")
    return m.select("rank", parts[0].alias("left"), parts[1].alias("right"))


def write_lookup(rows: DataFrame, symbols: DataFrame, path: str) -> None:
    """A numeric matrix as CSV text: a header naming a column per symbol (token, k; in the
    order of k), then one line per symbol. ``rows``: (k, symbol, vec). Symbols hold no commas."""
    names = symbols.agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("s"))
    head = names.select(F.lit(-1).cast("long").alias("k"), F.concat_ws(",", F.lit("symbol"), F.transform("s", lambda e: e["token"])).alias("line"))
    body = rows.select(F.col("k").cast("long").alias("k"), F.concat_ws(",", F.col("symbol"), F.col("vec").cast("array<string>")).alias("line"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("line").write.mode("overwrite").text(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A numeric matrix of ``write_lookup`` -> (symbol, vec ARRAY<DOUBLE>), columns in file
    order. The plan is the same for any number of columns."""
    parts = F.split("value", ",")
    return spark.read.text(path).where(~F.col("value").startswith("symbol,")) \
        .select(parts[0].alias("symbol"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<double>").alias("vec"))


def write_deltas(mean: DataFrame, path: str) -> None:
    """Delta tables stored by chain and group (partition folders chain=/grp=)."""
    mean.write.mode("overwrite").partitionBy("chain", "grp").parquet(path)


def read_deltas(spark: SparkSession, path: str, chain: str | None = None,
                grp: str | None = None) -> DataFrame:
    """Filtered read: the chain/grp predicates prune partition folders."""
    d = spark.read.parquet(path)
    if chain is not None:
        d = d.where(F.col("chain") == chain)
    if grp is not None:
        d = d.where(F.col("grp") == grp)
    return d
