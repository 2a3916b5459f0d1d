"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, seed: str,
                    id_col: str = "doc_id", text_col: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """(id, text, label, weight, *also): about ``per_class`` documents of each class 0 and 1 (all
    of a smaller class), chosen by a hash of the id; weight is how many labelled documents
    one stands for.

    ``labels`` (id, label) is sampled first, so at most about twice ``per_class`` rows of
    ids are broadcast and the texts are not shuffled. Labels other than 0 and 1 and null
    ids are left out; an id labelled both ways counts as 1.
    """
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")) \
        .where("__id IS NOT NULL AND label IN (0, 1)").groupBy("__id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    rate = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    stands_for = F.when(F.col("label") == 1, 1 / share.get(1, 1.0)).otherwise(1 / share.get(0, 1.0))
    chosen = marks.where(draw < rate).withColumn("weight", stands_for)
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), *also) \
        .join(F.broadcast(chosen), "__id").withColumnRenamed("__id", "id")
