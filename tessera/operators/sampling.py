"""Seeded splits, balanced samples, batches and shuffles on top of the K1 rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import global_index, rank_threshold


def split_exact(df: DataFrame, train_fraction: float = 0.7, key: str = "h",
                split_col: str = "split") -> DataFrame:
    """Exact-size seeded split: the first ceil(f * n) rows in seeded order are 'train'.

    ``f * n`` is a double product, as in the reference library (so 0.55 * 100 -> 56).
    The boundary key value is found with a few small aggregates (``rank_threshold``);
    the split itself is then a row-local predicate ``key <= boundary`` (no shuffle, and
    a filter on it pushes down like any other).
    """
    h = split_boundary(df, train_fraction, key)
    return apply_split(df, h, key, split_col)


def split_boundary(df: DataFrame, train_fraction: float = 0.7, key: str = "h") -> str | None:
    """Key value of rank ceil(f * n): rows with key <= it are 'train' (None: no row)."""
    h, _ = rank_threshold(df, key, lambda n: math.ceil(float(train_fraction) * float(n)))
    return h


def apply_split(df: DataFrame, boundary: str | None, key: str = "h", split_col: str = "split") -> DataFrame:
    cond = F.lit(False) if boundary is None else (F.col(key) <= F.lit(boundary))
    return df.withColumn(split_col, F.when(cond, F.lit("train")).otherwise(F.lit("test")))


def balanced_sample(df: DataFrame, label_col: str, key: str = "h") -> DataFrame:
    """m = smallest class size; keep the first m rows of every class in seeded order."""
    x = global_index(df, key, by=[label_col], index_col="_i", min_total_col="_m")
    return x.where(F.col("_i") <= F.col("_m")).drop("_i", "_m")


def batch_assign(df: DataFrame, batch_size: int, key: str = "h", batch_col: str = "batch_id",
                 index_col: str = "row_index", by: list[str] | tuple = ()) -> DataFrame:
    """Batch number of each row in seeded order (key = md5 column) or natural key order."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    x = global_index(df, key, by=by, index_col=index_col)
    return x.withColumn(batch_col, F.floor((F.col(index_col) - 1) / F.lit(batch_size)).cast("long"))


def seeded_shuffle(df: DataFrame, key: str = "h", index_col: str = "shuffle_pos") -> DataFrame:
    """Position of each row in the seeded order (exact, distributed)."""
    return global_index(df, key, index_col=index_col)
