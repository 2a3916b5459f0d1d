"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000     # a key is hot from 1/HOT_KEYS of all rows on, so there are at most so many


def join_hot(rows: DataFrame, per_key: DataFrame, on: list[str], count_col: str,
             total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row for each key and, in
    ``count_col``, at most the number of rows with that key.

    The counts name the hot keys. At most ``HOT_KEYS`` keys can hold 1/HOT_KEYS of the
    rows each, so those are broadcast and their rows stay where they are; the others are
    joined by a shuffle in which no key is large. Null keys match nothing. ``total``: the
    sum of the counts, if known; else it is taken first.
    """
    if total is None:
        total = per_key.agg(F.sum(count_col)).first()[0] or 0
    is_hot = F.col(count_col) > max(total // HOT_KEYS, HOT_KEYS)
    hot = F.broadcast(per_key.where(is_hot))
    cold = per_key.where(~is_hot)
    keys = F.broadcast(per_key.where(is_hot).select(*on))
    return rows.join(hot, on).unionByName(rows.join(keys, on, "left_anti").join(cold, on))
