"""Label ETL: flags from composite labels, fitted class codes, one-hot and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_flag, member_flag, one_hot as one_hot_expr
from ..session import broadcast_small
from ..sources.tables import LABEL_NAMES, NEGATIVE

FLAG_COLUMNS = tuple(f"flag_{t}" for t in LABEL_NAMES)


def flags_inclusive(df: DataFrame, label_col: str = "tags",
                    targets: Sequence[str] = LABEL_NAMES) -> DataFrame:
    """flag_<t> = target t is a member of the composite label; plus negative / any."""
    cols = [member_flag(label_col, t).alias(f"flag_{t}") for t in targets]
    return df.select("*", *cols, *_neg_any(label_col))


def flags_exclusive(df: DataFrame, label_col: str = "tags",
                    targets: Sequence[str] = LABEL_NAMES) -> DataFrame:
    """flag_<t> = the label is exactly t."""
    cols = [exact_flag(label_col, t).alias(f"flag_{t}") for t in targets]
    return df.select("*", *cols, *_neg_any(label_col))


def _neg_any(label_col: str):
    neg = (F.col(label_col) == F.lit(NEGATIVE)).cast("int")
    return [neg.alias("negative"), (F.lit(1) - neg).alias("activated_any")]


def exact_group(label_col: str = "tags", targets: Sequence[str] = LABEL_NAMES,
                other_group: str = NEGATIVE):
    """Group of a row by exact label: one of the targets, else ``other_group``."""
    e = F.lit(other_group)
    for t in reversed(list(targets)):
        e = F.when(F.col(label_col) == F.lit(t), F.lit(t)).otherwise(e)
    return e


def fit_label_codes(df: DataFrame, label_col: str = "tags") -> DataFrame:
    """(label, code): distinct labels in ascending string order -> 0..k-1.

    The distinct set is small by nature (classes); the numbering window runs on it only.
    """
    d = df.select(F.col(label_col).alias("label")).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))


def label_encode(df: DataFrame, codes: DataFrame, label_col: str = "tags",
                 code_col: str = "num_label", handle_invalid: str = "error") -> DataFrame:
    """Attach the fitted code; unseen label -> error (default) or ``keep`` (code k)."""
    if handle_invalid not in ("error", "keep"):
        raise ValueError("handle_invalid must be 'error' or 'keep'")
    c = codes.select(F.col("label").alias("_lbl"), F.col("code").alias("_code"))
    # the codes are few: broadcast, so that a label held by most rows isn't one task's
    j = df.join(broadcast_small(c), F.col(label_col) == F.col("_lbl"), "left")
    if handle_invalid == "error":
        val = F.when(F.col("_code").isNull(),
                     F.raise_error(F.concat(F.lit("unseen label: "), F.col(label_col)))
                     ).otherwise(F.col("_code"))
    else:
        k = codes.count()  # number of fitted classes: a scalar
        val = F.coalesce(F.col("_code"), F.lit(k))
    return j.withColumn(code_col, val.cast("int")).drop("_lbl", "_code")


def target_vector(df: DataFrame, flags: Sequence[str] = FLAG_COLUMNS,
                  with_negative: bool = False, out: str = "target") -> DataFrame:
    cols = list(flags) + (["negative"] if with_negative else [])
    return df.withColumn(out, F.array(*[F.col(c) for c in cols]))


VALID_SINGLE = ("flag_Q", "flag_T", "flag_X", "activated_any", "negative", "multilabel")


def single_target(df: DataFrame, label: str) -> DataFrame:
    """``target`` and ``label`` for one named label column; unknown names raise now."""
    if label not in VALID_SINGLE:
        raise ValueError(f"no label column {label!r}; known: {', '.join(VALID_SINGLE)}")
    if label == "multilabel":
        return target_vector(df).withColumn("label", F.lit(label))
    return df.withColumn("target", F.col(label)).withColumn("label", F.lit(label))


def one_hot(df: DataFrame, code_col: str, k: int, out: str = "one_hot") -> DataFrame:
    return df.withColumn(out, one_hot_expr(code_col, k))
