"""Column expressions (JVM-side, whole-stage-codegen friendly) used by every operator.

All functions take and return ``Column``; none of them touches Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the five special tokens that precede learned symbols.
SPECIAL_TOKENS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")
LABEL_SEPARATOR = "[|]"     # composite labels are parts joined by '|'


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(s: Column | str) -> Column:
    """String -> array of characters; '' gives [] (split alone would give [''])."""
    return F.when(_c(s) == "", F.array().cast("array<string>")).otherwise(F.split(_c(s), ""))


def spaced(s: Column | str) -> Column:
    """Characters separated by one space (the word-level corpus line)."""
    return F.array_join(chars(s), " ")


def label_parts(label: Column | str) -> Column:
    return F.split(_c(label), LABEL_SEPARATOR)


def member_flag(label: Column | str, target: str) -> Column:
    """Inclusive flag: 1 if ``target`` is one of the parts of the composite label."""
    return F.array_contains(label_parts(label), target).cast("int")


def exact_flag(label: Column | str, target: str) -> Column:
    """Exclusive flag: 1 if the label is exactly ``target``."""
    return (_c(label) == F.lit(target)).cast("int")


def pad(ids: Column | str, length: Column | int, pad_id: int = 0) -> Column:
    """Right-pad an array to ``length`` with ``pad_id``; longer arrays stay as they are."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(_c(ids), F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), n - F.size(_c(ids)))))


def attention_mask(n: Column, length: Column | int) -> Column:
    """1 for each real token, 0 for each pad position."""
    L = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(0), L - n)))


def one_hot(code: Column | str, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == _c(code)).cast("int"))


def check_threshold(t: float) -> float:
    if t > 1 or t < 0:
        raise ValueError(f"a threshold lies in [0, 1], not at {t}")
    return t


def threshold(probs: Column | str, t: float = 0.5, round_digits: int | None = None) -> Column:
    """0/1 per probability with a strict ``p > t``; optional half-even rounding first."""
    check_threshold(t)
    return F.transform(_c(probs), lambda p: (round_even(p, round_digits) > F.lit(t)).cast("int"))


def threshold_scalar(p: Column | str, t: float = 0.5, round_digits: int | None = None) -> Column:
    check_threshold(t)
    return (round_even(_c(p), round_digits) > F.lit(t)).cast("int")


def round_even(x: Column | str, digits: int | None) -> Column:
    """Half-to-even rounding (NumPy's rule); ``None`` = no rounding."""
    return _c(x) if digits is None else F.bround(_c(x), digits)


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softmax(logits: Column | str) -> Column:
    """Softmax over an array, shifted by its maximum for stability."""
    a = _c(logits)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(a: Column | str) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(_c(a), F.array_max(_c(a))).cast("int") - 1


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (precision/recall convention)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def clamped_log(p: Column) -> Column:
    """ln(p) clamped at -100 (the loss convention); ln(0) is NULL and greatest skips it."""
    return F.greatest(F.ln(p), F.lit(-100.0))


def bce(target: Column, p: Column) -> Column:
    t = target.cast("double")
    return -(t * clamped_log(p) + (F.lit(1.0) - t) * clamped_log(F.lit(1.0) - p))


def dot(x: Column | str, w: Sequence[float] | Column, bias: float = 0.0) -> Column:
    """Linear combination of a stored vector with weights (dense layer, scoring only)."""
    wc = F.array(*[F.lit(float(v)) for v in w]) if not isinstance(w, Column) else w
    return F.aggregate(F.zip_with(_c(x), wc, lambda a, b: a * b), F.lit(float(bias)),
                       lambda acc, v: acc + v)


def replace_at(s: Column | str, pos0: Column, sym: Column) -> Column:
    """Replace the character at 0-based ``pos0`` by ``sym``."""
    return F.overlay(_c(s), sym, pos0 + 1, F.lit(1))


def relative_position(idx: Column, length: Column) -> Column:
    return idx.cast("double") / length.cast("double")


def hex_prefix_value(h: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex characters of an md5 string."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")
