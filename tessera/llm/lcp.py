"""Document fingerprints by locally consistent parsing (operator 1).

A text is parsed into phrases, the phrases into phrases of phrases, and so on. Where a
phrase ends is decided by deterministic coin tossing over the names of a few
neighbours: each symbol is replaced by the place and value of the lowest bit in which
it differs from its left neighbour, four times over, which leaves labels below 6; local
maxima of the labels start phrases. Runs of one symbol are one phrase. A phrase is
named by a hash of the names in it. So an equal substring is cut and named alike in its
interior wherever it stands, at every level, up to a bounded context at its ends.

The fingerprint is a sketch of the set of phrase names: names of levels 2, 3 and 4 and
above are dealt by hash to ``SLOTS`` slots each keeping the smallest (one-permutation
min-hash), 16 bits a slot, as hexadecimal; an empty slot is 0000. Two fingerprints'
likeness is the share of equal slots among those that either has filled.

Equal texts have equal fingerprints; null counts as empty, whose slots are all empty;
two such fingerprints have likeness 1. The parse is linear in the text, and the texts
of a slice are parsed together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, with_columns
from .neighbours import in_order

#: Slots for names of level 2, of level 3, and of level 4 and above. Names grow about
#: 2.4-fold a level: some 6, 15 and 36 characters.
SLOTS = (16, 80, 32)
LEVELS = 6
LONGEST = 16                      # of a phrase, by the bound on labels; else it is cut
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of multiplications and shifts)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def _toss_table(size: int) -> np.ndarray:
    """[left, own] -> 2 * place + bit of the lowest bit in which own differs from left."""
    own, left = np.arange(size)[None, :], np.arange(size)[:, None]
    low = (own ^ left) & -(own ^ left)
    place = np.where(low > 0, np.bitwise_count(np.maximum(low, 1) - 1), 0)
    return (2 * place + ((own >> place) & 1)).astype(np.uint8)


_TOSS = _toss_table(128)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 in which neighbours of one text differ. ``first``: where texts start."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = names[first] ^ np.uint64(1)
    left ^= names
    place = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1))
    place[place == 64] = 0                                     # equal names: hashes that met
    label = ((names >> place).astype(np.uint8) & 1) | (place << np.uint8(1))
    for _ in range(3):                                         # below 128, 14, 8, 6
        prev = np.empty_like(label)
        prev[1:] = label[:-1]
        prev[first] = label[first] ^ 1
        label = _TOSS[prev, label]
    return label


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases, and where each text's phrases start.
    ``first``: ascending starts of the (non-empty) texts in ``names``."""
    # runs of one symbol become one symbol
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first] = True
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(at, append=len(names)).astype(np.uint64)
        runs = names[at]
        long = length > 1
        runs[long] = _mix(runs[long] + length[long] * _POWERS[1])
        first = np.searchsorted(at, first)
        names = runs
    n = len(names)
    label = _labels(names, first)
    start = np.zeros(n, bool)
    if n > 2:
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        ends = first[1:] - 1                                   # a text's last symbol has no right neighbour
        start[ends] = False
    start[first] = True
    at = np.flatnonzero(start)
    offset = np.arange(n) - np.repeat(at, np.diff(at, append=n))
    while (offset >= LONGEST).any():                           # only if equal hashes broke the bound
        start |= offset % LONGEST == 0
        at = np.flatnonzero(start)
        offset = np.arange(n) - np.repeat(at, np.diff(at, append=n))
    phrase = np.add.reduceat(_mix(names) * _POWERS[offset], at)
    return _mix(phrase), np.searchsorted(at, first)


def sketches(texts: list[str | None]) -> np.ndarray:
    """uint16 [texts, slots]: the fingerprint of each text; 0 marks an empty slot."""
    total = sum(SLOTS)
    best = np.full((len(texts), total), _EMPTY, np.uint64)
    filled = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if len(filled):
        points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in filled]
        sizes = np.array([len(p) for p in points])
        first = np.cumsum(sizes) - sizes
        names = np.concatenate(points).astype(np.uint64)
        bases = np.cumsum(SLOTS) - SLOTS
        for level in range(1, LEVELS + 1):
            names, first = parse(names, first)
            if level < 2:
                continue
            group = min(level, 4) - 2
            owner = np.repeat(filled, np.diff(first, append=len(names)))
            value = _mix(names + np.uint64(level if group < 2 else 4))
            slot = (value % np.uint64(SLOTS[group])).astype(np.int64) + bases[group]
            np.minimum.at(best.reshape(-1), owner * total + slot, value)
    short = (_mix(best) >> np.uint64(48)).astype(np.uint16)
    short[short == 0] = 1
    short[best == _EMPTY] = 0
    return short


def hexes(sketch: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketch.astype(">u2")]


def unhex(prints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u2").reshape(len(prints), -1).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those filled in either of two rows; 1 if none is."""
    filled = (a | b) != 0
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text. A column of that name is replaced."""
    return with_columns(df, text_col, lambda: lambda texts: [hexes(sketches(texts))], [T.StructField(out, T.StringType())])


def _edited(text: str, following: str) -> str:
    """The second half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``neighbours.in_order`` -> a row for each that is no guest."""
    last = None                                                # (id, text, sketch, range) awaiting its successor
    for batch in batches:
        for part in slices(batch, 1):
            ids, texts, ranges, guests = (c.to_pylist() for c in part.columns)
            texts = [t or "" for t in texts]
            own = sketches(texts)
            rows = [last] if last else []
            rows += [None if g else (i, t, s, r) for i, t, s, r, g in zip(ids, texts, own, ranges, guests)]
            nexts = list(zip(texts, own))
            if not last:
                nexts = nexts[1:]
            done = [(row, nx) for row, nx in zip(rows, nexts) if row is not None]
            last = rows[-1]
            if done:
                yield _compared(names, done)


def _compared(names: list[str], done: list) -> pa.RecordBatch:
    edited = [_edited(row[1], nx[0]) for row, nx in done]
    of_edited = sketches(edited)
    own, following = np.array([row[2] for row, _ in done]), np.array([nx[1] for _, nx in done])
    return pa.RecordBatch.from_arrays([
        pa.array([row[0] for row, _ in done], pa.int64()),
        pa.array([len(row[1]) for row, _ in done], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
        pa.array(hexes(own)), pa.array(hexes(of_edited)),
        pa.array(likeness(own, of_edited)), pa.array(likeness(own, following))], names=names)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside those of its edited form and of the next document
    by doc_id (after the last: the first). Edited: the second half, rounded down, replaced
    by as much of the next text's beginning. Rows with one doc_id follow each other by
    text; a row without a doc_id has no successor and is edited with the empty text."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = in_order(rows.where("doc_id IS NOT NULL"), "doc_id", "text")
    alone = rows.where("doc_id IS NULL")
    return ordered.mapInArrow(partial(_compare, names), schema) \
        .union(alone.mapInArrow(partial(_compare_alone, names), schema))


def _compare_alone(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            none = sketches([""])[0]
            yield _compared(names, [((None, t, s), ("", none)) for t, s in zip(texts, sketches(texts))])


def similarity(df: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """``df`` with the likeness of two fingerprint columns; null if either is null."""
    @F.pandas_udf(T.DoubleType())
    def f(x, y):
        r = np.full(len(x), np.nan)
        ok = (x.notna() & y.notna()).to_numpy()
        if ok.any():
            r[ok] = likeness(unhex(list(x[ok])), unhex(list(y[ok])))
        return x.__class__(r).where(ok, None).astype(float)
    return df.withColumn(out, F.nanvl(f(df[a], df[b]), F.lit(None).cast("double")))
