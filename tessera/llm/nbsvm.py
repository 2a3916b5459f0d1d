"""Quality classification by a Naive Bayes support vector machine (operator 6).

A text is a set of hashed n-grams (indicators): its tokens and pairs of tokens as
written, the shapes of tokens and pairs of shapes (capitals, small letters, digits and
marks, runs shortened), and runs of four flags that tell whether neighbouring tokens
are equal. A token of more than ``PIECE`` characters, as in text without spaces, counts as
its pieces of that many. Each indicator is scaled by the log ratio of its smoothed shares in the two classes, the vector brought to length
1, and a linear model with hinge loss is fitted by dual coordinate descent. Margins of
texts kept from that fit are turned into probabilities by a logistic curve.

Fitting takes about ``PER_CLASS`` labelled texts of each class, chosen by a hash of the
id; each stands for as many as it was drawn from. Their n-gram numbers are made by
Spark and only these reach the driver. Scoring is per row, over whole texts.

Cases: null counts as empty; a text without tokens gets the score of a margin of the
bias alone, between 0 and 1; with one class or none labelled, every score is that class
or 1. Equal texts have equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .arrow import list_array, with_columns
from .sample import labelled_sample

PER_CLASS = 4000          # labelled texts of each class to fit on, about
BUCKETS = 1 << 18
MIN_TEXTS = 3             # an n-gram of fewer sampled texts says nothing
KEPT_TOKENS = 400_000
PIECE = 64                # characters
EPOCHS = 20
COST = 1.0                # of a violated margin, shared out evenly between the classes
CALIBRATED = 4            # every so-manieth sampled text is kept for the logistic curve


def shape(token: str) -> str:
    """'Hello,' -> 'Xx,'; 'NO!!' -> 'X!!'; a run of one kind is shortened to two at most."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token)
    out = re.sub(r"X+", "X", re.sub(r"x+", "x", re.sub(r"9+", "9", kinds)))
    return re.sub(r"(.)\1{2,}", r"\1\1\1", out)


class Grams:
    """Turns texts into the distinct n-gram numbers they hold."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.hashes = np.zeros((2, 1024), np.uint64)
        self.last = np.zeros(BUCKETS, np.int32)

    def _row(self, token: str) -> int:
        if len(self.rows) >= self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        i = self.rows[token] = len(self.rows)
        self.hashes[0, i] = xxh64_intdigest(token, 1)
        self.hashes[1, i] = xxh64_intdigest(shape(token), 2)
        return i

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int32)
        if max(map(len, tokens)) > PIECE:
            tokens = [t[i:i + PIECE] for t in tokens for i in range(0, len(t), PIECE)]
        if len(self.rows) > KEPT_TOKENS:
            self.rows.clear()
        get, add = self.rows.get, self._row
        rows = np.array([add(t) if (i := get(t)) is None else i for t in tokens], np.int64)
        word, form = self.hashes[0, rows], self.hashes[1, rows]
        pair = lambda h, salt: (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(salt)
        same = (word[1:] == word[:-1]).astype(np.uint64)
        same = np.concatenate([same, np.full(3, 2, np.uint64)])
        same = (same[:-3] + same[1:-2] * 3 + same[2:-1] * 9 + same[3:] * 27 + 1) * np.uint64(0xD6E8FEB86659FD93)
        h = np.concatenate([word, form, pair(word, 0xBF58476D1CE4E5B9), pair(form, 0x94D049BB133111EB), same])
        ids = ((h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) >> np.uint64(46)).astype(np.int32)
        n = np.arange(len(ids), dtype=np.int32)
        self.last[ids] = n
        return ids[self.last[ids] == n]


def hinge_fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
              size: int, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of a linear model with hinge loss: dual coordinate descent over the rows.
    The dual of a row stays in [0, its cost]; a step sets it to the best value given all others."""
    w = np.zeros(size)
    dual = np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            slope = y[i] * (w[rows[i]] @ values[i]) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = new - dual[i]
            if step:
                dual[i] = new
                w[rows[i]] += step * y[i] * values[i]
                moved = max(moved, abs(step) / cost[i])
        if moved < 1e-4:
            break
    return w


def logistic_curve(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), by Newton steps on the
    weighted likelihood with targets drawn in from 0 and 1 and a faint pull to a = 1."""
    n1, n0 = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones_like(margin)])
    ab = np.array([1.0, 0.0])
    pull = np.diag([1e-3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (weight * (p - target)) + pull @ (ab - np.array([1.0, 0.0]))
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + pull
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


@dataclass
class Model:
    ratio: np.ndarray          # log-count ratio of each n-gram number, 0 if it says nothing
    weight: np.ndarray         # of the scaled indicators; the last is the bias
    a: float
    b: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        both = self.ratio * self.weight[:-1]
        for i, ids in enumerate(rows):
            length = np.sqrt((self.ratio[ids] ** 2).sum())
            out[i] = (both[ids].sum() / length if length else 0.0) + self.weight[-1]
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(rows) + self.b, -40, 40)))


def scaled(ratio: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text's vector, with the bias as its last column."""
    ids = ids[ratio[ids] != 0]
    v = ratio[ids]
    length = np.sqrt(v @ v)
    values = np.append(v / length if length else v, 1.0).astype(np.float32)
    return np.append(ids, np.int32(len(ratio))).astype(np.int32), values


def fit_rows(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> Model:
    """Fit to the n-gram numbers of labelled texts."""
    if len(set(label.tolist())) < 2:
        sure = float(label[0]) if len(label) else 1.0
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS + 1), 1.0, 40.0 if sure else -40.0)
    kept = np.arange(len(rows)) % CALIBRATED == 0
    if len(set(label[kept].tolist())) < 2 or len(set(label[~kept].tolist())) < 2:
        kept = np.zeros(len(rows), bool)
    fit = np.flatnonzero(~kept)
    counts = np.zeros((2, BUCKETS))
    for i in fit:
        counts[label[i], rows[i]] += 1
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    ratio = np.where(counts.sum(axis=0) >= MIN_TEXTS, np.log(share[1] / share[0]), 0.0)
    vectors = [scaled(ratio, rows[i]) for i in fit]
    n1 = max(1, label[fit].sum())
    cost = COST * len(fit) / 2 / np.where(label[fit] == 1, n1, max(1, len(fit) - n1))
    w = hinge_fit([v[0] for v in vectors], [v[1] for v in vectors], np.where(label[fit] == 1, 1.0, -1.0), cost, BUCKETS + 1)
    model = Model(ratio, w, 1.0, 0.0)
    on = np.flatnonzero(kept) if kept.any() else fit
    model.a, model.b = logistic_curve(model.margins([rows[i] for i in on]), label[on], weight[on])
    return model


def _grams_setup():
    grams = Grams()

    def fn(texts):
        rows = [grams.of(t) for t in texts]
        return [list_array(np.concatenate([np.zeros(0, np.int32), *rows]), [len(r) for r in rows])]
    return fn


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from the documents (doc_id, text) that have a label 0 or 1 in ``labels``."""
    sample = labelled_sample(docs, labels, label_col, per_class, "nbsvm")
    got = with_columns(sample, "text", _grams_setup, [T.StructField("grams", T.ArrayType(T.IntegerType(), False))]) \
        .select("id", "grams", "label", "weight").toArrow().sort_by("id")
    lists = got.column("grams").combine_chunks()
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return fit_rows([flat[a - at[0]:b - at[0]] for a, b in zip(at, at[1:])],
                    got.column("label").to_numpy(), got.column("weight").to_numpy())


def _score_setup(content):
    model, grams = Model(*content.value), Grams()
    return lambda texts: [model.scores([grams.of(t) for t in texts])]


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for each whole text. A column of that name is replaced."""
    content = df.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.a, model.b))
    return with_columns(df, text_col, partial(_score_setup, content), [T.StructField(out, T.DoubleType(), False)])


def reject(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with the columns of ``docs``."""
    return score(docs, model, out="__quality").where(F.col("__quality") >= threshold).select(*[F.col(c) for c in docs.columns])
