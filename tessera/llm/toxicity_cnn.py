"""Toxicity by a convolutional text classifier (operator 3).

A token, in lower case and without marks at its ends, is embedded as the sum of a
vector for its hash and one for the hash of its first four characters; hashes that few
sampled texts hold have no vector, so that chance words are not learned by heart. Filters of
widths 1, 2 and 3 slide over the whole text; the largest response of each filter goes
into a logistic output, where it can only add to the score, so that short and empty
texts count as clean. It is trained in numpy by Adagrad: the forward pass finds the
window of each maximum, and only those windows are corrected.

Thresholds are calibrated by language on texts kept from training: each language's
logits are shifted so that 0.5 has the best F1, in the widest gap. The words that tell a
language are learned from the sampled texts: those that most texts of a language hold and
few of the others. A score reads the text alone: its language is the one with the most such
words. Languages with few sampled texts share one threshold, as do texts without a language.

Training takes about ``PER_CLASS`` labelled whole texts of each class, chosen by a hash
of the id; Spark makes their token numbers and only these reach the driver. Scoring is
per row, over whole texts.

Cases: null counts as empty; a text without tokens is scored as one blank token; with
one class or none labelled, every score is that class or 0. Equal texts score alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .arrow import list_array, with_columns
from .nbsvm import logistic_curve
from .sample import labelled_sample

PER_CLASS = 2500            # labelled texts of each class to train on, about
WORD_BITS, STEM_BITS = 24, 20
STEM = 4
MIN_TEXTS = 3               # sampled texts that must hold a word or stem for it to have a vector
DIM, FILTERS = 16, 12       # of an embedding; of each width
WIDTHS = (1, 2, 3)
EPOCHS, STEPS = 24, 1500    # at least
BATCH, RATE, DECAY = 32, 0.1, 1e-5
DROPPED = 0.5               # share of a text's tokens left out of a training step
LEAK = np.float32(0.1)      # slope of a response below 0
CALIBRATED = 4              # every so-manieth sampled text is kept for the thresholds
MIN_CALIBRATED = 8          # texts of either class that a language needs for a threshold of its own
KEPT_TOKENS = 300_000

MARKS = 30                  # words that tell a language, at most
MARK_SHARE = 0.25           # by which the share of texts with such a word is above that of other languages
MIN_LANGUAGE = 30           # sampled texts that a language needs
MAX_LANGUAGES = 19          # told apart: the most frequent of the sample
_edges = re.compile(r"^[\W\d_]+|[\W\d_]+$")


_WORD, _STEM = (1 << WORD_BITS) - 1, (1 << STEM_BITS) - 1


def token_number(token: str) -> int:
    """Hash of the word and hash of the stem of a token, packed; 0 is blank."""
    plain = _edges.sub("", token.lower()) or token.lower()
    word = xxh64_intdigest(plain, 3) % _WORD + 1
    stem = xxh64_intdigest(plain[:STEM], 4) % _STEM + 1
    return word | stem << WORD_BITS


class Tokens(dict):
    """Token numbers of texts; keeps those of the tokens met, up to a bound. ``renumber``
    turns a number of hashes into one of a model's rows."""

    def __init__(self, renumber=None):
        super().__init__()
        self.renumber = renumber or (lambda n: n)

    def __missing__(self, token: str) -> int:
        n = self[token] = self.renumber(token_number(token))
        return n

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > KEPT_TOKENS:
            self.clear()
        return np.array(list(map(self.__getitem__, (text or "").split())) or [0], np.int64)


def language(numbers: np.ndarray, languages: int) -> int:
    """Number of the language with the most of its words in a text (as a model numbers it); -1: none."""
    bits = numbers >> WORD_BITS + STEM_BITS
    bits = bits[bits > 0]
    if not len(bits):
        return -1
    return int(((bits[:, None] >> np.arange(languages)) & 1).sum(axis=0).argmax())


def learn_marks(texts: list[np.ndarray], langs: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages told apart, and ascending word hashes with a bit for each language that
    they tell. Texts are token numbers; a null language counts for none."""
    sizes: dict[str, int] = {}
    for lang in langs:
        if lang is not None:
            sizes[lang] = sizes.get(lang, 0) + 1
    names = sorted((n for n, k in sizes.items() if k >= MIN_LANGUAGE), key=lambda n: (-sizes[n], n))[:MAX_LANGUAGES]
    if len(names) < 2:
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = [np.concatenate([np.unique(t & _WORD) for t, lang in zip(texts, langs) if lang == n]) for n in names]
    words = np.unique(np.concatenate(held))
    words = words[words > 0]
    share = np.zeros((len(names), len(words)))
    for i, (n, h) in enumerate(zip(names, held)):
        seen, k = np.unique(h[h > 0], return_counts=True)
        share[i, np.searchsorted(words, seen)] = k / sizes[n]
    bits = np.zeros(len(words), np.int64)
    for i in range(len(names)):
        ahead = share[i] - np.delete(share, i, axis=0).mean(axis=0)
        best = np.argsort(-ahead, kind="stable")[:MARKS]
        bits[best[ahead[best] >= MARK_SHARE]] |= 1 << i
    return names, words[bits > 0], bits[bits > 0]


def frequent(parts: list[np.ndarray]) -> np.ndarray:
    """The hashes, ascending, that at least MIN_TEXTS texts hold; 0, the blank, first."""
    seen, n = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(p) for p in parts]]), return_counts=True)
    return np.concatenate([[0], seen[(n >= MIN_TEXTS) & (seen > 0)]])


def rows_of(kept: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash in ``kept``; 0 if it isn't there."""
    at = np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)
    return np.where(kept[at] == hashes, at, 0)


@dataclass
class Model:
    words: np.ndarray                # ascending hashes of the rows of ``word``
    stems: np.ndarray
    word: np.ndarray                 # vectors; row 0 is zero
    stem: np.ndarray
    filters: list[np.ndarray]        # [width, DIM, FILTERS] for each width
    bias: np.ndarray                 # of all filters
    out: np.ndarray                  # weights of the pooled responses; the last is the bias
    languages: list = field(default_factory=list)
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))    # ascending hashes of words that tell a language
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))     # and which
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1))   # threshold by language; last: any other
    slope: float = 1.0
    parts: list | None = None        # responses to each word and stem alone, by width and offset

    @classmethod
    def random(cls, words: np.ndarray, stems: np.ndarray, seed: int = 0) -> Model:
        r = np.random.default_rng(seed)
        f = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        word, stem = f(len(words), DIM, by=0.1), f(len(stems), DIM, by=0.1)
        word[0] = stem[0] = 0
        return cls(words, stems, word, stem, [f(w, DIM, FILTERS, by=0.3 / np.sqrt(w)) for w in WIDTHS],
                   np.zeros(FILTERS * len(WIDTHS), np.float32), np.abs(f(FILTERS * len(WIDTHS) + 1, by=0.1)))

    def renumber(self, numbers: np.ndarray) -> np.ndarray:
        """Hashes -> rows, in the same packing, with the languages that a word tells above."""
        word = numbers & _WORD
        at = np.minimum(np.searchsorted(self.marks, word), max(len(self.marks) - 1, 0))
        told = np.where(self.marks[at] == word, self.bits[at], 0) if len(self.marks) else np.zeros_like(word)
        return rows_of(self.words, word) | rows_of(self.stems, numbers >> WORD_BITS & _STEM) << WORD_BITS \
            | told << WORD_BITS + STEM_BITS

    def tokens(self) -> Tokens:
        """Reads texts into rows of this model."""
        word = {int(h): i for i, h in enumerate(self.words)}
        stem = {int(h): i << WORD_BITS for i, h in enumerate(self.stems)}
        told = {int(h): int(b) << WORD_BITS + STEM_BITS for h, b in zip(self.marks, self.bits)}
        return Tokens(lambda n: word.get(n & _WORD, 0) | stem.get(n >> WORD_BITS & _STEM, 0) | told.get(n & _WORD, 0))

    def pool(self, texts: list[np.ndarray], places: bool = False):
        """Largest responses [texts, filters] and, if asked for, where they are and the
        laid-out token numbers (blanks follow each text, so that no window spans two)."""
        gap = max(WIDTHS) - 1
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + gap) - sizes - gap
        laid = np.zeros(int(sizes.sum()) + gap * len(texts), np.int64)
        for t, a in zip(texts, starts):
            laid[a:a + len(t)] = t
        words, stems = laid & _WORD, laid >> WORD_BITS & _STEM
        x = None if self.parts else self.word[words] + self.stem[stems]
        n = len(laid) - gap
        best, where = [], []
        for i, f in enumerate(self.filters):
            if self.parts:                               # sums of looked-up parts: alike in any batch
                r = sum(w[words[k:n + k]] + s[stems[k:n + k]] for k, (w, s) in enumerate(self.parts[i]))
            else:
                r = sum(x[k:n + k] @ f[k] for k in range(len(f)))
            last = starts[1:] - gap                      # blank windows between texts count for none
            for g in range(gap):
                r[last + g] = -np.inf
            m = np.maximum.reduceat(r, starts, axis=0)
            best.append(m)
            if places:
                where.append(np.stack([starts + [int(r[a:a + s, c].argmax()) for a, s in zip(starts, sizes)]
                                       for c in range(f.shape[2])], axis=1))
        pooled = np.concatenate(best, axis=1) + self.bias
        pooled = np.where(pooled > 0, pooled, LEAK * pooled)
        return (pooled, np.concatenate(where, axis=1), words, stems) if places else pooled

    def logits(self, texts: list[np.ndarray], group: int = 256) -> np.ndarray:
        self.parts = self.parts or [[(self.word @ f[k], self.stem @ f[k]) for k in range(len(f))] for f in self.filters]
        out = [(self.pool(texts[i:i + group]) * self.out[:-1]).sum(axis=1) for i in range(0, len(texts), group)]
        return np.concatenate(out or [np.zeros(0)]).astype(np.float64) + float(self.out[-1])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        cut = self.cut[[language(t, len(self.languages)) for t in texts]] if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.logits(texts) - cut), -40, 40)))


def _some(text: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A text without a random share of its tokens, so that each of its words must count."""
    kept = text[r.random(len(text)) >= DROPPED]
    return kept if len(kept) else text


def gradients(model: Model, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> tuple[list, list]:
    """Of the weighted mean logistic loss of texts (numbers of rows): by the filters of each
    width, the bias and the output weights; and (rows, gradients) by word and stem vectors,
    of the windows with the largest responses."""
    pooled, where, words, stems = model.pool(texts, places=True)
    p = 1 / (1 + np.exp(-(pooled @ model.out[:-1] + model.out[-1])))
    slope = ((p - label) * weight / len(texts)).astype(np.float32)
    back = (slope[:, None] * model.out[:-1]) * np.where(pooled > 0, np.float32(1), LEAK)
    grads = [*[np.zeros_like(f) for f in model.filters], back.sum(axis=0), np.append(slope @ pooled, slope.sum())]
    at, push = [], []
    for k, f in enumerate(model.filters):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        w, g = where[:, cols], back[:, cols]
        for o in range(len(f)):
            x = model.word[words[w + o]] + model.stem[stems[w + o]]           # [texts, filters, DIM]
            grads[k][o] = np.einsum("tfd,tf->df", x, g)
            at.append((w + o).ravel())
            push.append((g[:, :, None] * f[o].T[None]).reshape(-1, DIM))
    at, push = np.concatenate(at), np.concatenate(push)
    vectors = []
    for rows in (words[at], stems[at]):
        touched, back_to = np.unique(rows, return_inverse=True)
        g = np.zeros((len(touched), DIM), np.float32)
        np.add.at(g, back_to, push)
        g[touched == 0] = 0                                                    # blanks stay zero
        vectors.append((touched, g))
    return grads, vectors


def train(texts: list[np.ndarray], label: np.ndarray, seed: int = 0) -> Model:
    """Adagrad on the logistic loss, the classes weighted alike."""
    model = Model.random(frequent([t & _WORD for t in texts]), frequent([t >> WORD_BITS & _STEM for t in texts]), seed)
    texts, r = [model.renumber(t) for t in texts], np.random.default_rng(seed)
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    params = [model.word, model.stem, *model.filters, model.bias, model.out]
    past = [np.full_like(p, 1e-3) for p in params]
    for _ in range(max(EPOCHS, STEPS // -(-len(texts) // BATCH))):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            part = order[i:i + BATCH]
            grads, vectors = gradients(model, [_some(texts[j], r) for j in part], label[part], weight[part])
            for table, kept, (touched, g) in zip(params, past, vectors):
                kept[touched] += g * g
                table[touched] -= RATE * g / np.sqrt(kept[touched])
            for p_, kept, g in zip(params[2:], past[2:], grads):
                g = g.astype(np.float32) + DECAY * p_
                kept += g * g
                p_ -= RATE * g / np.sqrt(kept)
            np.maximum(model.out[:-1], 0, out=model.out[:-1])       # a response can only speak for label 1
    return model


def best_cut(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best F1 of label 1, in the widest gap of the best."""
    order = np.argsort(logit)
    z, hit = logit[order], (weight * label)[order]
    missed, above = np.cumsum(hit)[:-1], weight.sum() - np.cumsum(weight[order])[:-1]
    f1 = 2 * (hit.sum() - missed) / (hit.sum() + above)
    width = np.diff(z)
    i = np.lexsort((width, np.where(width > 0, f1, -1)))[-1]
    return float((z[i] + z[i + 1]) / 2)


def fit_texts(texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, seed: int = 0,
              langs: list[str | None] | None = None) -> Model:
    """Train on token numbers and calibrate the thresholds on the texts kept from it, by what
    their words say of ``langs``."""
    if len(set(label.tolist())) < 2:
        model = Model.random(np.zeros(1, np.int64), np.zeros(1, np.int64), seed)
        model.out[:] = 0
        model.out[-1] = 40.0 if len(label) and label[0] == 1 else -40.0
        return model
    kept = np.arange(len(texts)) % CALIBRATED == 0
    if len(set(label[kept].tolist())) < 2 or len(set(label[~kept].tolist())) < 2:
        kept = np.ones(len(texts), bool)
    on = np.flatnonzero(~kept) if not kept.all() else np.arange(len(texts))
    model = train([texts[i] for i in on], label[on], seed)
    model.languages, model.marks, model.bits = learn_marks(texts, langs or [None] * len(texts))
    of = np.flatnonzero(kept)
    read = [model.renumber(texts[i]) for i in of]
    z, y = model.logits(read), label[of]
    told = np.array([language(t, len(model.languages)) for t in read])
    model.cut = np.full(len(model.languages) + 1, best_cut(z, y, weight[of]))
    for k in range(len(model.languages)):
        own = told == k
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= MIN_CALIBRATED:
            model.cut[k] = best_cut(z[own], y[own], weight[of][own])
    shifted = z - model.cut[told]
    model.slope = logistic_curve(shifted, y, np.ones(len(y)))[0]
    return model


def _numbers_setup():
    tokens = Tokens()

    def fn(texts):
        rows = [tokens.of(t) for t in texts]
        return [list_array(np.concatenate([np.zeros(0, np.int64), *rows]), [len(r) for r in rows])]
    return fn


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, lang_col: str = "lang") -> Model:
    """Learn from the documents (doc_id, text) that have a label 0 or 1 in ``labels``; if they
    have a column of that name, also which words tell a language."""
    also = [lang_col] if lang_col in docs.columns else []
    sample = labelled_sample(docs, labels, label_col, per_class, "toxicity", also=also)
    lang = F.col(lang_col).cast("string") if also else F.lit(None).cast("string")
    got = with_columns(sample, "text", _numbers_setup, [T.StructField("numbers", T.ArrayType(T.LongType(), False))]) \
        .select("id", "numbers", "label", "weight", lang.alias("lang")).toArrow().sort_by("id")
    lists = got.column("numbers").combine_chunks()
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return fit_texts([flat[a - at[0]:b - at[0]] for a, b in zip(at, at[1:])],
                     got.column("label").to_numpy(), got.column("weight").to_numpy(), langs=got.column("lang").to_pylist())


def _score_setup(content):
    model = Model(*content.value)
    tokens = model.tokens()
    return lambda texts: [model.scores([tokens.of(t) for t in texts])]


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the toxicity of each whole text, calibrated to split at 0.5. A column of that name is replaced."""
    content = df.sparkSession.sparkContext.broadcast(
        (model.words, model.stems, model.word, model.stem, model.filters, model.bias, model.out, model.languages, model.marks,
         model.bits, model.cut, model.slope))
    return with_columns(df, text_col, partial(_score_setup, content), [T.StructField(out, T.DoubleType(), False)])


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with the columns of ``docs``."""
    return score(docs, model, out="__toxicity").where(F.col("__toxicity") < threshold).select(*[F.col(c) for c in docs.columns])
