"""Language identification of mixed-language text (operator 4).

A word is a run of letters. The script of its letters, by code point ranges, leaves the
languages that were seen in that script; each of those scores the word by the
log-probabilities of its character 1- to 4-grams. Viterbi over the words of a text, with
a penalty for every change of language, labels spans; a text's language is the one with
the most letters in its spans, and the score is their share.

Learning counts n-grams of a bounded sample of labelled texts, at most about
``MAX_TEXTS`` of each of at most ``MAX_LANGUAGES`` languages (more raise), chosen by a hash of the text's id; the counts are summed
by Spark and the model (languages x ``BUCKETS`` numbers) is sent to every task.

Viterbi is exact. Where no stretch of words gains half the penalty by any other language
than the best single one, the best path doesn't change language, as a path has at most
two such stretches for its first change and one for each further; this is seen from
running sums, and only other texts are walked through word by word.

Cases: a null text and one without a letter are ``und`` with score 0, as is every text
if nothing could be learned; words in a script that no language was seen in count for
none; ties go to the alphabetically first language; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, with_columns

MAX_TEXTS = 3000        # sampled for each language, about
MAX_LANGUAGES = 200     # a column with more values raises
BUCKETS = 1 << 16       # of hashed n-grams
ORDERS = (1, 2, 3, 4)
PENALTY = 15.0          # of a change of language, in units of log-probability
MIN_SHARE = 0.01        # of a language's letters, for it to be a candidate for their script
KEPT_WORDS = 300_000
UNKNOWN = "und"

#: First code points of script ranges, in ascending order. '' is mixed or none.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1C90, "Georgian"),
    (0x1CC0, ""), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, ""), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0xA000, ""),
    (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x32000, ""),
)
_FIRST = np.array([c for c, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
_OF_RANGE = np.array([NAMES.index(s) for _, s in SCRIPTS])

_words = re.compile(r"[^\W\d_]+").findall          # letters, and a few numerals that _letters drops
_letters = regex.compile(r"\P{L}+")


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as an index of NAMES."""
    return _OF_RANGE[np.searchsorted(_FIRST, np.array([ord(w[0]) for w in words]), side="right") - 1]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of words set between boundary marks, as rows of
    (character position, order), -1 where an n-gram would leave its word; and where each
    word's positions start."""
    marked = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(starts + sizes, sizes) - np.arange(len(marked))      # characters left in the word
    out = np.full((len(marked), len(ORDERS)), -1, np.int32)
    h = np.zeros(len(marked), np.uint64)
    padded = np.concatenate([marked, np.zeros(max(ORDERS), np.uint32)]).astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ padded[n - 1:n - 1 + len(marked)]) * np.uint64(0x100000001B3) + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
            out[:, ORDERS.index(n)] = np.where(room >= n, bucket, -1)
    return out, starts


@dataclass
class Model:
    """``logs`` [BUCKETS + 1, languages], the last row zero; ``seen`` [scripts, languages]."""

    languages: list[str]
    logs: np.ndarray
    seen: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.kept = min(KEPT_WORDS, 30_000_000 // max(1, len(self.languages)))
        self.clear()

    def clear(self) -> None:
        self.rows.clear()
        self.scores = np.zeros((1024, len(self.languages)), np.float32)
        self.sizes = np.zeros(1024, np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        """[words, languages]: log-probabilities; far below all others where the script
        rules a language out, 0 for all if it rules out every one."""
        grams, starts = ngrams(words)
        s = np.add.reduceat(self.logs[grams].sum(axis=1), starts, axis=0)
        ok = self.seen[scripts(words)]
        s[~ok] = s.min() - 100.0 if s.size else 0.0
        s[~ok.any(axis=1)] = 0.0
        return s

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``scores`` for the words of each text."""
        distinct = {w for t in texts for w in t}
        new = [w for w in distinct if w not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.kept:
                self.clear()
                new = list(distinct)
            plain = [_letters.sub("", w) for w in new]
            told = [i for i, p in enumerate(plain) if p]
            at = len(self.rows)
            need = at + len(new)
            if need > len(self.sizes):
                self.scores = np.resize(self.scores, (need * 3 // 2, self.scores.shape[1]))
                self.sizes = np.resize(self.sizes, need * 3 // 2)
            self.scores[at:need] = 0
            self.sizes[at:need] = [len(p) for p in plain]
            for i in range(0, len(told), 20_000):
                part = told[i:i + 20_000]
                self.scores[at + np.array(part)] = self.score([plain[j] for j in part])
            self.rows.update(zip(new, range(at, need)))
        get = self.rows.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def path(self, rows: np.ndarray) -> np.ndarray:
        """The best language of each word of a text."""
        s = self.scores[rows].astype(np.float64)
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, [best]], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(s.shape[1]), gain[:-1]]), axis=0)
        if (gain - low).max(initial=0.0) < PENALTY / 2:
            return np.full(len(rows), best)
        value = s[0].tolist()
        back: list[list[int]] = []
        languages = range(len(value))
        for step in s[1:].tolist():
            top = max(value)
            arg = value.index(top)
            jump = top - PENALTY
            came = [k if value[k] >= jump else arg for k in languages]
            value = [(value[k] if value[k] >= jump else jump) + step[k] for k in languages]
            back.append(came)
        now = value.index(max(value))
        out = [now]
        for came in reversed(back):
            now = came[now]
            out.append(now)
        return np.array(out[::-1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, shares = [], []
        for rows in self.look_up([_words((t or "").lower()) for t in texts]):
            sizes = self.sizes[rows]
            if not sizes.sum() or not self.languages:
                langs.append(UNKNOWN)
                shares.append(0.0)
                continue
            rows, sizes = rows[sizes > 0], sizes[sizes > 0]
            letters = np.bincount(self.path(rows), weights=sizes, minlength=len(self.languages))
            langs.append(self.languages[int(letters.argmax())])
            shares.append(float(letters.max() / letters.sum()))
        return langs, shares

    def spans(self, text: str | None) -> list[dict]:
        """Stretches of one language: start, end (in characters, from first to last letter), lang."""
        found = [m for m in re.finditer(r"[^\W\d_]+", text or "") if _letters.sub("", m.group())]
        if not found or not self.languages:
            return []
        path = self.path(self.look_up([[m.group().lower() for m in found]])[0])
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [{"start": found[a].start(), "end": found[b - 1].end(), "lang": self.languages[path[a]]}
                for a, b in zip(cuts, cuts[1:])]


def _count(batches):
    """(lang, text) -> partial (lang, kind, at, n): n-gram counts, then letters by script."""
    for batch in batches:
        for part in slices(batch, 1):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                words = [p for g, t in zip(langs, texts) if g == lang
                         for w in _words(t.lower()) if (p := _letters.sub("", w))]
                if not words:
                    continue
                grams, _ = ngrams(words)
                n = np.bincount(grams[grams >= 0], minlength=BUCKETS)
                m = np.bincount(scripts(words), weights=[len(w) for w in words], minlength=len(NAMES)).astype(np.int64)
                at = np.concatenate([np.flatnonzero(n), np.flatnonzero(m) + BUCKETS])
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "at": pa.array(at, pa.int32()),
                                                  "n": pa.array(np.concatenate([n[n > 0], m[m > 0]]), pa.int64())})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_texts: int = MAX_TEXTS) -> Model:
    """Learn from the rows of ``labelled`` whose language is not null."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang_col!r}: not a column of languages")
    share = [F.when(F.col(lang_col) == r[lang_col], F.lit(max_texts / r["n"])) for r in sizes]
    if not share:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("langid")), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < F.coalesce(*share)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = sample.mapInArrow(_count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(NAMES), len(langs)))
    column = np.array([langs.index(x) for x in got.column("lang").to_pylist()], np.int64)
    counts[got.column("at").to_numpy(), column] = got.column("n").to_numpy()
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) / len(ORDERS)
    seen = letters >= MIN_SHARE * letters.sum(axis=0)
    return Model(langs, np.vstack([logs, np.zeros(len(langs))]).astype(np.float32), seen)


_LOADED: dict[int, Model] = {}


def _model(content) -> Model:
    langs, logs, seen = content.value
    key = hash((tuple(langs), logs.tobytes()))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(langs, logs, seen)
    return _LOADED[key]


def _predict_setup(content) -> Callable:
    return _model(content).predict


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with each whole text's language and the share of its letters in that language.
    Columns of these names are replaced."""
    content = df.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.seen))
    return with_columns(df, text_col, partial(_predict_setup, content),
                        [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])


def spans(df: DataFrame, model: Model, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with the labelled spans of each text: array<struct<start, end, lang>>."""
    content = df.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.seen))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("lang", T.StringType())]))
    return with_columns(df, text_col, partial(_spans_setup, content), [T.StructField(out, kind)])


def _spans_setup(content) -> Callable:
    model = _model(content)
    return lambda texts: [[model.spans(t) for t in texts]]
