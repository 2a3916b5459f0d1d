"""Token counts under a unigram vocabulary, without building the tokens (operator 9).

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character;
dynamic programming carries the best score and its number of pieces. The tokenizer
followed is ``tokenizers.models.Unigram`` with a Metaspace step that doesn't split: the
text gets a leading space, spaces become U+2581, and the best-scoring segmentation of
the whole text counts. Tie rules, as there: of equal scores ending at one character the
longest last piece wins; a character that is no piece by itself is unknown, at 10 below
the smallest score; unknown characters count by their bytes if the vocabulary has a
piece for every byte, else a run of them counts as one.

A whole text is cut where no piece can reach across: before spaces after another
character, and around line ends, if the vocabulary allows it (it is checked, else the
text stays whole). Every segmentation passes these cuts, so the parts add up. Scores are
added in double precision; with the integer scores of ``piece_bpe_32k.model`` the sums
are exact. Parts repeat, so every task keeps a table of bounded size of those it has met.

Null counts as empty; an empty text has no tokens and score 0. Work is per row.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from functools import partial

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_columns

KEPT_PARTS = 400_000
KEPT_LENGTH = 64           # longer parts are rarely met again
SPACE = "▁"
UNKNOWN_PENALTY = 10.0     # fixed value of the tokenizer followed


def load(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a SentencePiece file, in id order; control pieces last as given."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not m.is_control(i)]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        spaces = SPACE in names and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names)
        lines = self.bytes and not any("\n" in p and len(p) > 1 for p in names)
        cut = f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.parts = re.compile(cut).findall if spaces else lambda text: [text]
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """(number of tokens, score) of the best segmentation of a part."""
        n = len(text)
        score, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0                                   # ends up to here are settled
        found: list[tuple[int, float]] = []
        for last, match in self.machine.iter(text):
            while done < last:
                self._settle(text, done, found, score, count, open_run)
                done, found = done + 1, []
            found.append(match)
        while done < n:
            self._settle(text, done, found, score, count, open_run)
            done, found = done + 1, []
        return count[n], score[n]

    def _settle(self, text, at, found, score, count, open_run) -> None:
        """Best way to end after character ``at``; ``found``: pieces that end there, longest first."""
        best, single = None, False
        for length, s in found:
            total = score[at + 1 - length] + s
            if best is None or total > best:
                best, tokens = total, count[at + 1 - length] + 1
            single = single or length == 1
        unknown = False
        if not single and (best is None or score[at] + self.unknown > best):
            best, unknown = score[at] + self.unknown, True
            if self.bytes:
                tokens = count[at] + len(text[at].encode("utf-8", "surrogatepass"))
            else:
                tokens = count[at] + (0 if open_run[at] else 1)
        score[at + 1], count[at + 1], open_run[at + 1] = best, tokens, unknown

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        known, n, total = self.known, 0, 0.0
        for part in self.parts(SPACE + text.replace(" ", SPACE)):
            got = known.get(part)
            if got is None:
                got = self.best(part)
                if len(part) <= KEPT_LENGTH:
                    if len(known) >= KEPT_PARTS:
                        known.clear()
                    known[part] = got
            n += got[0]
            total += got[1]
        return n, total


_LOADED: dict[str, Unigram] = {}


def _setup(content):
    key = hashlib.md5(content.value).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Unigram(pickle.loads(content.value))
    model = _LOADED[key]

    def fn(texts):
        got = [model.count(t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got]]
    return fn


def counts(df: DataFrame, pieces: list[tuple[str, float]], text_col: str = "text",
           out: str = "n_tokens", score: str = "score") -> DataFrame:
    """``df`` with the number of tokens of each whole text and the score of its best
    segmentation. Columns of these names are replaced."""
    content = df.sparkSession.sparkContext.broadcast(pickle.dumps(pieces))
    return with_columns(df, text_col, partial(_setup, content),
                        [T.StructField(out, T.LongType()), T.StructField(score, T.DoubleType())])
