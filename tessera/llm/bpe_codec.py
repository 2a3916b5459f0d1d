"""BPE encoding and decoding with a public vocabulary file (operator 10).

Encoding keeps the symbols of a word in a doubly linked list and the possible merges
in a priority queue by (rank, position). An entry whose symbols have changed since it
was queued is stale and skipped. Decoding joins the vocabulary strings of the ids.

Supported files: ``tokenizers`` JSON with a BPE model whose words end in a suffix, the
normaliser NFC + white space + lower case, and no decoder (``word_bpe_49k.json``).

Work is per row: no shuffle. Words repeat, so every task keeps the ids of the words it
has met in a table of bounded size; the words of a text of any length are read one by
one. Null text counts as empty; both give no ids and the empty string.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import list_array, with_columns

KEPT_WORDS = 300_000      # entries of a task's word table; it starts anew when full
#: Separators that Python's str.split() takes for white space and Unicode does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: The characters that Unicode calls White_Space.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Capitals of Unicode 16 and 17 that the library lowers and Python does not, beside runs at a distance.
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_CAPITAL_RUNS = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
_LOWER = {**_CAPITALS, **{c: c + by for first, last, by in _CAPITAL_RUNS for c in range(first, last + 1)}}
#: Letters and digits of the ``regex`` module that the library's Unicode does not know.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F").split()
_newer = re.compile("[" + "".join(["-".join([chr(int(c, 16)) for c in r.split("-")]) for r in NEWER]) + "]")
_NO_LETTER = "\ue000"       # a private character: neither letter, digit nor space


def lowered(text: str) -> str:
    """Lower case, each character by itself."""
    low = text.replace("Σ", "σ").lower()
    return low if low.isascii() else low.translate(_LOWER)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for
    itself, the others follow from U+0100 on in byte order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary with its merge ranks; encodes and decodes whole texts."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("only BPE files with a word suffix and no decoder are supported")
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        #: pair of ids -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        symbols = byte_symbols()
        self.inner = [self.ids.get(s) for s in symbols]                   # a byte inside a word
        self.final = [self.ids.get(s + self.suffix) for s in symbols]     # a word's last byte
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.by_piece: dict[str, tuple[int, ...]] = {}
        self.by_word: dict[str, tuple[int, ...]] = {}

    def merge(self, ids: list[int]) -> tuple[int, ...]:
        """Apply the merges to a list of symbols, lowest rank first, leftmost on ties."""
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges = self.merges
        after = list(range(1, n + 1))          # neighbours in the linked list; n: none
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, m[1]))
        heapify(queue)
        while queue:
            _, i, merged = heappop(queue)
            left = ids[i]
            if left < 0:                       # stale: merged into its left neighbour
                continue
            j = after[i]
            if j == n:                         # stale: nothing on the right any more
                continue
            m = merges.get((left, ids[j]))
            if not m or m[1] != merged:        # stale: another pair stands here now
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((merged, ids[k]))
                if m:
                    heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], merged))
                if m:
                    heappush(queue, (m[0], h, m[1]))
        return tuple(x for x in ids if x >= 0)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        known = self.by_piece.get(piece)
        if known is None:
            raw = piece.encode()
            symbols = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
            known = self.merge([s for s in symbols if s is not None])
            if len(self.by_piece) >= KEPT_WORDS:
                self.by_piece.clear()
            self.by_piece[piece] = known
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a run of characters without white space."""
        out: list[int] = []
        for part in self.cut(word) if self.cut else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = lowered(part if part.isascii() else unicodedata.normalize("NFC", part))
                for piece in self.split(plain):
                    out.extend(self.encode_piece(piece))
        return tuple(out)

    def split(self, plain: str) -> list[str]:
        """The pieces of a word, in the library's version of Unicode."""
        if plain.isascii() or not _newer.search(plain):
            return self.pieces(plain)
        known = _newer.sub(_NO_LETTER, plain)
        out, at = [], 0
        for piece in self.pieces(known):
            at = known.index(piece, at)
            out.append(plain[at:at + len(piece)])
            at += len(piece)
        return out

    def words(self, text: str) -> list[str]:
        return [w for w in _SPACE.split(text) if w] if _NOT_SPACE.search(text) else text.split()

    def encode(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of each word of a text."""
        known, out = self.by_word, []
        get, add = known.get, out.append
        for w in self.words(text or ""):
            ids = get(w)
            if ids is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                ids = known[w] = self.encode_word(w)
            add(ids)
        return out

    def decode(self, ids) -> str:
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_LOADED: dict[str, WordBpe] = {}     # a Python worker serves many tasks


def load(path: str) -> bytes:
    """A vocabulary file as bytes (its size is bounded: it is read once, by the driver)."""
    with open(path, "rb") as f:
        return f.read()


def _codec(content) -> WordBpe:
    """The codec of a broadcast vocabulary file, built once per Python worker."""
    key = hashlib.md5(content.value).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(content.value)
    return _LOADED[key]


def _encode_setup(content, decoded: bool):
    codec = _codec(content)

    def fn(texts):
        flat, counts, back = array("i"), [], []
        for t in texts:
            ids = list(chain.from_iterable(codec.encode(t)))
            flat.extend(ids)
            counts.append(len(ids))
            if decoded:
                back.append(codec.decode(ids))
        ids = list_array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), counts)
        return [ids, back] if decoded else [ids]
    return fn


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of each text (array<int>) and, if ``decoded`` names a
    column, the ids decoded again in the same pass. Columns of these names are replaced."""
    content = df.sparkSession.sparkContext.broadcast(load(path))
    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return with_columns(df, text_col, partial(_encode_setup, content, bool(decoded)), fields)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list; null ids decode to '', unknown ids and null
    elements are skipped. A column named ``out`` is replaced."""
    content = df.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf(T.StringType())
    def text_of(ids: pd.Series) -> pd.Series:
        codec = _codec(content)
        return ids.map(lambda v: codec.decode([int(i) for i in v if i == i and i is not None]) if v is not None else "")

    return df.withColumn(out, text_of(df[ids_col]))


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the decoded text."""
    return encoded.select(
        "doc_id", F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids_col).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"))
