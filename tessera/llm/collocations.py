"""Mining phrase collocations with Rabin-Karp fingerprints (operator 12).

Texts are cut at break marks into pieces and those into words. A task reads its texts in
blocks, as bytes in numpy: prefix sums of a polynomial give the fingerprint of every word,
prefix sums over these the fingerprint of every n-gram of one to ``longest`` words, each by
one subtraction. Only fingerprints, their counts and, within a block, a pointer to an
occurrence are handled until a phrase is known to be frequent.

Level by level: the fingerprints of all words are counted by a shuffle, those found often
enough are kept, and n-grams of k + 1 words are counted only where both n-grams of k words
in them are kept, since no phrase is more frequent than a part of it. The last reading
looks up the kept fingerprints of every length, compares every occurrence with the text at
the pointer of its fingerprint, word by word and byte by byte, and writes out each phrase
once a block with its number of verified occurrences; occurrences that share a fingerprint
but not the text are counted under their own text. The sum over blocks is by text, so the
counts are exact whatever the hashes do.

Scale. Texts are never shuffled. What reaches the tasks between readings is a bitmap of kept
fingerprints, of 16 bits for each up to ``MAX_BITS`` (2**27 bits, 16 MB, a level), built by
a shuffle; if more are kept than it can tell apart, more n-grams are counted in vain and the
result is the same. Phrases, their parts and the rank lists are joined as tables; a
language's list is cut in ``SALTS`` shares before it is put together.

Cases: null text is empty; null languages are ``und``; empty and repeated rows count as
they stand; an empty table gives no rows; ties in score and count go by the phrase's
bytes. Blocks hold about 0.5 MB of text or one longer text. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrow import slices

BLOCK_BYTES = 1 << 19    # of text read at once (or one longer text)
MAX_BITS = 27            # size of the bitmap of kept fingerprints, as a power of two
SALTS = 64
UNKNOWN = "und"
BASE, STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F      # of the polynomials over bytes and over words; odd
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (BASE, STEP)}
_powers: dict[int, np.ndarray] = {}

WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTERS = mixed(np.arange(1, 257))       # a random number for each byte


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def windows(values: np.ndarray, base: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial in ``base`` of values[b:e] for every window, from one prefix sum."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)])
    return (upto[end] - upto[begin]) * powers(_INVERSE[base], len(values) + 1)[begin]


class Block:
    """The words of a block of texts, in order, with their fingerprints."""

    def __init__(self, batch: pa.RecordBatch):
        text = pc.fill_null(batch.column(0), "").cast(pa.large_string())
        offset = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        raw = text.buffers()[2]
        self.data = LOWER[np.frombuffer(raw, np.uint8)[offset[0]:offset[-1]]] if raw else np.zeros(0, np.uint8)
        starts = offset[:-1] - offset[0]
        n = len(self.data)
        kind = KIND[self.data]
        head = np.zeros(n + 1, bool)
        head[starts] = True
        head[n] = True
        inside = np.zeros(n + 2, bool)                  # with a place before and after
        inside[1:-1] = kind == WORD
        self.begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | head[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | head[1:])) + 1
        self.piece = np.cumsum((kind == BREAK) | head[:-1])[self.begin]
        names = pc.fill_null(batch.column(1), UNKNOWN).dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        of = np.searchsorted(starts, self.begin, side="right") - 1
        self.lang = names.indices.to_numpy(zero_copy_only=False)[of]
        salt = np.array([_text_hash(x) for x in self.langs], np.uint64)
        with np.errstate(over="ignore"):
            self.word = mixed(windows(LETTERS[self.data], BASE, self.begin, self.end))
        self.salt = salt[self.lang] if len(self.langs) else np.zeros(0, np.uint64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the k words from every word on, and whether these lie in one piece."""
        m = max(len(self.word) - k + 1, 0)
        first = np.arange(m)
        with np.errstate(over="ignore"):
            keys = mixed(windows(self.word, STEP, first, first + k) + self.salt[:m] + np.uint64(k))
        return keys, self.piece[:m] == self.piece[k - 1:k - 1 + m]

    def candidates(self, k: int, kept: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of the n-grams of k words whose parts are kept."""
        keys, whole = self.grams(k)
        if k > 1:
            part = has(kept[k - 1], self.grams(k - 1)[0])
            whole &= part[:len(whole)] & part[1:len(whole) + 1]
        at = np.flatnonzero(whole)
        return at, keys[at]

    def classes(self) -> tuple[np.ndarray, list[str]]:
        """A number for each word, equal just for equal texts, and the texts by number."""
        _, first, kind = np.unique(self.word, return_index=True, return_inverse=True)
        size = self.end - self.begin
        rep = first[kind]
        same = size == size[rep]
        checked = np.flatnonzero(same)
        n = size[checked]
        ahead = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = self.data[np.repeat(self.begin[checked], n) + ahead] == self.data[np.repeat(self.begin[rep[checked]], n) + ahead]
        same[checked[np.repeat(np.arange(len(checked)), n)[~equal]]] = False
        data = self.data.tobytes()
        spell = lambda i: data[self.begin[i]:self.end[i]].decode()
        texts = [spell(i) for i in first]
        known: dict[str, int] = {}
        for i in np.flatnonzero(~same):                 # two words share a fingerprint
            word = spell(i)
            if word not in known:
                known[word] = len(texts)
                texts.append(word)
            kind[i] = known[word]
        return kind, texts


def _text_hash(text: str) -> int:
    value = 0
    for b in text.encode():
        value = (value * BASE + b + 1) % (1 << 64)
    return int(mixed(np.array([value], np.uint64))[0])


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint, at the place named by its top bits, is set."""
    place = keys >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _blocks(batches):
    for b in batches:
        for part in slices(b, 0, BLOCK_BYTES):
            yield Block(part)


def _count(k: int, kept, batches):
    """(fp, n): fingerprints of the candidates of k words and how often each occurs in a block."""
    for block in _blocks(batches):
        keys, n = np.unique(block.candidates(k, kept.value)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])


def _spell(longest: int, kept, batches):
    """(lang, words, phrase, n): kept phrases and their verified occurrences in a block, and
    as 0 words the number of all words of a language."""
    for block in _blocks(batches):
        kind, texts = block.classes()
        rows: Counter = Counter()
        for code, n in zip(*np.unique(block.lang, return_counts=True)):
            rows[block.langs[code], 0, ""] += int(n)
        for k in range(1, longest + 1):
            at, keys = block.candidates(k, kept.value)
            hit = has(kept.value[k], keys)
            at, keys = at[hit], keys[hit]
            if not len(at):
                break
            _, first, of = np.unique(keys, return_index=True, return_inverse=True)
            pointer = at[first][of]
            same = block.lang[at] == block.lang[pointer]
            for j in range(k):
                same &= kind[at + j] == kind[pointer + j]
            spell = lambda i: (block.langs[block.lang[i]], k, " ".join([texts[c] for c in kind[i:i + k].tolist()]))  # noqa: E731, B023
            for i, n in zip(at[first].tolist(), np.bincount(of[same], minlength=len(first)).tolist()):
                rows[spell(i)] += n
            for i in at[~same].tolist():                # one fingerprint, two texts
                rows[spell(i)] += 1
        langs, words, phrases = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.int32()), pa.array(phrases, pa.string()),
                                          pa.array(list(rows.values()), pa.int64())], names=["lang", "words", "phrase", "n"])


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of the fingerprints in ``keys`` (fp): 16 bits for each, at least 2**10 and
    at most 2**``MAX_BITS`` in all."""
    bits = min(MAX_BITS, max(10, ceil(log2(16 * keys.count() + 1))))
    place = F.shiftrightunsigned("fp", 64 - bits)
    words = keys.groupBy(F.shiftrightunsigned(place, 6).alias("at")) \
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n): every phrase of at most ``longest`` words that occurs at
    least ``least`` times in a language's pieces, and with 0 words, as '', the number of all
    words of each language. Written to shared storage."""
    docs = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    spark, kept = docs.sparkSession, {}
    for k in range(1, longest + 1):
        seen = spark.sparkContext.broadcast(dict(kept))
        counted = docs.mapInArrow(lambda batches, k=k, seen=seen: _count(k, seen, batches), "fp long, n long")
        kept[k] = bitmap(materialize(counted.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp"), "kept"))
    seen = spark.sparkContext.broadcast(kept)
    spelt = docs.mapInArrow(lambda batches: _spell(longest, seen, batches), "lang string, words int, phrase string, n long")
    return materialize(spelt.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
                       .where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) for every phrase of two and more words in
    ``found`` (as of ``phrases``), by its lowest-scoring cut: floor(1000 a n / (l r)), exactly."""
    counts = found.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    total = found.where("words = 0").select("lang", F.col("n").alias("total"))
    cuts = found.where("words > 1").withColumn("w", F.split("phrase", " ")) \
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .select("lang", "words", F.col("n").alias("a"), "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    joined = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]) \
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    return joined.withColumn("phrase", F.concat_ws(" ", "first", "rest")).withColumn("score", score) \
        .groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.first("total").alias("n"),
                                       F.min(F.struct("score", "k", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def outermost(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """``candidates`` (lang, phrase, words, a, ...) without those inside a longer candidate
    that occurs at least ``percent`` percent as often."""
    sizes = F.when(F.col("words") > 2, F.sequence(F.lit(2), F.col("words") - 1)).otherwise(F.array().cast("array<int>"))
    inner = candidates.select("lang", "a", "words", F.split("phrase", " ").alias("w"), F.explode(sizes).alias("m")) \
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1))) \
        .select("lang", "a", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def best(candidates: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` candidates of each language, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", "salt").orderBy(*order)
    few = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))) \
        .withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).drop("salt", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of each language."""
    candidates = materialize(scored(phrases(docs, least, longest, text_col, lang_col)), "candidates")
    return best(outermost(candidates, percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
