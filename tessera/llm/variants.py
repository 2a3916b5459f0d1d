"""Grouping spelling variants by PartEnum signatures (operator 11).

Two words are near if one inserted, deleted or replaced code point turns one into the
other. A word is read as a binary vector over (letter, occurrence): the multiset of its
letters. Near words of equal length then differ in two places of the vector at most,
those of lengths L and L + 1 in one. The places are dealt into partitions; of ``PARTS``
partitions at most two can hold the differences, so equal-length words agree on one of
the C(PARTS, 2) choices of all but two partitions, and words of neighbouring lengths on
one of ``STEP_PARTS`` choices of all but one. Every choice gives a signature: a sum of
random numbers of the places chosen. As one edit also leaves the first or the last half
of a word as it was, each signature is taken once with either half. Words that share a
signature are equi-joined and verified by edit distance, so a clash of hashes costs a
comparison but changes no result, and no near pair is missed.

Scale. Only the counted words are shuffled, once for each of about 20 signatures; texts
stay where they are. A signature that more than ``CROWD`` words share is not paired up:
its words (anagrams of a common half) are joined by the word with one place blanked or
deleted instead, which only words that are near share, so a key there has at most as many
words as the alphabet has letters (times the length for deletions). Chains of forms are
followed by doubling: as a form is at least ``FACTOR`` times as frequent, a chain has at
most log2(n) links, and so log2 of that many rounds, each written to shared storage. Joins of
words with words are told to shuffle: a table of words is small as a file, and not in memory.

Cases: null and empty texts have no words; a null word takes no part; an empty table
gives no rows; repeated rows of ``count_words`` count again; a word without a near word
has n_near 0 and is its own root; ties between near words go to the one first in code
point order. Words of any length and script can be grouped. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PARTS = 4            # partitions of the letters, two of which may differ
STEP_PARTS = 2       # partitions for words of neighbouring lengths, one of which may differ
CROWD = 500          # words with one signature, beyond which they are joined by blanked places
FACTOR = 2           # a form is so many times as frequent

SAME, SHORT, LONG = 0, 1, 2     # sides of a signature: equal lengths; the shorter and the longer word
BASE = 0x9E3779B97F4A7C15           # odd, so that it can be divided by


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures [word, m] of non-empty words and their sides [m]."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(n), size)

    by_letter = np.lexsort((code, of))                       # letters of a word in order, equal ones beside each other
    letter = code[by_letter]
    first = np.flatnonzero(np.concatenate([[True], (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])]))
    occurrence = np.arange(len(letter)) - np.repeat(first, np.diff(np.concatenate([first, [len(letter)]])))
    with np.errstate(over="ignore"):
        value = mixed((letter.astype(np.uint64) << np.uint64(40)) + occurrence.astype(np.uint64) + np.uint64(BASE))
        sums = {}
        for parts in (PARTS, STEP_PARTS):
            sums[parts] = np.zeros((n, parts), np.uint64)
            np.add.at(sums[parts], (of, (letter + occurrence) % parts), value)

        place = np.arange(len(code)) - np.repeat(start[:-1], size)
        power = np.cumprod(np.full(int(size.max(initial=1)), BASE, np.uint64))
        weight = mixed(code + 1)
        sums_to = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        forward = sums_to(weight * power[place])
        backward = sums_to(weight * power[np.repeat(size, size) - 1 - place])

        def halves(length: np.ndarray) -> list[np.ndarray]:
            """Hashes of the first and of the last ``length`` letters of every word."""
            return [forward[start[:-1] + length] - forward[start[:-1]],
                    mixed(backward[start[1:]] - backward[start[1:] - length])]

        out, sides = [], []
        for side, parts, off, kept, shorter in ((SAME, PARTS, 2, size // 2, size), (SHORT, STEP_PARTS, 1, (size + 1) // 2, size),
                                                (LONG, STEP_PARTS, 1, size // 2, size - 1)):
            for half in halves(kept):
                for i, chosen in enumerate(combinations(range(parts), parts - off)):
                    total = sums[parts][:, chosen].sum(axis=1, dtype=np.uint64)
                    tag = (shorter.astype(np.uint64) * np.uint64(64) + np.uint64(i)) * np.uint64(2) + np.uint64(side > SAME)
                    out.append(mixed(mixed(total + mixed(tag)) + half))
                    sides.append(side)
    return np.stack(out, axis=1).view(np.int64), np.array(sides, np.int8)


def _signed(batches):
    for b in batches:
        if b.num_rows:
            sig, side = signatures(b.column(0).to_pylist())
            each = np.repeat(np.arange(b.num_rows), sig.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig.ravel()), pa.array(np.tile(side, b.num_rows)), b.column(0).take(pa.array(each)),
                 b.column(1).take(pa.array(each))], names=["sig", "side", "word", "n"])


def blanked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides and word numbers: each word with one place blanked (for equal lengths),
    with one deleted (the longer), whole (the shorter)."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(n), size)
    place = np.arange(len(code)) - start[of]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=1)), BASE, np.uint64))
        term = mixed(code + 1) * power[place]
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        whole = upto[start[1:]] - upto[start[:-1]]
        before = upto[:-1] - upto[start[of]]
        after = upto[start[of + 1]] - upto[1:]
        blank = mixed(mixed(whole[of] - term) + place.astype(np.uint64))
        less = before + after * np.uint64(pow(BASE, -1, 1 << 64))
        keys = np.concatenate([blank, mixed(mixed(whole) + mixed(size)), mixed(mixed(less) + mixed(size[of] - 1))])
    sides = np.repeat(np.array([SAME, SHORT, LONG], np.int8), [len(of), n, len(of)])
    return keys.view(np.int64), sides, np.concatenate([of, np.arange(n), of])


def _blanked(batches):
    for b in batches:
        if b.num_rows:
            keys, sides, of = blanked(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), b.column(0).take(pa.array(of)),
                                              b.column(1).take(pa.array(of))], names=["sig", "side", "word", "n"])


def count_words(runs: DataFrame, run: Column | str, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): how often each value of ``run`` of at least so many code points occurs,
    if at least so often."""
    return runs.select(F.col(run).alias("word") if isinstance(run, str) else run.alias("word")) \
        .where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _verified(signed: DataFrame) -> DataFrame:
    """Near pairs (word, n, other, other_n) among words that share a key on fitting sides; repeats possible.
    Spark sizes ``signed`` like the words it comes from, so the join is told to shuffle."""
    a = signed.where(F.col("side") != LONG).select("sig", F.col("side").alias("x"), "word", "n")
    b = signed.where(F.col("side") != SHORT).select("sig", F.col("side").alias("y"), F.col("word").alias("other"),
                                                    F.col("n").alias("other_n"))
    fits = ((F.col("x") == SHORT) & (F.col("y") == LONG)) | ((F.col("x") == SAME) & (F.col("y") == SAME) & (F.col("word") < F.col("other")))
    a, b = a.alias("a"), b.alias("b")
    return a.join(b.hint("merge"), (F.col("a.sig") == F.col("b.sig")) & fits & (F.levenshtein("word", "other", 1) == 1)) \
        .select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, other, other_n): every two near words of ``words`` (word, n), both ways round, once."""
    words = words.select("word", F.col("n").cast("long").alias("n")).where("length(word) > 0")
    kind = dict(words.dtypes)["word"]
    signed = words.mapInArrow(_signed, f"sig long, side byte, word {kind}, n long")
    crowded = materialize(signed.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("sig"),
                          "crowded")
    if crowded.isEmpty():
        found = _verified(signed)
    else:
        shared = signed.join(crowded, "sig", "left_semi").select("word", "n").distinct()
        found = _verified(signed.join(crowded, "sig", "left_anti")) \
            .unionByName(_verified(shared.mapInArrow(_blanked, f"sig long, side byte, word {kind}, n long")))
    way = lambda a, an, b, bn: F.struct(F.col(a).alias("word"), F.col(an).alias("n"), F.col(b).alias("other"), F.col(bn).alias("other_n"))
    both = F.explode(F.array(way("word", "n", "other", "other_n"), way("other", "other_n", "word", "n")))
    return found.distinct().select(both.alias("z")).select("z.*")


def group(words: DataFrame, factor: int = FACTOR, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; one row a
    word): the most frequent near word if it is ``factor`` times as frequent, and the end of
    the chain of forms."""
    words = words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL")
    near = near_pairs(words, crowd).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    is_form = -F.col("best.minus") >= factor * F.col("n")
    formed = materialize(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    roots = _follow(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                     "n", "n_near", "form_n")


def _follow(links: DataFrame) -> DataFrame:
    """(word, root): ``links`` (word, root; no circles) followed to their ends by doubling."""
    now = materialize(links, "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = now.join(ahead.hint("merge"), "root", "left")
        if step.where("ahead IS NOT NULL").isEmpty():
            return now
        now = materialize(step.select("word", F.coalesce("ahead", "root").alias("root")), "roots")
