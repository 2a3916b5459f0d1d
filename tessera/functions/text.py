"""Text normalisation and pre-tokenisation in native expressions.

Unicode NFD has no Spark SQL function; it is put together from three steps: characters with
a canonical decomposition are replaced by look-ups of ``translate``, Hangul syllables by
arithmetic, and runs of combining marks are put in the order of their classes. Each step
is taken only by texts that need it; for ASCII texts NFD is the identity.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import chars

ASCII_ONLY = r"^[\x00-\x7F]*$"
# word runs or runs of other non-space characters, ASCII classes (same in Java and RE2)
WS_PRETOKEN_ASCII = r"([A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]+)"
# the same with Unicode classes, spelled out so Java and RE2 read them alike:
# word = letters, letter numbers, marks, decimal digits, connector punctuation, join
# controls; space = the White_Space set
UNICODE_WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
UNICODE_SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"
WS_PRETOKEN_UNICODE = f"([{UNICODE_WORD}]+|[^{UNICODE_WORD}{UNICODE_SPACE}]+)"


LONGEST = 4                              # characters of a full canonical decomposition
HANGUL, VOWELS, TAILS = 0xAC00, 21, 28   # fixed values: first syllable, medial and final letters
CLASS_BASE = 0xE000                      # combining classes as characters, above any class


@cache
def decompositions() -> tuple[str, list[str]]:
    """All characters with a canonical decomposition (but Hangul), and for each place of it a
    string as long: the character there, or the character itself where there is none."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.decomposition(c)[:1] not in ("", "<")]
    full = [unicodedata.normalize("NFD", c) for c in found]
    return "".join(found), ["".join([f[i] if i < len(f) else c for c, f in zip(found, full)]) for i in range(LONGEST)]


@cache
def combining() -> tuple[str, str, str]:
    """All combining marks, their classes as characters, and their ranges as a regex class."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    ranges: list[list[int]] = []
    for c in marks:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return ("".join(map(chr, marks)), "".join([chr(CLASS_BASE + unicodedata.combining(chr(c))) for c in marks]),
            "".join([f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges]))


def _decomposed(s: Column) -> Column:
    found, places = decompositions()
    parts = F.struct(chars(s).alias("c"), *[chars(F.translate(s, found, p)).alias(f"p{i}") for i, p in enumerate(places)])
    more = lambda z, c, i, k: F.when(z[f"p{k}"][i] != c, z[f"p{k}"][i]).otherwise("")
    each = lambda z: F.transform(z["c"], lambda c, i: F.concat(z["p0"][i], *[more(z, c, i, k) for k in range(1, LONGEST)]))
    whole = F.array_join(F.transform(F.array(parts), each)[0], "")
    return F.when(F.length(F.translate(s, found, "")) < F.length(s), whole).otherwise(s)


def _without_hangul(s: Column) -> Column:
    letters = lambda first, n: F.lit("".join(map(chr, range(first, first + n))))
    take = lambda text, i: F.substr(text, (i + 1).cast("int"), F.lit(1))

    def apart(c: Column) -> Column:
        n = F.ascii(c) - HANGUL
        tail = F.pmod(n, F.lit(TAILS))
        return F.when((n >= 0) & (n < 19 * VOWELS * TAILS), F.concat(
            take(letters(0x1100, 19), F.floor(n / (VOWELS * TAILS))), take(letters(0x1161, VOWELS), F.floor(F.pmod(n, F.lit(VOWELS * TAILS)) / TAILS)),
            F.when(tail > 0, take(letters(0x11A7, TAILS), tail)).otherwise(""))).otherwise(c)

    return F.when(s.rlike("[\\x{AC00}-\\x{D7A3}]"), F.array_join(F.transform(chars(s), apart), "")).otherwise(s)


def _ordered(s: Column) -> Column:
    """Runs of combining marks sorted by their class, those of one class in their order."""
    marks, classes, ranges = combining()

    def placed(c: Column, i: Column) -> Column:
        k = F.translate(c, marks, classes)
        return F.struct(F.when(k != c, F.ascii(k) - CLASS_BASE).otherwise(0).alias("k"), i.alias("i"), c.alias("c"))

    run = lambda r: F.array_join(F.transform(F.sort_array(F.transform(chars(r), placed)), lambda e: e["c"]), "")
    runs = F.regexp_extract_all(s, F.lit(f"([^{ranges}][{ranges}]*|[{ranges}]+)"), F.lit(1))
    sorted_ = F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > 1, run(r)).otherwise(r)), "")
    return F.when(s.rlike(f"[{ranges}]{{2}}"), sorted_).otherwise(s)


def nfd(s: Column) -> Column:
    """Canonical decomposition of a text, in Python's version of Unicode."""
    let = lambda value, step: F.transform(F.array(value), step)[0]
    return F.when(is_ascii(s), s).otherwise(let(_decomposed(s), lambda d: let(_without_hangul(d), _ordered)))


def is_ascii(s: Column) -> Column:
    return s.rlike(ASCII_ONLY)


def normalize(df: DataFrame, col: str, out: str = "normalized") -> DataFrame:
    """``df`` with lower + NFD of a column."""
    return df.withColumn(out, F.transform(F.array(F.lower(col)), nfd)[0])


def pretokenize_ws(s: Column, unicode: bool = False) -> Column:
    return F.regexp_extract_all(s, F.lit(WS_PRETOKEN_UNICODE if unicode else WS_PRETOKEN_ASCII), 1)
