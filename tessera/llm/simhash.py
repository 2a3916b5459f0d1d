"""SimHash near-duplicate groups (operator 5).

A text's fingerprint has a bit where more than half of the XXH64 hashes of its word
shingles have it. Two documents link if their fingerprints differ in at most
``distance`` bits; a group is all that links reach.

Scale. Texts are read once and never shuffled; from then on a document is an id and
eight bytes. Equal fingerprints collapse first, so a huge group of copies is one row.
Pigeonhole blocks: the 64 bits are cut into ``distance + 3`` blocks, and fingerprints
at most ``distance`` bits apart agree on some three of them. They are joined on every
choice of three blocks and the pairs verified. A block shared by more than ``CROWD``
distinct fingerprints would give pairs with the square of its size, so its members are
joined another exact way: each one lists itself and its 64 one-bit neighbours, two
fingerprints are at most two bits apart exactly if these lists meet, and at most 65
fingerprints can meet at one value; each is linked to the smallest there, after the
same verification. No link between fingerprints is lost to a group: what is left out
is only what these links already connect.

Cases: a null or empty text and one of separators only have fingerprint 0 and link
like any other; repeated rows give repeated results; a row whose doc_id is null keeps
its fingerprint, has a null component and links nothing; an empty table gives none.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..session import materialize
from .arrow import with_columns
from .components import components
from .hot import join_hot

SEED = 42
CROWD = 200               # distinct fingerprints in a block that are still paired up


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    tokens = (text or "").encode().lower().split()     # bytes: A-Z only; \x20 and \x09-\x0D
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens], dtype=np.int64)
        starts = np.concatenate(([0], ends[:n - words])).tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):               # bounded memory for a very long text
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def _setup(words: int):
    return lambda texts: [[fingerprint(t, words) for t in texts]]


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of each whole text as a signed long in column ``out``."""
    return with_columns(df, text_col, partial(_setup, words), [T.StructField(out, T.LongType(), False)])


def block_masks(distance: int) -> list[int]:
    """Signed bit masks of every choice of three of ``distance + 3`` blocks."""
    n = distance + 3
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a > b, of distinct fingerprints at most ``distance`` (0 to 2) bits
    apart that connect the same groups as all such pairs do. ``fps``: distinct ``fp``."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    spark = fps.sparkSession
    if distance == 0:
        return spark.createDataFrame([], "a long, b long")
    masks = block_masks(distance)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)
    ])).alias("z")).select("fp", "z.c", "z.k")
    shared = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "simhash-shared")
    members = materialize(join_hot(keyed, shared, ["c", "k"], "n"), "simhash-blocks")

    left = members.where(F.col("n") <= CROWD)
    right = left.select(F.col("fp").alias("b"), "c", "k")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    pairs = (left.join(right, ["c", "k"]).where((F.col("fp") > F.col("b")) & (apart <= distance))
             .select(F.col("fp").alias("a"), "b"))

    crowd = members.where(F.col("n") > CROWD).select("fp").distinct()
    near = [F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]]
    meet = crowd.select("fp", F.explode(F.array(*near)).alias("flip")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    groups = meet.groupBy("v").agg(F.sort_array(F.collect_set("fp")).alias("g")).where(F.size("g") > 1)
    centre = F.col("g")[0] if distance == 2 else F.when(F.array_contains("g", F.col("v")), F.col("v"))
    stars = groups.select(centre.alias("x"), F.explode("g").alias("y")) \
        .where((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance))
    return pairs.union(stars.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()


def groups(docs: DataFrame, distance: int = 2, words: int = 3, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, fp, component): the fingerprint of every row and the smallest id reachable."""
    keep = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fp = materialize(fingerprints(keep, "text", words).select("id", "fp"), "simhash-fp")
    distinct = materialize(
        fp.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")),
        "simhash-distinct")
    label = components(links(distinct.select("fp"), distance))
    labelled = distinct.join(label, distinct.fp == label.node, "left") \
        .select("fp", "first", "n", F.coalesce("component", "fp").alias("g"))
    labelled = materialize(labelled, "simhash-labelled")
    smallest = labelled.groupBy("g").agg(F.min("first").alias("component"), F.count("*").alias("m"))
    of_fp = materialize(join_hot(labelled, materialize(smallest, "simhash-groups"), ["g"], "m")
                        .select("fp", "n", "component"), "simhash-components")
    named = join_hot(fp.where("id IS NOT NULL"), of_fp, ["fp"], "n").select("id", "fp", "component")
    return named.union(fp.where("id IS NULL").select("id", "fp", F.lit(None).cast(named.schema["component"].dataType)))


def keep_one(docs: DataFrame, distance: int = 2, words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; of repeated rows
    with one doc_id a single one stays; rows without a doc_id all stay."""
    g = groups(docs, distance, words)
    first = g.where("component = id").select(F.col("id").alias("kept_id")).distinct()
    kept = docs.join(first, docs["doc_id"] == first["kept_id"], "left_semi")
    return kept.dropDuplicates(["doc_id"]).union(docs.where("doc_id IS NULL"))
