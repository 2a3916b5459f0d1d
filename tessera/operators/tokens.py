"""Corpus export, word-level vocabulary, encode / pad / mask, look-ups.

The vocabulary is a small dimension table ``(token, id)``. Its size is bounded by
``vocab_size`` (or by the symbol alphabet), so it is either inlined as a map literal
(row-local encode, no shuffle) or broadcast for the long-form join variant.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import SPECIAL_TOKENS, attention_mask, chars, pad, spaced
from ..session import broadcast_small, materialize

CHAINS = (("a", "chain_a"), ("b", "chain_b"))
MAX_INLINE_VOCAB = 10_000    # beyond this a vocabulary is joined instead of written into the plan


def corpus_lines(df: DataFrame, spaced_chars: bool = False) -> DataFrame:
    """Two lines per row, chain a then chain b: (seq_id, line_no, line)."""
    fmt = (lambda c: spaced(c)) if spaced_chars else (lambda c: F.col(c))
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), fmt(col).alias("line"))
                      for i, (_, col) in enumerate(CHAINS)])
    return df.select("seq_id", F.explode(lines).alias("l")).select("seq_id", "l.line_no", "l.line")


def tokens_long(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(seq_id, chain, pos, token, *extra): lower-cased characters of both chains."""
    parts = F.array(*[F.struct(F.lit(ch).alias("chain"), F.lower(F.col(col)).alias("s"))
                      for ch, col in CHAINS])
    x = df.select("seq_id", *extra, F.explode(parts).alias("c"))
    return x.select("seq_id", *extra, F.col("c.chain").alias("chain"),
                    F.posexplode(chars(F.col("c.s"))).alias("pos", "token"))


def chain_table(df: DataFrame, aggs: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """(*extra, chain, s, *aggs): the distinct lower-cased chains in each place, aggregated. What is
    counted per symbol is counted per chain first: a word that occurs often is taken apart once."""
    parts = F.array(*[F.struct(F.lit(ch).alias("chain"), F.lower(F.col(col)).alias("s")) for ch, col in CHAINS])
    used = [c for c in df.columns if c not in ("chain", "s", "_c")]
    x = df.select(*used, F.explode(parts).alias("_c")).select(*used, "_c.chain", "_c.s")
    return x.where("s <> ''").groupBy(*extra, "chain", "s").agg(*aggs)


def counted_chains(df: DataFrame) -> DataFrame:
    """(chain, s, n): the distinct lower-cased chains in each place and how often they occur."""
    return chain_table(df.select(*[c for _, c in CHAINS]), [F.count(F.lit(1)).alias("n")])


def token_counts(df: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Token frequency over both chains, from the distinct chains and their counts (``once``: the
    ``counted_chains`` of ``df``, if they are known)."""
    x = counted_chains(df) if once is None else once
    return x.select("n", F.explode(chars("s")).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))


def fit_wl_vocab(spark: SparkSession, counts: DataFrame, vocab_size: int | None = None,
                 specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """(token, id): specials first, then count desc, token asc; at most ``vocab_size`` rows.

    Numbering runs on the distinct-token table (bounded by the alphabet / vocab_size).
    """
    ranked = counts
    if vocab_size is not None:
        ranked = counts.orderBy(F.desc("n"), "token").limit(max(0, vocab_size - len(specials)))
    w = Window.orderBy(F.desc("n"), "token")
    learned = ranked.select("token", (F.row_number().over(w) + F.lit(len(specials) - 1))
                            .cast("int").alias("id"))
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    return sp.unionByName(learned)


def vocab_dict(vocab: DataFrame) -> dict[str, int]:
    """A vocabulary (bounded by ``vocab_size`` or the alphabet) as a dictionary."""
    return {r["token"]: int(r["id"]) for r in vocab.collect()}


def encode_ids(df: DataFrame, vocab: DataFrame, max_inline: int = MAX_INLINE_VOCAB) -> DataFrame:
    """``df`` with the ids of both chains, ids_a and ids_b, for a vocabulary of any size: a
    small one goes to every task (row-local; give only the columns you need), a large one is joined
    token by token and gathered again per row. Unknown tokens raise."""
    few = vocab.select("token", "id").limit(max_inline + 1).collect()
    if len(few) <= max_inline:
        return _encode_blocks(df, {r["token"]: int(r["id"]) for r in few})
    rows = tokens_long(df).join(vocab, "token", "left")
    known = F.when(F.col("id").isNull(), F.raise_error(F.lit("token not in vocabulary"))).otherwise(F.col("id"))
    per = rows.select("seq_id", "chain", "pos", known.alias("id")).groupBy("seq_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("chain") == ch, F.struct("pos", "id")))), lambda z: z["id"])
        .alias(f"ids_{ch}") for ch, _ in CHAINS])
    none = F.array().cast("array<int>")
    out = df.join(per, "seq_id", "left")
    return out.select(*df.columns, *[F.coalesce(f"ids_{ch}", none).alias(f"ids_{ch}") for ch, _ in CHAINS])


def code_points(column: pa.Array) -> np.ndarray:
    """The symbols of all strings of a column without nulls, one after the other."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "")
    return np.frombuffer(whole[0].as_py().encode("utf-32-le"), np.uint32)


def _encode_blocks(df: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """``encode_ids`` for a vocabulary that every task holds: the symbols of a block of rows are
    one array, and their ids one look-up."""
    symbols = sorted((ord(t), i) for t, i in vocab.items() if len(t) == 1)
    known = np.array([p for p, _ in symbols], np.uint32)
    ids = np.array([i for _, i in symbols], np.int32)
    width = len(df.columns)

    def encoded(column: pa.Array) -> pa.Array:
        code = code_points(column.fill_null(""))
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        if len(code) and not (len(known) and (known[at] == code).all()):
            raise ValueError("token not in vocabulary")
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        offsets = pa.array(ends, mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(ids[at] if len(code) else np.zeros(0, np.int32)))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *[encoded(c) for c in b.columns[width:]]], names=schema.names)

    names = [f"ids_{ch}" for ch, _ in CHAINS]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])
    return df.select("*", *[F.lower(col).alias(f"_s_{ch}") for ch, col in CHAINS]).mapInArrow(run, schema)


def map_literal(d: dict, value_type: str = "int") -> Column:
    if not d:
        return F.create_map().cast(f"map<string,{value_type}>")
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def encode_wl(s: Column | str, vocab: dict[str, int], on_unknown: str = "error",
              unk_id: int = 0) -> Column:
    """Word-level ids of the lower-cased characters of ``s``.

    on_unknown: 'error' (raise, as the reference tokenizer does), 'unk' (id ``unk_id``),
    or 'drop' (skip the character).
    """
    m = map_literal(vocab)
    col = F.col(s) if isinstance(s, str) else s
    ids = F.transform(chars(F.lower(col)), lambda t: F.try_element_at(m, t))
    if on_unknown == "error":
        return F.transform(ids, lambda i: F.when(i.isNull(), F.raise_error(
            F.lit("token not in vocabulary"))).otherwise(i))
    if on_unknown == "unk":
        return F.transform(ids, lambda i: F.coalesce(i, F.lit(unk_id)))
    if on_unknown == "drop":
        return F.filter(ids, lambda i: i.isNotNull())
    raise ValueError("on_unknown must be error, unk or drop")


def decode_ids(ids: Column | str, vocab: dict[str, int]) -> Column:
    rev = map_literal({str(v): k for k, v in vocab.items()}, "string")
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(col, lambda i: F.try_element_at(rev, i.cast("string")))


def encode_join(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long-form encode: one row per token joined to the vocabulary (broadcast if small)."""
    return tokens_long(df).join(broadcast_small(vocab), "token", "left")


def decode_join(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long-form decode: rows with an ``id`` joined to the vocabulary's ``token``."""
    return ids.join(broadcast_small(vocab), "id", "left")


def max_len(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Padding length: longest chain a, chain b, and both, per ``by`` group."""
    return df.groupBy(*by).agg(
        F.max(F.length("chain_a")).alias("max_len_a"),
        F.max(F.length("chain_b")).alias("max_len_b")).withColumn(
        "max_len", F.greatest("max_len_a", "max_len_b"))


def encode_padded(df: DataFrame, vocab: dict[str, int] | DataFrame, by: Sequence[str] = ("split",),
                  pad_id: int = 0, on_unknown: str = "error") -> DataFrame:
    """ids + attention mask of both chains, right-padded to the max length of the row's
    group (train and test pad to their own length, as the reference does). A vocabulary
    given as a table (token, id) may have any size (``encode_ids``; unknown tokens raise)."""
    lens = materialize(max_len(df, by).select(*by, "max_len"), "lengths")
    if by:
        x = df.join(broadcast_small(lens), list(by))      # one row per group
    else:                                      # a scalar: inline it
        x = df.withColumn("max_len", F.lit(lens.first()["max_len"]))
    if isinstance(vocab, DataFrame):
        out = encode_ids(x, vocab)
    else:
        out = x.select("*", *[encode_wl(col, vocab, on_unknown).alias(f"ids_{ch}") for ch, col in CHAINS])
    for ch, _ in CHAINS:
        out = out.withColumn(f"mask_{ch}", attention_mask(F.size(f"ids_{ch}"), F.col("max_len"))) \
                 .withColumn(f"ids_{ch}", pad(F.col(f"ids_{ch}"), F.col("max_len"), pad_id))
    return out


def encode_combined(df: DataFrame, vocab: dict[str, int] | DataFrame, truncate: int | None = None, pad_id: int = 0) -> DataFrame:
    """``df`` with the ids of both chains as one string, padded to the longest row; cut to
    ``truncate`` symbols only if that is given. A vocabulary given as a table may have any size."""
    longest = df.agg(F.max(F.length("chain_a") + F.length("chain_b"))).first()[0] or 0
    length = longest if truncate is None else min(truncate, longest)
    if isinstance(vocab, DataFrame):
        x, ids = encode_ids(df, vocab), F.concat("ids_a", "ids_b")
    else:
        x, ids = df, encode_wl(F.concat("chain_a", "chain_b"), vocab)
    out = pad(ids if truncate is None else F.slice(ids, 1, truncate), length, pad_id)
    return x.select(*df.columns, out.alias("ids"))
