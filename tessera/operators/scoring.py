"""Pair scoring: a native log-odds scorer (M4), user models through mapInPandas (M2b).

The log-odds scorer is the re-aimed multi-label pair classifier: separate token
parameters per chain and label, one shared additive combination, independent sigmoid
per label:

    lw(chain, label, tok) = ln((n_pos + 1) / (N_pos + V)) - ln((n_neg + 1) / (N_neg + V))
    prior(label)          = ln(rows_pos / rows_neg)
    p(label | a, b)       = sigmoid(prior + sum_{t in a} lw(a, label, t) + sum_{t in b} lw(b, label, t))

Training is one aggregate over the token table. The weight table has
chains x labels x |vocabulary| rows, which the driver holds. For up to ``MAX_INLINE_SYMBOLS``
symbols it is written into the plan: scoring is then row-local (no join, no shuffle) on any
data size. For more, it is a table that the symbols of the distinct chains are joined to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import SPECIAL_TOKENS, chars, clamped_log, sigmoid
from ..sources.tables import LABEL_NAMES
from ..session import broadcast_small
from .tokens import CHAINS, chain_table, map_literal

MAX_INLINE_SYMBOLS = 2000    # beyond this weights are joined instead of written into the plan
BLOCK = 1000                 # symbols in a row of a table that every position meets

FLAG_OF_LABEL = {"Q": "is_q", "T": "is_t", "X": "is_x"}


@dataclass
class LogOddsModel:
    labels: tuple[str, ...]
    weights: dict[str, dict[str, dict[str, float]]]   # chain -> label -> token -> weight
    prior: dict[str, float]                           # label -> prior log-odds
    symbols: tuple[str, ...] = field(default_factory=tuple)

    def weight_map(self, chain: str, label: str) -> Column:
        return map_literal(self.weights[chain][label], "double")

    def symbol_numbers(self, a: Column, b: Column) -> Column:
        """Places of both chains' symbols in one weight list: 1..V in chain a, V + 2 and on
        in chain b; 0 and V + 1 are unknown symbols. Found once for all labels."""
        alphabet, step = F.lit("".join(self.symbols)), len(self.symbols) + 1
        place = lambda s, add: F.transform(chars(F.lower(s)), lambda t: F.position(t, alphabet) + add)
        return F.concat(place(a, 0), place(b, step))

    def logit_of(self, numbers: Column, label: str) -> Column:
        """Prior plus the weights at ``numbers``: a list read by index, no look-up by symbol."""
        w = [F.lit(float(x)) for ch, _ in CHAINS
             for x in (0.0, *(self.weights[ch][label].get(t, 0.0) for t in self.symbols))]
        return F.aggregate(numbers, F.lit(float(self.prior[label])), lambda acc, i: acc + F.element_at(F.array(*w), i + 1))

    def logit(self, a: Column, b: Column, label: str) -> Column:
        return self.logit_of(self.symbol_numbers(a, b), label)

    def with_logits(self, df: DataFrame, names: Sequence[str], a: str = "chain_a", b: str = "chain_b") -> DataFrame:
        """``df`` with one logit column per label."""
        if len(self.symbols) > MAX_INLINE_SYMBOLS:
            return self._joined_logits(df, names, a, b)
        x = df.withColumn("_numbers", self.symbol_numbers(F.col(a), F.col(b)))
        return x.select("*", *[self.logit_of(F.col("_numbers"), lb).alias(n) for lb, n in zip(self.labels, names)]).drop("_numbers")

    def table(self, spark: SparkSession) -> DataFrame:
        """(c, symbol, place, w): the weights of every symbol in each chain (c, its number), by
        label; places from 1 in the order of the symbols."""
        rows = [(c, t, i + 1, [float(self.weights[ch][lb].get(t, 0.0)) for lb in self.labels])
                for c, (ch, _) in enumerate(CHAINS) for i, t in enumerate(self.symbols)]
        return spark.createDataFrame(rows, "c int, symbol string, place int, w array<double>")

    def blocks(self, spark: SparkSession) -> DataFrame:
        """(c, symbols): the rows of ``table`` in blocks of ``BLOCK``, as arrays of (symbol, place, w)."""
        return self.table(spark).groupBy("c", F.floor((F.col("place") - 1) / BLOCK).alias("block")) \
            .agg(F.collect_list(F.struct("symbol", "place", "w")).alias("symbols")).drop("block")

    def _joined_logits(self, df: DataFrame, names: Sequence[str], a: str, b: str) -> DataFrame:
        """The weights of the distinct chains' symbols are joined and summed, and the sums joined to the rows."""
        chain = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lower(col).alias("chain")) for c, col in enumerate((a, b))]))
        once = df.select(chain.alias("z")).select("z.c", "z.chain").where("chain <> ''").distinct()
        n = once.select("c", "chain", F.explode(chars(F.col("chain"))).alias("symbol")).groupBy("c", "chain", "symbol").agg(F.count("*").alias("n"))
        met = n.join(broadcast_small(self.table(df.sparkSession)), ["c", "symbol"])
        sums = met.groupBy("c", "chain").agg(*[F.sum(F.col("n") * F.col("w")[i]).alias(f"_s{i}") for i in range(len(self.labels))])
        out = df
        for c, col in enumerate((a, b)):
            side = sums.where(F.col("c") == c).select(F.col("chain").alias("_chain"), *[F.col(f"_s{i}").alias(f"_s{c}{i}") for i in range(len(self.labels))])
            out = out.join(side, F.lower(col) == F.col("_chain"), "left").drop("_chain")
        part = lambda c, i: F.coalesce(f"_s{c}{i}", F.lit(0.0))
        return out.select(*df.columns, *[(F.lit(float(self.prior[lb])) + part(0, i) + part(1, i)).alias(n)
                                         for i, (lb, n) in enumerate(zip(self.labels, names))])


def weight_table(train: DataFrame, symbols: Sequence[str],
                 labels: Sequence[str] = LABEL_NAMES) -> tuple[DataFrame, DataFrame]:
    """Fit the log-odds weights on ``train`` (seq rows with is_q/is_t/is_x).

    Returns (weights(chain, label, token, weight), priors(label, prior)).
    """
    flags = [FLAG_OF_LABEL[lb] for lb in labels]
    agg = []
    for lb, f in zip(labels, flags):
        agg += [F.sum(F.col(f)).alias(f"p_{lb}"), F.sum(F.lit(1) - F.col(f)).alias(f"n_{lb}")]
    counts = _per_symbol(chain_table(train.select(*[c for _, c in CHAINS], *flags), agg))      # chains x tokens rows
    spark = train.sparkSession
    sym = spark.createDataFrame([(s,) for s in symbols], "token string") \
        .select("token", F.explode(F.array(*[F.lit(c) for c, _ in CHAINS])).alias("chain"))
    V = float(len(symbols))
    t = sym.join(counts, ["chain", "token"], "left").fillna(0)
    per_chain = Window.partitionBy("chain")                    # bounded: |vocabulary| rows
    rows = []
    for lb in labels:
        npos, nneg = F.col(f"p_{lb}").cast("double"), F.col(f"n_{lb}").cast("double")
        Npos, Nneg = F.sum(npos).over(per_chain), F.sum(nneg).over(per_chain)
        wcol = (F.ln((npos + 1.0) / (Npos + V)) - F.ln((nneg + 1.0) / (Nneg + V)))
        rows.append(t.select("chain", F.lit(lb).alias("label"), "token", wcol.alias("weight")))
    weights = rows[0]
    for r in rows[1:]:
        weights = weights.unionByName(r)
    pri = train.agg(*[F.sum(F.col(f)).alias(f"p_{lb}") for lb, f in zip(labels, flags)],
                    F.count(F.lit(1)).alias("_n"))
    priors = pri.select(F.explode(F.array(*[
        F.struct(F.lit(lb).alias("label"),
                 clamped_log(F.col(f"p_{lb}").cast("double") / (F.col("_n") - F.col(f"p_{lb}")))
                 .alias("prior")) for lb in labels])).alias("p")).select("p.label", "p.prior")
    return weights, priors


def _per_symbol(table: DataFrame) -> DataFrame:
    """The sums of a ``chain_table`` by (chain, token): each chain counts for every symbol in it."""
    sums = [c for c in table.columns if c not in ("chain", "s")]
    x = table.select("chain", *sums, F.explode(chars("s")).alias("token"))
    return x.groupBy("chain", "token").agg(*[F.sum(c).alias(c) for c in sums])


def fit_vocab_and_model(train: DataFrame, labels: Sequence[str] = LABEL_NAMES,
                        specials: Sequence[str] = SPECIAL_TOKENS,
                        vocab_size: int | None = None) -> tuple[dict[str, int], LogOddsModel]:
    """Word-level vocabulary (of all train rows) and log-odds weights (of those with
    labels) from ONE aggregate over the train tokens, grouped by (chain, token) -- chains
    x alphabet rows reach the driver -- plus one row of label counts. Same numbers as
    ``fit_wl_vocab`` and ``weight_table``."""
    import math

    flags = [FLAG_OF_LABEL[lb] for lb in labels]
    aggs = [F.count(F.lit(1)).alias("n")]
    for lb, f in zip(labels, flags):                      # null flags (no labels) count for neither
        aggs += [F.coalesce(F.sum(f), F.lit(0)).alias(f"p_{lb}"), F.coalesce(F.sum(1 - F.col(f)), F.lit(0)).alias(f"n_{lb}")]
    stats = _per_symbol(chain_table(train.select(*[c for _, c in CHAINS], *flags), aggs)).collect()
    pri = train.agg(F.count(flags[0]).alias("n"),
                    *[F.sum(F.col(f)).alias(f"p_{lb}") for lb, f in zip(labels, flags)]).first()
    totals: dict[str, int] = {}
    for r in stats:
        totals[r["token"]] = totals.get(r["token"], 0) + r["n"]
    ranked = sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))
    if vocab_size is not None:
        ranked = ranked[:max(0, vocab_size - len(specials))]
    vocab = {t: i for i, t in enumerate(specials)}
    for t, _ in ranked:
        vocab[t] = len(vocab)
    symbols = [t for t, _ in sorted(vocab.items(), key=lambda kv: kv[1]) if "[" not in t]
    V = float(len(symbols))
    by = {(r["chain"], r["token"]): r for r in stats}
    weights: dict[str, dict[str, dict[str, float]]] = {}
    for ch, _ in CHAINS:
        weights[ch] = {}
        for lb in labels:
            pos = {t: (by[(ch, t)][f"p_{lb}"] if (ch, t) in by else 0) for t in symbols}
            neg = {t: (by[(ch, t)][f"n_{lb}"] if (ch, t) in by else 0) for t in symbols}
            NP, NN = float(sum(pos.values())), float(sum(neg.values()))
            weights[ch][lb] = {t: math.log((pos[t] + 1.0) / (NP + V)) - math.log((neg[t] + 1.0) / (NN + V))
                               for t in symbols}
    prior = {}
    for lb in labels:
        p, n = float(pri[f"p_{lb}"] or 0), float(pri["n"])
        prior[lb] = max(math.log(p / (n - p)), -100.0) if p > 0 and n > p else (-100.0 if p == 0 else 100.0)
    return vocab, LogOddsModel(tuple(labels), weights, prior, tuple(symbols))


def score_log_odds(df: DataFrame, model: LogOddsModel, a: str = "chain_a", b: str = "chain_b",
                   out: str = "prob", logit_out: str | None = None) -> DataFrame:
    """Adds ``prob`` = ARRAY<DOUBLE> of per-label probabilities (label order of the model)."""
    names = [f"_z_{lb}" for lb in model.labels]
    x = model.with_logits(df, names, a, b).withColumn("_z", F.array(*names)).drop(*names)
    x = x.withColumn(out, F.transform("_z", lambda z: sigmoid(z)))
    if logit_out:
        x = x.withColumnRenamed("_z", logit_out)
    return x.drop("_z")


def score_with_model(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
                     cols: Sequence[str] = ("chain_a", "chain_b"), keep: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Batch scoring with any Python model: ``make_model()`` is called once per task and
    returns ``f(pdf[cols]) -> (n, L)`` probabilities. Arrow batches via mapInPandas; the
    ``keep`` columns pass through, so nothing is joined back."""
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("prob", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            out = pdf[list(keep)].copy()
            out["prob"] = list(np.asarray(model(pdf[list(cols)]), float))
            yield out

    return df.select(*dict.fromkeys([*keep, *cols])).mapInPandas(run, schema)


def numpy_log_odds(model: LogOddsModel) -> Callable[[], Callable[[pd.DataFrame], np.ndarray]]:
    """The log-odds model over whole batches (a stand-in for any user model): symbols of a
    batch are one array, their weights one look-up, and each row a sum over its stretch."""
    V = len(model.symbols)
    table = np.array([[0.0, *(model.weights[ch][lb].get(t, 0.0) for t in model.symbols)]
                      for ch, _ in CHAINS for lb in model.labels]).reshape(len(CHAINS), len(model.labels), V + 1)
    prior, points = [model.prior[lb] for lb in model.labels], [ord(t) for t in model.symbols]

    def make():
        order = np.argsort(points)
        known = np.array(points)[order]

        def f(pdf: pd.DataFrame) -> np.ndarray:
            z = np.tile(np.array(prior, float), (len(pdf), 1))
            for k in range(len(CHAINS)):
                text = pdf.iloc[:, k].str.lower()
                size = text.str.len().to_numpy()
                code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
                at = np.minimum(np.searchsorted(known, code), V - 1)
                number = np.where(known[at] == code, order[at] + 1, 0)
                row = np.repeat(np.arange(len(pdf)), size)
                for j in range(z.shape[1]):
                    z[:, j] += np.bincount(row, table[k, j, number], minlength=len(pdf))
            return 1.0 / (1.0 + np.exp(-z))
        return f

    return make


def write_model(spark: SparkSession, model: LogOddsModel, path: str) -> None:
    """The whole scorer as parquet: weights by chain, label and symbol, and the priors;
    ``at`` and ``place`` keep the order of labels and symbols."""
    place = {t: i for i, t in enumerate(model.symbols)}
    rows = [(c, lb, t, place[t], w) for c, per in model.weights.items() for lb, tw in per.items() for t, w in tw.items()]
    spark.createDataFrame(rows, "chain string, label string, token string, place int, weight double") \
        .write.mode("overwrite").parquet(f"{path}/weights")
    priors = [(i, lb, model.prior[lb]) for i, lb in enumerate(model.labels)]
    spark.createDataFrame(priors, "at int, label string, prior double").write.mode("overwrite").parquet(f"{path}/priors")


def read_model(spark: SparkSession, path: str) -> LogOddsModel:
    """A scorer from its files alone (chains x labels x symbols rows)."""
    weights: dict = {}
    place: dict[str, int] = {}
    for r in spark.read.parquet(f"{path}/weights").collect():
        weights.setdefault(r["chain"], {}).setdefault(r["label"], {})[r["token"]] = r["weight"]
        place[r["token"]] = r["place"]
    priors = sorted(spark.read.parquet(f"{path}/priors").collect(), key=lambda r: r["at"])
    return LogOddsModel(tuple(r["label"] for r in priors), weights, {r["label"]: r["prior"] for r in priors},
                        tuple(sorted(place, key=place.get)))


def spark_symbols(spark: SparkSession, vocab: dict[str, int]) -> list[str]:
    """Vocabulary entries that are symbols (no '['), in id order."""
    return [t for t, _ in sorted(vocab.items(), key=lambda kv: kv[1]) if "[" not in t]
