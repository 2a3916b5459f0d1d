"""Named queries of the operators in this subpackage: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import table
from . import (bpe_codec, collocations, divergence, langid, lcp, nbsvm, one_bit_ann, poisson_mix, simhash, sql, tag_paths, toxicity_cnn,
               unigram_counts, variants)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def held_out() -> F.Column:
    """True for rows kept from learning: crc32 of the id's text modulo 5 is 0 (a null id: '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


@query
def op1_lcp_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return lcp.compare_edits(table(spark, sf_dir, "documents"))


@query
def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return tag_paths.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out()).select("doc_id", "held_out", "text", "lang")
    model = toxicity_cnn.fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return toxicity_cnn.score(docs.drop("lang"), model) \
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = simhash.groups(docs, distance=2, words=3)
    return g.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("component").alias("component_id"))


@query
def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out()).select("doc_id", "held_out", "text")
    model = nbsvm.fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model) \
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents in which every source has an equal share of the characters."""
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


ORACLE["op7_poisson_mix"] = sql.POISSON_MIX


@query
def op8_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    index = one_bit_ann.OneBitIndex(table(spark, sf_dir, "embeddings"))
    return index.search(index.rows.where("id % 20 = 0"), k=20)


@query
def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, tokens and best segmentation score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = unigram_counts.counts(docs, unigram_counts.load(PIECES))
    return counted.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens", "score")


@query
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.digests(bpe_codec.encode(docs, WORD_BPE, decoded="decoded"))


#: Letters of Western European words.
LETTERS = "[A-Za-z\u00C0-\u00FF]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt_runs(docs: DataFrame) -> DataFrame:
    """(run): the runs of letters of every text in lower case; one in 97, by the crc32 of
    `<doc_id>:<run>` (null id: ''), lacks one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(LETTERS), F.lit(0))).alias("run"))
    drawn = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return drawn.select(F.when(F.col("h") % 97 == 0, shorter).otherwise(F.col("run")).alias("run"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 5 letters and 3 occurrences with its form and root."""
    runs = misspelt_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return variants.group(materialize(variants.count_words(runs, "run", 5, 3), "words"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best-scoring phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


ORACLE["op12_collocations"] = sql.COLLOCATIONS


@query
def op13_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances from the language's reference and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = divergence.judge(docs, divergence.references(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.round("words_apart", 6).alias("words_apart"), F.round("chars_apart", 6).alias("chars_apart"), "kept")


ORACLE["op13_divergence_rules"] = sql.DIVERGENCE_RULES.replace("WORDS_LIMIT", repr(divergence.WORDS_APART)) \
    .replace("CHARS_LIMIT", repr(divergence.CHARS_APART)).replace("CHANCE", repr(divergence.CHANCE))
