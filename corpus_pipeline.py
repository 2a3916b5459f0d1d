"""The training-data pipeline over ``documents``: one operator after the other.

Every stage takes all that its predecessor kept and returns the columns of
``documents``, the last one the tokens. Stages handle any extra columns and null cells
as their operators do; a document without an id is judged and mixed like any other and
kept by the duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, nbsvm, poisson_mix, simhash, toxicity_cnn
from tessera.llm.queries import held_out
from tessera.session import scratch_path
from tessera.sources.tables import table

#: SQL can't say the classifiers and the encoder; the tests compare stages with brute force.
ORACLE_SQL = None

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUALITY = 0.3             # documents below are rejected
TOXICITY = 0.5            # documents from here on are rejected
WORDS, DISTANCE = 3, 2    # shingle length and bit distance of the duplicate stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of at least ``QUALITY``, learned as in op6."""
    model = nbsvm.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return nbsvm.reject(docs, model, QUALITY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score below ``TOXICITY``, learned as in op3."""
    model = toxicity_cnn.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return toxicity_cnn.reject(docs, model, TOXICITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id."""
    return simhash.keep_one(docs, DISTANCE, WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that every source has an equal share, in a global random order."""
    return poisson_mix.mix(docs).drop("copy", "order_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every copy, with the SHA-256 of the ids decoded again."""
    coded = bpe_codec.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("mixture", mixture), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared scratch folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
