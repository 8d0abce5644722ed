"""Corpus pipeline: toxicity, near duplicates, repeated substrings, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.llm import bpe_codec, mixing, near_dup, suffix_dedup, toxicity
from missiva.session import materialize, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, keep=COLUMNS)
    return scored.where("predicted = 0").select(*(F.col(f"keep_{c}").alias(c) for c in COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id."""
    return near_dup.keep_one(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; n_chars follows the text. Texts of which nothing is left stay, empty."""
    kept = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), with_text=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one seeded epoch that the leaf budgets take: at most 90 % of the tokens."""
    return mixing.keep_mixed(docs, percent=90).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every text, their count, and digests of ids and decoded text."""
    return bpe_codec.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("ids",))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", drop_repeats), ("mixing", mix), ("bpe", encode)]

#: Training, hashing and byte-pair merges are beyond SQL; tests hold the near-duplicate and repeated-substring stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written and reread."""
    small_batches(spark, "2m")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
