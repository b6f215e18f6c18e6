"""A training corpus in five stages: rules, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns a DataFrame, which is written as Parquet and read again.

All stages but the last return the columns that docs came with, whatever their
names. Null and empty texts have no word, so the first stage rejects them; null
languages and sources are values like others; repeated rows are judged each by
itself, and the mix takes each as often as its own place in the plan says; very
long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import mixing, neardup, quality_rules, sentencepieces, suffix_dedup
from roadweave.llm.common import documents, settle, shared_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their cell's fences go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id. Sets of five-word shingles, similarity 0.8."""
    return neardup.keep(docs, k=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start twice or more are cut out of all their places; texts of which nothing but white space is left go."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]  # made anew from the kept text: not carried beside it
    got = suffix_dedup.remove_repeats(docs, length=200, keep_text=True, carry=others)
    cols = [F.col("kept_text").alias(c) if c == "text" else F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col("carried").getField(c).alias(c) for c in docs.columns]
    return got.where("n_removed = 0 or trim(kept_text) <> ''").select(*cols)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("repeated strings", repeated_strings), ("mix", mix), ("token ids", encode)]

#: similarity of sets, windows of bytes and token ids have no SQL form: the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    where = shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"{where}/{i}")
    return docs
