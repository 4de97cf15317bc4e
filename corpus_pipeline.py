"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's input.

Nulls: a null or empty text is scored like any other, is a near copy of nothing, has nothing to cut, takes no
words in the mix and so ends there; a null id or source is kept as it is.  Very long texts are taken whole.  Repeated
rows are near copies: one stays.  Ties go to the least id.  Other columns, whatever they are called, are kept up to the mix.
An empty table gives empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import bpe_codec, mixing, neardup, quality, scratch, suffix


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.3 go."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that occur elsewhere too go, every occurrence; documents stay."""
    return suffix.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their source's target gives them."""
    return mixing.apply(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the tokens and of what they decode to.

    The codec's caches are smaller than when it runs alone: the executors' heaps have
    grown by the stages before.
    """
    return bpe_codec.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=200_000, states=60_000)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Trained dictionaries and byte-level merges can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
