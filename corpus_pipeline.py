"""The corpus pipeline: language ID, near-duplicate join, decontamination, mixing and sharding of ``documents``.

Each stage works on all rows that the stage before it kept and returns the columns of ``documents``; the last
one returns the place of every row. SQL expresses neither the language model nor the alignments, so there is none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docketry.llm import decontaminate, forest, langid
from docketry.llm.mixing import Mixture, mix_rows
from docketry.llm.sharding import shard_rows
from docketry.session import cut_lineage

SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a likeliest language; the model learns from labelled rows."""
    names = langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    langs, table = langid.train(docs.select("text", "lang"), names)
    return langid.keep_identified(docs, langs, table, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of copies."""
    return forest.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a region with a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of rare sources up to twice; every document stays."""
    return mix_rows(docs, Mixture(repeat_limit=2.0))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shard_rows(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{at}")
    return docs
