"""Vocabularies as tables: terms looked up by seeds, so work does not grow with the number of terms.

A term is found through one of its pieces, the seed: its rarest piece of ``SEED`` characters among the texts (a shorter
term is its own seed). Texts are cut into their distinct pieces, those that are seeds are kept, and what remains is
verified with ``contains``. A text gives at most ``SEED`` rows a character, whether there are ten terms or a million,
and a term whose pieces do not occur at all is gone before the join. Catalyst broadcasts the seeds where they are
small and shuffles both sides where they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions import text as tx
from docketry.operators.classify import classified
from docketry.operators.matching import text_pieces

SEED = 4


def term_hits(texts: DataFrame, text: str, terms: DataFrame, word: str = "word", key: str | None = None) -> DataFrame:
    """Distinct (key, word) where the text of a key contains the word, spaces and case as they are.

    Without ``key`` the text itself is the key; with one, which must be unique, texts are not carried along with their
    pieces. Null and empty texts and words match nothing.
    """
    key = key or text
    own = terms.select(F.col(word).alias("__word")).distinct().where(F.length("__word") > 0)
    width = F.least(F.length("__word"), F.lit(SEED))
    lengths = own.agg(F.collect_set(width)).scalar()
    hay = texts.select(text).distinct() if key == text else texts.select(key, text)
    pieces = hay.where(F.length(text) > 0).withColumn("__lengths", lengths).select(
        F.col(key).alias("__key"), F.explode(text_pieces(F.col(text), F.col("__lengths"))).alias("__seed")
    )
    parts = own.select("__word", F.explode(text_pieces(F.col("__word"), F.array(width))).alias("__seed"))
    counts = pieces.join(parts.select("__seed").distinct(), "__seed", "left_semi").groupBy("__seed").agg(F.count("*").alias("__n"))
    seen = parts.join(counts, "__seed", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    seeds = seen.groupBy("__word").agg(F.min(F.struct("__n", "__seed")).alias("least")).where("least.__n > 0").select("__word", "least.__seed")
    found = pieces.join(seeds, "__seed").select("__key", "__word")
    if key == text:
        return found.where(F.contains("__key", F.col("__word"))).select(F.col("__key").alias(key), F.col("__word").alias(word))
    checked = found.join(hay, F.col("__key") == F.col(key)).where(F.contains(text, F.col("__word")))
    return checked.select(key, F.col("__word").alias(word))


def _bare_words(terms: DataFrame) -> DataFrame:
    return terms.withColumn("word", F.replace("word", F.lit(" "), F.lit(""))).where("word <> ''")


def _with_found(df: DataFrame, title: str, found: DataFrame) -> DataFrame:
    """Rows with what was found for their bare title, which is unique in ``found``."""
    return df.withColumn("__bare", tx.bare(title)).join(found, "__bare", "left").drop("__bare")


def _hits(df: DataFrame, title: str, terms: DataFrame) -> DataFrame:
    """Every distinct bare title with the terms in it."""
    return term_hits(df.select(tx.bare(title).alias("__bare")), "__bare", terms).join(terms, "word")


def classify_by_table(df: DataFrame, title: str, terms: DataFrame, or_word: str = "또는") -> DataFrame:
    """``classify_titles`` with a table of terms: ord, key, form, word."""
    terms = _bare_words(terms.select(F.col("ord").cast("int"), "key", "form", "word"))
    none = F.array().cast("array<struct<ord:int,key:string,form:boolean,word:string>>")
    words = F.array_sort(F.collect_list(F.struct("ord", "key", "form", "word")))
    rows = _with_found(df, title, _hits(df, title, terms).groupBy("__bare").agg(words.alias("__words")))
    return classified(rows, title, F.coalesce("__words", none), or_word).drop("__words")


def glossary_by_table(df: DataFrame, title: str, patterns: DataFrame) -> DataFrame:
    """Add ``entry_key``: the key of the longest pattern in the bare title. ``patterns`` has ord, key, word; the lower
    ord decides between patterns of one length."""
    patterns = _bare_words(patterns.select("ord", "key", "word"))
    best = F.min(F.struct((-F.length("word")).alias("rank"), "ord", "key"))["key"]
    return _with_found(df, title, _hits(df, title, patterns).groupBy("__bare").agg(best.alias("entry_key")))


def stages_by_table(filings: DataFrame, stages: DataFrame) -> DataFrame:
    """``match_stages`` with a table: chain, chain_ord, stage, stage_label, stage_ord, word."""
    stages = _bare_words(stages.select("chain", "chain_ord", "stage", "stage_label", "stage_ord", "word"))
    first = F.min(F.struct("stage_ord", "stage", "stage_label")).alias("m")
    per_chain = _hits(filings, "title", stages).groupBy("__bare", "chain", "chain_ord").agg(first)
    own = F.array_sort(F.collect_list(F.struct("chain_ord", "chain", "m"))).alias("__chains")
    rows = _with_found(filings, "title", per_chain.groupBy("__bare").agg(own))
    return rows.withColumn("c", F.explode("__chains")).select(
        *filings.columns, "c.chain", "c.chain_ord", "c.m.stage", "c.m.stage_label", "c.m.stage_ord"
    )
