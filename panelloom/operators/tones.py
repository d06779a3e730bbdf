"""Tones of texts: a lexicon learned from labelled documents, and mean tones of groups of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each run of a-z of the lower-cased text."""
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def learned_lexicon(labelled: DataFrame, least: int = 20) -> DataFrame:
    """word, tone of documents with doc_id, text and good (1, or another number; null: no label): how much likelier a word is in good ones.

    tone is the log of the share of good documents with the word over that of the others, each with one document more of
    either kind; words of fewer than `least` labelled documents have none. A document counts once for a word: its distinct words
    are told within its row, so a frequent word is one row a task after partial aggregation. The two totals are one row.
    """
    labelled = labelled.filter("good is not null").withColumn("good", (F.col("good") == 1).cast("long"))
    own = labelled.select("good", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    counts = own.groupBy("word").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).filter(F.col("g") + F.col("b") >= least)
    totals = labelled.agg(F.sum("good").alias("_g"), F.sum(1 - F.col("good")).alias("_b"))
    tone = F.log((F.col("g") + 1.0) / (F.col("_g") + 2.0)) - F.log((F.col("b") + 1.0) / (F.col("_b") + 2.0))
    return counts.join(F.broadcast(totals), F.lit(True)).select("word", F.round(tone, 9).alias("tone"))


def mean_tones(docs: DataFrame, lexicon: DataFrame, by: str) -> DataFrame:
    """`by`, n, tone: how many words of the lexicon a group's texts have, and their mean tone.

    Words are counted by group before they meet the lexicon, so a frequent word is a row for each group.
    """
    counts = words(docs, by).groupBy(by, "word").agg(F.count("*").alias("n")).join(lexicon, "word")
    total = F.sum(F.col("n") * F.col("tone").cast("decimal(18,9)")).cast("double")
    return counts.groupBy(by).agg(F.sum("n").alias("n"), (total / F.sum("n")).alias("tone"))
