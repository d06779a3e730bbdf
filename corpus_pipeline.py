"""A training corpus from raw documents: language ID, near-dedup, substring dedup, mixing, packing.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import common, langid, mixing, neardup, packing, queries, substrings

#: SQL has no recurrent network, graph components or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text that a range of mixed rows has about. Past MOST_RANGES ranges (800 GB) they grow instead: 2 GB each at 100 TB, sorted with spilling.
RANGE_BYTES, MOST_RANGES = 16 << 20, 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters go, and lang becomes the predicted language.

    Null and empty texts have no letters. Rows are judged one by one, so null and repeated doc_ids and equal rows stay, and
    ties between languages go to the smaller name. A null lang is no lesson, but is predicted. A very long text is one row.
    Columns that documents don't have go; an empty table gives an empty one.
    """
    found = langid.identify(docs, langid.train(docs), carry=("text", "source", "n_chars"))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id, by five-word shingles at 0.8.

    A row is told by its doc_id and text: of rows that repeat a doc_id each is judged by its own text, and of equal ones the
    least row stays. A row with a null doc_id stays, as does one without words. Very long texts are compared whole. Columns
    that documents don't have go; an empty table gives an empty one.
    """
    key = ["doc_id", "d1", "d2"]
    told = neardup.near_duplicates(docs, with_text=True).filter("doc_id is not null").groupBy(*key).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    told = common.materialize(told.filter("not kept or n > 1"), "near-copies")
    rows = neardup.with_digests(docs.select(*COLUMNS))
    out = rows.join(told.select(*key), key, "left_anti").select(*COLUMNS)
    again = told.filter("kept").select(*key)
    if again.isEmpty():
        return out
    least = rows.join(again, key).groupBy(*key).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return out.unionByName(least.select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand in a document of a smaller doc_id; emptied documents go.

    A text that loses nothing is untouched; one without words stays. A row with a null doc_id loses nothing. Rows that repeat
    a doc_id are judged each by its own text. Columns that documents don't have go; an empty table gives an empty one.
    """
    cut = substrings.dedup_substrings(docs, keep_text=True, carry=("lang", "source")).filter("n_removed < n_words or n_words = 0")
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix, which packing keeps within each source: ranges of slots, sorted within.

    A range has about RANGE_BYTES of text, up to MOST_RANGES ranges, as each range's bound is held by every task; beyond 800 GB
    the ranges grow instead, to 2 GB each at 100 TB, and are sorted with spilling. No row is dropped.

    A null source is the source ''. Null and repeated doc_ids and equal rows are rows of their own, long texts too. Columns
    that documents don't have go; an empty table gives an empty one.
    """
    placed = mixing.mix_order(docs.select(*COLUMNS))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, size // RANGE_BYTES))
    return placed.repartitionByRange(ranges, "slot", "in_block").sortWithinPartitions("slot", "in_block").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with the mix's targets as the sources' shares of every window; sources that end drop out.

    A source's documents stand in the order of the mix. Every row is packed, with null, repeated or equal doc_ids too; a null
    text is an end mark alone, and a long one is cut where windows end. An empty table gives no pieces.
    """
    return packing.pack(docs, queries.tokenizer_path(), weights=mixing.tempered(mixing.rows_of(docs)), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written in the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
