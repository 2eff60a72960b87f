"""The corpus pipeline: toxicity, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept
and returns a DataFrame; the next stage reads it from a written table. The two
filters train on the labelled rows of their own input.

An empty table gives an empty result, a row with a null or empty text has no
toxic term and is rejected by the quality classifier; rows that repeat a doc_id
are copies, of which one stays. Columns besides doc_id and text are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspark.llm.common import materialize, table
from linkspark.llm.packing import pack
from linkspark.llm.quality_classifier import keep_good
from linkspark.llm.simhash import drop_near_copies
from linkspark.llm.toxicity import drop_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("toxicity", clean), ("quality_classifier", good), ("simhash_near_dedup", drop_copies), ("best_fit_packing", pack_sequences)]

#: Trained models, 64-bit hashes and a tokenizer: no stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
