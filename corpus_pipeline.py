"""Corpus preparation: language ID, near-duplicates, PII surrogates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import langid, neardup, packing, pii
from tributary.llm.common import crc_fold, materialize, release, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a recognised language; learnt from the labelled rows outside fold 2."""
    model = langid.train(docs.where(~F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False))))
    return langid.keep_recognised(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingles alike at Jaccard 0.8 or more: SimHash proposes, sets decide."""
    return neardup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("pii", private), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)  # what the last stage wrote; the table read first is not ours and stays
    return docs
