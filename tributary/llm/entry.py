"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import urlfilter
from tributary.llm.common import crc_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the rows outside fold 2."""
    from tributary.llm import langid

    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False))
    model = langid.train(docs.where(~fold))
    found = langid.predict(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "n_spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after three edits each."""
    from tributary.llm import tokencount

    return tokencount.follow(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload as a transport stream, read back and described."""
    from tributary.llm import tsmedia

    return tsmedia.features(tsmedia.media(table(spark, sf_dir, "documents")))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all vectors at cosine 0.95 and more."""
    from tributary.llm import covertree

    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of every document."""
    from tributary.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with what belongs to them."""
    from tributary.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    from tributary.llm import spm

    return spm.round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 4096 tokens."""
    from tributary.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    from tributary.llm import pii

    return pii.surrogates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_media_columns": op3_media_columns,
    "op4_cover_tree": op4_cover_tree,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}
SQL: dict[str, str] = {"op5_url_filter": urlfilter.SQL}
