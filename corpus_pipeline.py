"""A corpus pipeline of five stages: language, exact copies, near copies, secrets, packing. Each maps documents to documents; the last packs them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, language, packing, secrets, simhash
from marlstone.llm.scale import crc32_mod, ship, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model is fitted on the documents that aren't held out."""
    return language.keep_identified(docs, language.fit_languages(docs, crc32_mod(F.col("doc_id"), 3) != 1))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return simhash.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text."""
    return secrets.redact_secrets(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [("language", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

#: The language model and the packing can't be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; each stage's documents are written before the next one reads them."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
