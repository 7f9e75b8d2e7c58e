"""From raw documents to packed training sequences, in five stages.

Each stage works on what the one before it kept, and its result is written and read
again, so that a lost executor costs tasks of one stage. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.llm import decontam, langid, neardup, packing, secrets_scan
from hotgrid.llm.common import only, table, without, written

#: Languages that the corpus is to have; None: every language that the model has learned.
LANGUAGES: tuple[str, ...] | None = None
#: Least score of a document's language. The score is the language's share of the letters, lowered where a
#: rival is close: below, no language has most of the text.
LEAST_SCORE = 0.5


def language(
    spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES, least: float = LEAST_SCORE
) -> DataFrame:
    """Documents go in which the model finds no wanted language (``und``, or another), or none for most of the text.

    Null texts and texts without a letter are ``und``. Rows that repeat go or stay together; a row with a
    null id has no name to be taken out by, and stays. An empty table stays empty.
    """
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out())))
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    if languages is not None:
        kept &= F.col("lang_pred").isin(*languages)
    return without(docs, found.where(~kept).select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, of a row that repeats one.

    Null and blank texts, and rows with a null id, have no copies and stay.
    """
    found = written(neardup.near_duplicates(docs), "groups")
    docs = without(docs, found.where("doc_id <> group_id").select("doc_id"))
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    return without(docs, twice).unionByName(only(docs, twice).dropDuplicates(["doc_id", "text"])).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null texts, and rows with a null id, stay."""
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, a null stays null; every document and row stays."""
    return secrets_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null text is the id 0 alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", hide_secrets), ("packing", pack)]

#: Signatures, word models and tokens are not to be had in SQL; tests/llm/test_pipeline.py runs the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
