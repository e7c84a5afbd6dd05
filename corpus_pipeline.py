"""The corpus pipeline: language ID, toxicity, exact dedup, near dedup and packing, each stage over what the last kept.

All stages but the last return the rows they keep with all their columns, whatever their names. Rows with a null text have no
language and go in the first. Rows with a null id are judged like others where a stage judges texts, and stay where it
compares documents. Rows that repeat an id and its text stay or go together. An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import exact_dedup, langid, minhash, packing, toxicity
from feedlens.llm.common import clear, cut, fold, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no known language."""
    return langid.keep_identified(docs, langid.train(docs, fold(F.col("doc_id"), 4) != 2))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(docs)
    gone = cut(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    return minhash.with_ids(docs, "doc_id", gone, "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs)
    gone = cut(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    return minhash.with_ids(docs, "doc_id", gone, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


__all__ = ["ORACLE_SQL", "STAGES", "clear", "run"]

STAGES = [("language_id", language), ("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("best_fit_packing", pack)]

#: Trained stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep. clear(spark) removes the stages' tables when they are stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
