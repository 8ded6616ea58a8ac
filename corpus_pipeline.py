"""Corpus pipeline: language ID, toxicity, SimHash near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topshare.llm import language_id, simhash, toxicity
from topshare.llm.common import table, written
from topshare.llm.queries import packed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the table stay; ``und`` and doubtful ones go."""
    return language_id.keep_identified(docs, language_id.train(language_id.training_rows(docs, F.lit(True))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, toxicity.train(rows))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of ``op6_simhash`` stays, the one with the least doc_id.

    Near copies that differ in more than two bits stay too; README has their share.
    """
    return simhash.keep_one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", simhash_dedup),
    ("packing", pack_sequences),
]

#: Trained models, a public tokenizer and XXH64 have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
