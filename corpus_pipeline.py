"""Corpus pipeline: five stages, each one operator over all that its predecessor kept.

`run` writes every stage's result to the shared folder and reads it again, so a stage starts from
a table and survives the loss of any executor. All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, language, mixing, near_join, queries, token_files


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters, however sure their language; learns from the labels of its own input."""
    common.ship(spark)
    named = language.identify(docs, language.train(docs.filter(~common.held_out(5, 0))))
    return named.filter(F.col("_lang") != language.UNDETERMINED).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    common.ship(spark)
    return near_join.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    common.ship(spark)
    return decontaminate.removed_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    common.ship(spark)
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies, and what they hold per document."""
    common.ship(spark)
    return token_files.tokenised(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: Trained models, sampling and the tokenizer are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir))
    return docs
