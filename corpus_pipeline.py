"""A corpus pipeline: language ID, near dedup, substring dedup, benchmark decontamination and packing.

Each stage reads what the one before it wrote, and decides by what its operator in
``tessera.llm`` finds in that. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.contamination import contaminated
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.passages import repeated_passages, without_repeats
from tessera.llm.shared import table
from tessera.plans.catalogue import small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Ids that are broadcast at most, 8 bytes each; beyond it texts are shuffled to meet them.
IDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``gone``."""
    ids = table(gone.distinct(), "gone")
    return docs.join(small(ids, IDS), "doc_id", "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score over the calibrated limit stay; lang is as predicted.

    With no labelled document to learn from, no language can be told and nothing stays.
    """
    if not language.learnable(docs).limit(1).count():
        return docs.limit(0)
    found = language.identify(docs, language.train(docs)).where("accepted")
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; rows without doc_id stay."""
    return _without(docs, near_duplicates(docs).where("not kept").select("doc_id"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut; documents of which no word is left go."""
    return without_repeats(docs, repeated_passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A fitted model, a tokenizer and passages grown over edits are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
