"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes the documents its predecessor kept and returns documents with all their columns; the last
returns the packed pieces. Stages are written as tables and read again, so each starts from what is stored.
Documents are known by id and text together, so rows that share an id are handled like any others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dwellgrid.lineage import ensure_checkpoint_dir
from llm import decontamination, language_id, line_dedup, packing, simhash
from llm.tables import may_learn, table


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; learned from the labelled documents with an id that are not held out."""
    return language_id.in_clear_language(docs, language_id.learn(docs, may_learn()))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier line; lengths follow the texts."""
    count_col = "n_chars" if "n_chars" in docs.columns else None
    return line_dedup.without_repeated_lines(docs, count_col=count_col)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", clear_language),
    ("line_dedup", first_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", sequences),
]

#: Compression, MinHash verification and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages for the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
