"""One query for each operator over its whole table, with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    chat_format,
    decontamination,
    fill_in_middle,
    language_id,
    line_dedup,
    line_quality,
    packing,
    pseudo_likelihood,
    simhash,
    source_audit,
    substring_dedup,
    token_counts,
    toxicity,
)
from llm.tables import held_out, may_learn, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.judged(docs, line_quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.conversations(table(spark, sf_dir, "conversations"))
    return chat_format.preference_pairs(chat_format.stale_reply_pairs(turns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.marked_lines(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.language_of(docs, language_id.learn(docs, may_learn()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), digests=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.example_digests(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_pseudo_likelihood,
        op3_line_quality,
        op4_preference_format,
        op5_line_dedup,
        op6_decontamination,
        op7_toxicity,
        op8_best_fit_packing,
        op9_simhash,
        op10_language_id,
        op11_substring_dedup,
        op12_fill_in_middle,
        op13_source_audit,
    )
}

ORACLE: dict[str, str] = {
    "op4_preference_format": chat_format.ORACLE_SQL,
    "op11_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op13_source_audit": source_audit.ORACLE_SQL,
}
