"""One query per operator, each over a whole table. The vocabulary files are those of the
installed ``public_tokenizers``; every operator takes their path as a parameter."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table

from . import (
    answers, bpe_roundtrip, centroid_clustering, decision_lists, decontamination, fill_in_middle, grid_order_join, jaccard_join,
    language_codes, packing, prefix_counts, sharding, surrogates, token_files,
)

BYTE_BPE, WORD_BPE, PIECE_BPE = (
    public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip.digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.digest(table(spark, sf_dir, "documents"))


def op6_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_lists.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


def op8_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order_join.digest(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.digest(table(spark, sf_dir, "documents"), PIECE_BPE)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (
        op1_sharding, op2_bpe_roundtrip, op3_surrogates, op4_packing, op5_language_codes, op6_decision_lists, op7_jaccard_join,
        op8_grid_order_join, op9_token_files, op10_prefix_counts, op11_decontamination, op12_fill_in_middle, op13_centroid_clustering,
    )}


def statements() -> dict[str, str]:
    """Of those that SQL can express: token ids, learned models and keyed surrogates have no DuckDB form."""
    return answers.statements()
