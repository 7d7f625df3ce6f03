"""The queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard, language, mixing, oracle, packing, pages, quality, sharding, tokencounts, wavelet
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), added=True)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest(table(spark, sf_dir, "documents"), added=True)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counts(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tenth operator: bands joined, similarity verified; doc_id and the smallest doc_id that links reach."""
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"op1_main_text": op1_main_text, "op2_language": op2_language, "op3_packing": op3_packing, "op4_sharding": op4_sharding, "op5_wavelet": op5_wavelet, "op6_mixing": op6_mixing, "op7_token_counts": op7_token_counts, "op8_quality": op8_quality, "op9_jaccard": op9_jaccard, "op10_fingerprints": op10_fingerprints, "fingerprint_groups": fingerprint_groups}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; models, numpy hashes, tokenizers and page structure are held against brute force in the tests."""
    return {"op4_sharding": oracle.OP4, "op6_mixing": oracle.OP6, "op8_quality": oracle.OP8, "op9_jaccard": oracle.OP9}
