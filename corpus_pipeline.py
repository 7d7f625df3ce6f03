"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality rules and language identification drop documents, the Jaccard join keeps one of each group of
near copies, mixing repeats and cuts documents to the sources' weights, and packing returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import common, jaccard, language, mixing, packing, quality

#: A document's language is taken for known if so much of its letters is in spans of it.
LEAST_SCORE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose votes make good text likelier than bad; null and empty texts go."""
    return quality.filter_docs(docs)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and has at least LEAST_SCORE of their letters; scripts that no label showed give no score."""
    return language.filter_docs(docs, LEAST_SCORE)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 over five-word shingles join, the one with the smallest doc_id."""
    return jaccard.distinct_docs(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in its order, each as often as it is taken; the last of a source may be cut."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, a row each; documents that the mix repeats are packed each time."""
    return packing.digest(docs, added=True)


STAGES = [("quality rules", keep_good), ("language", keep_known_language), ("near copies", keep_distinct), ("mixing", mix), ("packing", pack)]
#: Models, hashes in numpy and a tokenizer decide; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, with Parquet in the shared folder between them.

    A stage's table is deleted when the next one is written; the last, which the result reads, stays
    until the shared folder is cleared. An empty table gives an empty result.
    """
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                common.remove(spark, f"{folder}/{k - 1}")
    return docs
