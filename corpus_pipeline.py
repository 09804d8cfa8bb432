"""From raw documents to training windows: quality, language, near-duplicates, repeats, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns the packed pieces. Null texts and texts of few words
leave with the first stage; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from namestrata.llm import combination_packing, compression_bands, language_id, near_copies, substring_dedup
from namestrata.session import cut_lineage

#: Words whose ids a worker keeps; it keeps them while it runs other stages.
PACKING_WORDS = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words and compressed size pass."""
    return compression_bands.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of copies: five-word shingles, similarity 0.8."""
    return near_copies.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id holds."""
    return substring_dedup.drop_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return combination_packing.pack(docs, path, public_tokenizers.PATTERN, remembered=PACKING_WORDS)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]

#: Compression, fingerprints and tokens cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
