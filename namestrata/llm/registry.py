"""The queries of these operators over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from namestrata.llm import (
    combination_packing,
    compression_bands,
    flow_resharding,
    fuzzy_simhash,
    graph_search,
    language_id,
    prefix_counts,
    quadratic_quality,
    rank_codec,
    ranked_search,
    spelling_variants,
    substring_dedup,
    suffix_tree_lm,
)
from namestrata.llm.batches import documents


def op1_substring_dedup(spark, sf_dir):
    """Words covered by 13-word windows that a smaller document holds."""
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    """Language of every whole text, learned from two folds of three."""
    return language_id.identify(documents(spark, sf_dir))


def op3_graph_search(spark, sf_dir):
    """The 20 nearest of every twentieth vector."""
    return graph_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_flow_resharding(spark, sf_dir):
    """All documents into 24 shards of near equal bytes."""
    return flow_resharding.reshard(documents(spark, sf_dir))


def op5_rank_codec(spark, sf_dir):
    """Ids and round trip of every whole text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return rank_codec.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op6_prefix_counts(spark, sf_dir):
    """Tokens of every whole text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return prefix_counts.count_tokens(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op7_combination_packing(spark, sf_dir):
    """All documents in windows of 2048 tokens."""
    return combination_packing.pack(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


def op8_suffix_tree_lm(spark, sf_dir):
    """Base and tree score of every whole text, learned from four folds of five."""
    return suffix_tree_lm.score(documents(spark, sf_dir))


def op9_compression_bands(spark, sf_dir):
    """Quality verdict on every whole text."""
    return compression_bands.quality(documents(spark, sf_dir))


def op10_fuzzy_simhash(spark, sf_dir):
    """Components of fingerprints within four bits."""
    return fuzzy_simhash.near_duplicates(documents(spark, sf_dir))


def op11_spelling_variants(spark, sf_dir):
    """Words of all texts with their near words, forms and roots."""
    return spelling_variants.variants(documents(spark, sf_dir))


def op12_quadratic_quality(spark, sf_dir):
    """Quality score of every whole text, learned from four folds of five."""
    return quadratic_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_graph_search,
        op4_flow_resharding,
        op5_rank_codec,
        op6_prefix_counts,
        op7_combination_packing,
        op8_suffix_tree_lm,
        op9_compression_bands,
        op10_fuzzy_simhash,
        op11_spelling_variants,
        op12_quadratic_quality,
        op13_ranked_search,
        pipeline,
    )
}
#: The others cannot be stated in SQL; tests compare them with brute force and the libraries.
ORACLES: dict[str, str] = {
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
