"""Queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, bpe, collocations, exact_dedup, fim, langid, lm, mixing, ngram_join, oracles, packing, sharding, suffix_dedup, token_files
from .common import read

END_ID = 2
TREE = sharding.even_tree(4, 2, 2)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.covered(suffix_dedup.matches(read(spark, sf_dir, "documents")))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read(spark, sf_dir, "documents"), TREE)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_back(token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID))


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to a precision that the order of summing can't change."""
    scored = lm.score(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(read(spark, sf_dir, "documents"), 4, 85, 100)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents")).drop("__rid")


def op10_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_bpe_codec": op3_bpe_codec,
        "op4_hash_tree_shards": op4_hash_tree_shards,
        "op5_language_id": op5_language_id,
        "op6_token_files": op6_token_files,
        "op7_backoff_scores": op7_backoff_scores,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_ivf_pq": op10_ivf_pq,
        "op11_collocations": op11_collocations,
        "op12_harmonic_packing": op12_harmonic_packing,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
