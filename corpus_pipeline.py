"""A training-corpus pipeline: language ID, exact dedup, n-gram Jaccard join, source mixing, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again, so a lost executor costs
no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from buildloom.llm import bpe, exact_dedup, langid, mixing, ngram_join
from buildloom.llm.common import cut, drop, read, release, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit no learned language, go."""
    return langid.keep_known(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles, the smallest doc_id stays."""
    return ngram_join.keep_one(docs, 5, 80, 100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by their target weights: documents are repeated or left out."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian 32-bit) of every document of the mix."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", one_of_near_copies),
    ("source_mix", mixed_sources),
    ("bpe_codec", token_ids),
]

#: Language models and tokenisation can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since, before = written(), docs
        docs = cut(stage(spark, before, sf_dir), f"stage-{name}")
        release(since, docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
