"""Corpus pipeline over the table documents: each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, knn, mixing, samples, simhash, suffix
from quillon.llm._common import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of the labelled ones, does not reject."""
    labelled = samples.labelled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality", knn.BOUND)
    return knn.accepted(docs, knn.fit(labelled))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more); candidates by SimHash and Golay keys, and by rare shingles."""
    return simhash.deduplicated(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes or more that occur elsewhere too."""
    return suffix.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by shard, in the shard's order."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of them and of the text decoded from them."""
    return bpe.coded(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]

#: The stages learn a model, rank strings and encode by BPE, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
