"""Corpus pipeline: from raw documents to packed training sequences.

Stages run in order, each over all rows that the one before kept, with its result written as Parquet and read
again. All but the last return the columns of `documents`; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, near_dup, packing, quality, quality_rules
from quern.llm.common import load, materialize
from quern.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is at least 0.3. Trusted positives are the labelled good documents; without any,
    every document scores 0.5 and stays. A null or empty text is scored like any other; an empty table stays empty."""
    trusted = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    model = quality.fit(docs, trusted)
    name = "quern_score"
    return quality.score(docs, model, name).where(F.col(name) >= 0.3).drop(name)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rules hold for good. Null and empty texts, and texts of fewer than 10 words, go."""
    return quality_rules.kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the smallest doc_id of each group stays. Rows without an id or without a
    word are groups of their own."""
    return near_dup.deduplicated(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: texts are the words taken, a line per span. Null is a source of its own; a document of
    which nothing is taken goes; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece, with the checksum of its ids. A null or empty text is its end id alone."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("near_dedup", dedup), ("mixing", mixture), ("packing", pack)]

#: The stages fit models and permute blocks, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
