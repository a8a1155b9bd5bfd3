"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from importflow.llm import jaccard, language, mixing, packing, secrets
from importflow.session import apply_settings, store

MIN_LANGUAGE_SCORE = 0.5    # a document of no language, or of none by at least this, is rejected
NEAR_WORDS = 5              # near duplicates: shingles of five words,
NEAR_PERCENT = 80           # four fifths of all shingles of a pair in common
KEEP_TOKENS = 0.9           # expected share of the tokens that the mix keeps


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the others' labels, and not unlike all of them."""
    apply_settings(spark)
    model = language.learn(docs.where(~language.held_out()), usual=True)
    return language.identify(docs, model, min_score=MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    apply_settings(spark)
    return jaccard.keep_one(docs, shingle=NEAR_WORDS, percent=NEAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    apply_settings(spark)
    return secrets.redact(docs, secrets.learn(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target shares."""
    apply_settings(spark)
    return mixing.sample(docs, keep=KEEP_TOKENS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, neighbours on the curve together."""
    apply_settings(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None   # fitted models, sampling and token ids are beyond SQL; tests hold stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
