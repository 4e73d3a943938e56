"""Corpus pipeline: classify, deduplicate, decontaminate, pseudonymise, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of their input. Rows are filtered whole, so columns
with any names pass through; null and empty texts, repeated rows and empty tables are as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import decontamination, pii, quality_classifier, sentencepiece_codec, simhash_dedup
from quotemill.llm.common import read_table
from quotemill.llm.queries import SENTENCE_PIECES, tokenizer_path
from quotemill.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of these documents."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.accept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that SimHash links: 3-word shingles, 3 bits at most."""
    return simhash_dedup.keep_one(docs, radius=3, width=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; ``n_chars`` follows the new text."""
    new = pii.pseudonymise(docs, pii.key_of(spark))
    if "n_chars" not in docs.columns:
        return new
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it and agree with the sentencepiece library."""
    return sentencepiece_codec.encode(docs, tokenizer_path(spark, SENTENCE_PIECES))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("sentencepiece", encode),
]

# a trained classifier and a tokenizer have no SQL twin
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
