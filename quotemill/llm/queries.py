"""One query per operator over its whole table, and SQL twins where SQL can express the operator."""

from __future__ import annotations

from quotemill.llm import (
    collocations,
    cross_tokenizer,
    decontamination,
    html_extraction,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    token_output,
    toxicity,
)
from quotemill.llm.common import read_table

BYTE_BPE, SENTENCE_PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(spark, name: str) -> str:
    """Folder of the vocabulary files: a session setting, else that of the installed package."""
    folder = spark.conf.get("spark.quotemill.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def over_documents(query):
    return lambda spark, sf_dir: query(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": over_documents(quality_rules.query),
    "op2_pii": over_documents(pii.query),
    "op3_token_counts": lambda spark, sf_dir: token_counts.query(
        read_table(spark, sf_dir, "documents"), tokenizer_path(spark, BYTE_BPE)
    ),
    "op4_decontamination": lambda spark, sf_dir: decontamination.query(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    ),
    "op5_simhash_dedup": over_documents(simhash_dedup.query),
    "op6_sentencepiece": lambda spark, sf_dir: sentencepiece_codec.query(
        read_table(spark, sf_dir, "documents"), tokenizer_path(spark, SENTENCE_PIECES)
    ),
    "op7_quality_classifier": lambda spark, sf_dir: quality_classifier.query(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ),
    "op8_token_output": lambda spark, sf_dir: token_output.query(
        read_table(spark, sf_dir, "documents"), tokenizer_path(spark, BYTE_BPE)
    ),
    "op9_html_extraction": lambda spark, sf_dir: html_extraction.extract(read_table(spark, sf_dir, "pages")),
    "op10_suffix_dedup": over_documents(suffix_dedup.query),
    "op11_cross_tokenizer": lambda spark, sf_dir: cross_tokenizer.query(
        read_table(spark, sf_dir, "documents"), tokenizer_path(spark, BYTE_BPE), tokenizer_path(spark, SENTENCE_PIECES)
    ),
    "op12_collocations": over_documents(collocations.query),
    "op13_toxicity": lambda spark, sf_dir: toxicity.query(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ),
}

ORACLES = {"op1_quality_rules": quality_rules.oracle(), "op12_collocations": collocations.oracle()}
