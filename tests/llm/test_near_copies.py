"""The near-duplicate stage: rows decided by their own text, groups against brute force on fingerprints."""

from __future__ import annotations

import random

import corpus_pipeline
from quotemill.llm import simhash_dedup
from quotemill.llm.common import read_table
from tests.llm.test_corpus_operators import groups, slow_fingerprint

SCHEMA = "doc_id long, text string, won_id string, tags map<string, string>"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def test_rows_are_decided_by_their_own_text(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 80)) for _ in range(6)]
    rows = [
        (5, texts[0], "x", {"a": "b"}),
        (None, texts[0], "x", None),  # a copy of document 5
        (None, texts[1], "x", None),
        (None, texts[2], None, {"a": "b"}),
        (7, texts[3], "x", None),  # two texts under one id
        (7, texts[4], "x", None),
        (7, texts[0], "x", None),  # another copy of document 5
        (8, texts[5], "x", None),  # the same row twice
        (8, texts[5], "x", None),
        (8, texts[5], "y", None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(5, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])], key=str)


def first_of_groups(docs: dict) -> list[int]:
    ids = sorted(docs)
    return sorted(set(groups(ids, [slow_fingerprint(docs[i]) for i in ids])))


def test_stage_against_all_pairs_of_fingerprints(spark):
    rng = random.Random(11)
    docs = {}
    for family in range(12):
        base = words(rng, rng.randint(20, 200))
        for n in range(25):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = words(rng, 1)[0]
            docs[family * 100 + n] = " ".join(text)
    docs |= {5000: "", 5001: " \n", 5002: "one two three", 5003: "One two  three", 5004: "one two four", 5005: None}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    expected = first_of_groups(docs)
    assert 12 < len(expected) < len(docs)
    found = corpus_pipeline.near_dedup(spark, table, "")
    assert sorted(r["doc_id"] for r in found.collect()) == expected


def test_stage_on_the_given_documents(spark, small):
    docs = read_table(spark, small, "documents")
    expected = first_of_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == expected
