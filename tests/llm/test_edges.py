"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from quotemill.llm import html_extraction, queries
from quotemill.llm.common import read_table

EXTRA = ["fp", "fingerprint", "component_id", "score", "host", "words", "lines", "chars", "ids", "edits", "h", "won", "won_id"]
EXTRA += ["block", "places", "toxic", "quality", "term", "pair", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in EXTRA)
OPERATORS = [name for name in queries.QUERIES if name != "op9_html_extraction"]


def build(spark, folder, rows, benchmark=True, labels=True):
    given = "/root/testdata/sf0.001"
    spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    for name, whole in (("benchmark", benchmark), ("labels", labels)):
        table = read_table(spark, given, name)
        (table if whole else table.limit(0)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    long_text = " ".join(f"w{i % 7919} the" for i in range(60_000))
    given = [tuple(r)[:5] for r in read_table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    rows = [
        *given,
        *given[:3],
        (9001, None, None, None, None),
        (9002, "", "en", "s", 0),
        (9003, " \n\t ", "en", "s", 4),
        (None, "a row without an id " * 30, "en", "s", None),
        (None, None, None, None, None),
        (9004, long_text, "en", "s", 1),
        (9005, long_text, "en", "s", 1),
        (9006, "\x00 ▁ 🙂  ﬀ x" * 20, "en", "s", 1),
        (-5, "short", "en", "s", 5),
    ]
    return build(spark, tmp_path_factory.mktemp("odd") / "t", rows), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("empty") / "t", [], labels=False)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    folder, rows = odd
    found = queries.QUERIES[name](spark, folder).collect()
    if name == "op12_collocations":
        assert [(r["lang"], r["phrase"], r["a"]) for r in found if r["phrase"].startswith("w7918")] == []
        assert {r["n"] for r in found if r["lang"] == "en"} and all(r["a"] >= 30 for r in found)
    elif name in ("op4_decontamination", "op10_suffix_dedup"):
        assert all(r["doc_id"] not in (9001, 9002, 9003) for r in found)
    else:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in rows)
    by_id = {} if name == "op12_collocations" else {r["doc_id"]: r for r in found}
    if name == "op1_quality_rules":
        assert by_id[9001]["n_words"] == by_id[9002]["n_words"] == by_id[9003]["n_words"] == 0 and by_id[9001]["base_failed"]
        assert by_id[9004]["n_words"] == 120_000
    if name == "op5_simhash_dedup":
        assert {by_id[k]["fingerprint"] for k in (9001, 9002, 9003)} == {"0" * 16}
        assert {by_id[k]["component_id"] for k in (9001, 9002, 9003)} == {9001}
        assert by_id[9005]["component_id"] == by_id[9004]["component_id"]
    if name == "op7_quality_classifier":
        assert by_id[9001]["score"] == by_id[9002]["score"] == 0.0 and by_id[9001]["predicted"] == 0
    if name == "op8_token_output":
        assert by_id[9001]["n_tokens"] == by_id[9002]["n_tokens"] == 1
        assert min(r["start"] for r in found) == 0
        assert sum(r["n_tokens"] for r in found) == max(r["start"] + r["n_tokens"] for r in found)
    if name == "op11_cross_tokenizer":
        assert by_id[9001]["n_a"] == by_id[9002]["n_links"] == 0 and by_id[9002]["groups_sha256"] == ""
        assert by_id[9004]["groups_sha256"] == by_id[9005]["groups_sha256"] != ""
    if name == "op13_toxicity":
        assert by_id[9001]["score"] == by_id[9002]["score"] and not by_id[None]["held_out"]
    if name == "op10_suffix_dedup":
        assert {(r["start"], r["n_words"], r["other_id"]) for r in found if r["doc_id"] == 9005} == {(0, 120_000, 9004)}


@pytest.mark.parametrize("name", [*OPERATORS, "pipeline"])
def test_empty_table(spark, empty, name):
    query = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert query(spark, empty).collect() == []


def test_empty_benchmark_and_labels(spark, tmp_path):
    folder = build(spark, tmp_path / "t", [(1, "some words", "en", "s", 1)], benchmark=False, labels=False)
    assert queries.QUERIES["op4_decontamination"](spark, folder).collect() == []
    assert [r["score"] for r in queries.QUERIES["op7_quality_classifier"](spark, folder).collect()] == [0.5]


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string, pivot string")
    assert html_extraction.extract(pages).collect() == []


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "http://a/1", "<p>x y</p>", "h", "p")] * 3 + [(None, None, "<p>z</p>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, pivot string")
    assert sorted(r["text"] for r in html_extraction.extract(pages).collect()) == ["x y", "x y", "x y", "z"]


def test_stages_keep_columns_and_clean_rows(spark, odd):
    folder, _ = odd
    docs = read_table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        assert out.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.filter("not parity").count() == 0


def test_pipeline_against_its_operators(spark, small):
    from quotemill.llm import decontamination, pii, quality_classifier, sentencepiece_codec, simhash_dedup

    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    good = {r["doc_id"] for r in quality_classifier.query(docs, labels).collect() if r["predicted"]}
    kept = docs.filter(docs["doc_id"].isin(sorted(good)))
    first = {r["component_id"] for r in simhash_dedup.query(kept).collect()}
    kept = kept.filter(kept["doc_id"].isin(sorted(first)))
    leaks = {r["doc_id"] for r in decontamination.query(kept, read_table(spark, small, "benchmark")).collect()}
    expected = sorted(first - leaks)
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert sorted(rows) == expected and len(expected) < docs.count()
    with open(queries.tokenizer_path(spark, queries.SENTENCE_PIECES), "rb") as file:
        codec = sentencepiece_codec.Codec(file.read())
    permute = pii.Permuter(pii.key_of(spark))
    for row in docs.filter(docs["doc_id"].isin(expected)).collect():
        assert codec.decode(np.array(rows[row["doc_id"]]["ids"])) == pii.rewrite(row["text"], permute)[0]
