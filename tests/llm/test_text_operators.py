"""Rules, pseudonyms, token counts, token files and SentencePiece against brute force."""

from __future__ import annotations

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quotemill.llm import pii, quality_rules, queries, sentencepiece_codec, token_counts, token_output, units
from quotemill.llm.common import read_table
from tests.compare import compare, connect

BPE = public_tokenizers.path(queries.BYTE_BPE)
PIECES = public_tokenizers.path(queries.SENTENCE_PIECES)
ODD = [
    "", "  ", "a  b", " lead", "trail ", "a\n\nb x", "\x00z", "日本語 テスト 🙂🙂", "it's he'll x'", "a   b c\n d", "\n", "tab\tx  \n y",
    "x y z", "<s> </s> <unk> <0x41>", "<|endoftext|> end", "é é\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = read_table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()
    return [r["text"] for r in rows] + ODD


@pytest.fixture(scope="module")
def bpe():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_rules_agree_with_sql(spark, small):
    found = compare(queries.QUERIES["op1_quality_rules"](spark, small), connect(small), queries.ORACLES["op1_quality_rules"])
    assert found[0] == found[1] > 0 and not found[2] and not found[3]


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_rule_counts_by_hand(spark):
    cases = ["a b c a b c", "x x x x", "one two", "a\x0bb\xa0c d", "same\nsame\n \n\nsame", "p | q #", None, ""]
    rng = random.Random(1)
    cases += [" ".join(rng.choice("ab c d".split()) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for row in quality_rules.judge(docs).collect():
        text = cases[row["doc_id"]] or ""
        words = [w for w in text.replace("\x0b", " ").split(" ") for w in w.split("\n") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_repeat_words"] == brute_repeats(words), text
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert row["base_failed"] and not row["kept"]


def test_permutation_of_every_value():
    permute = pii.Permuter(b"k")
    for left, right in ((2, 5), (10, 100), (1, 7), (16, 16)):
        image = [permute(x, left, right, "t") for x in range(left * right)]
        assert sorted(image) == list(range(left * right))
        assert all(a != b for a, b in enumerate(image))


@pytest.mark.parametrize(
    "value, kind, ok",
    [
        ("4111 1111 1111 1111", "card", lambda t: pii.card_ok(t) and t[4] == " "),
        ("DE89 3704 0044 0532 0130 00", "iban", lambda t: pii.iban_ok(t) and t.startswith("DE")),
        ("123-45-6789", "ssn", pii.ssn_ok),
        ("+1 (017) 555-7713", "phone", lambda t: t.startswith("+1 (") and len(t) == 17),
        ("192.168.10.1", "ip", pii.ip_ok),
        ("1980-02-29", "date", lambda t: pii.date_form(t) == "%Y-%m-%d"),
        ("31.12.1999", "date", lambda t: pii.date_form(t) == "%d.%m.%Y"),
        ("jo.98", "email", lambda t: t[2] == "." and t[3:].isdigit()),
    ],
)
def test_pseudonyms_stay_valid(value, kind, ok):
    permute = pii.Permuter(b"k")
    text = f"see {value}@mail5.example.com." if kind == "email" else f"see {value} now"
    new, found = pii.rewrite(text, permute)
    assert [k.name for _, _, k in found] == [kind] and value not in new
    assert ok(new[4 : len(new) - (len(text) - 4 - len(value))])
    assert pii.rewrite("again " + text, permute)[0] == "again " + new


def test_what_is_not_valid_stays():
    text = "1234567890123456 999.1.1.1 000-12-3456 2023-02-30 v1.2.3.4.5 call 555 a @ b"
    assert pii.rewrite(text, pii.Permuter(b"k")) == (text, [])


def test_case_and_decoration_keep_the_link():
    permute = pii.Permuter(b"k")
    low = pii.rewrite("jo.98@mail5.example.com", permute)[0]
    assert pii.rewrite("JO.98@MAIL5.EXAMPLE.COM!!", permute)[0] == low.upper() + "!!"
    assert pii.rewrite('token = "04dbebab91ab85687d33eeaa"', permute)[0] != 'token = "04dbebab91ab85687d33eeaa"'
    assert pii.rewrite("call +1 (017) 555-7713 141.73.119.60", permute)[1][1][2].name == "ip"


@pytest.mark.parametrize("marks", [False, True])
def test_units_give_the_ids_of_the_whole(texts, bpe, marks):
    with open(BPE, encoding="utf-8") as file:
        encoder = units.byte_bpe(file.read(), marks)
    rng = random.Random(6)
    texts = texts + ["".join(rng.choices(["a", "b1", " ", " ", "\n", ", ", ". ", ",", ".", "'s", "_", ")", "\t", "é", "\xa0"], k=12)) for _ in range(3000)]
    found, _ = encoder.batch(texts)
    assert [np.frombuffer(f, np.uint32).tolist() for f in found] == [bpe(t) for t in texts]


def test_a_full_cache_starts_anew(texts, bpe):
    with open(BPE, encoding="utf-8") as file:
        encoder = units.byte_bpe(file.read())
    encoder.limit = 10
    for text in texts[:20]:
        assert np.frombuffer(encoder.batch([text])[0][0], np.uint32).tolist() == bpe(text)


def test_edits_against_encoding_anew(texts, bpe):
    with open(BPE, encoding="utf-8") as file:
        encoder = units.byte_bpe(file.read())
    rng = random.Random(3)
    put = ["", " ", "  ", "x", "\n", " y", "z ", "'s", "<number>", "é", "Ab cd\n\n ef"]
    for text, args in zip(texts, list(token_counts.counted(encoder, texts)), strict=True):
        chars, ids = token_counts.build(*args)
        assert (chars[1], ids[1]) == (len(text), len(bpe(text)))
        for _ in range(2):  # the second time on the tree that the first one left
            places = [rng.randint(0, len(text)) for _ in range(rng.choice([1, 2, 9]))]
            edits = [{"start": p, "stop": p + rng.choice([0, 1, 5, 90]), "text": rng.choice(put)} for p in places]
            text, n, _, encoded = token_counts.recount(text, chars, ids, edits, lambda t: len(bpe(t)))
            assert n == len(bpe(text)) and chars[1] == len(text) and encoded <= len(text)


def test_one_edit_encodes_little(bpe):
    text = " ".join(f"word{i}" for i in range(5000))
    with open(BPE, encoding="utf-8") as file:
        chars, ids = token_counts.build(*next(token_counts.counted(units.byte_bpe(file.read()), [text])))
    edit = {"start": 20000, "stop": 20003, "text": "zz"}
    after, n, _, encoded = token_counts.recount(text, chars, ids, [edit], lambda t: len(bpe(t)))
    assert n == len(bpe(after)) and encoded < 1000


def test_count_query(spark, small, bpe):
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, small, "documents").collect()}
    for row in queries.QUERIES["op3_token_counts"](spark, small).collect():
        text, out, at = docs[row["doc_id"]], [], 0
        last = 0
        for edit in sorted(token_counts.cleaning_edits(text), key=lambda e: (e["start"], e["stop"])):
            if edit["start"] >= last:
                out += (text[at : edit["start"]], edit["text"])
                at = last = edit["stop"]
        after = "".join(out) + text[at:]
        assert (row["n_tokens"], row["n_tokens_after"]) == (len(bpe(text)), len(bpe(after)))
        assert row["n_chars_after"] == len(after)


@pytest.mark.parametrize("n, m", [(1, 5), (2, 10), (5, 1), (50257, 90000), (300, 70000)])
def test_huffman_round_trip(n, m):
    ids = np.minimum(np.random.default_rng(1).pareto(0.7, m).astype(np.int64), n - 1)
    counts = np.bincount(ids, minlength=n)
    lengths = token_output.code_lengths(counts)
    assert lengths.max() <= token_output.LONGEST and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    codes = token_output.canonical(lengths)
    bits, checkpoints = token_output.pack(ids, lengths, codes)
    table = token_output.decode_table(lengths, codes)
    assert (token_output.unpack(bits, checkpoints, len(ids), table) == ids).all()
    share = counts[counts > 0] / m
    assert len(bits) * 8 <= m * ((share * -np.log2(share)).sum() + 1) + 8


def test_short_limit_is_kept_and_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    lengths = token_output.code_lengths(counts, 4)
    assert lengths.max() == 4 and (2.0 ** -lengths.astype(float)).sum() == 1
    best = min(
        (sum(c * x for c, x in zip(counts, tried, strict=True)))
        for tried in combinations_with_replacement(range(4, 0, -1), 8)
        if sum(2.0**-x for x in tried) <= 1
    )
    assert (counts * lengths).sum() == best


def test_token_files(spark, small, bpe):
    at = 0
    docs = read_table(spark, small, "documents").orderBy("doc_id").collect()
    found = sorted(queries.QUERIES["op8_token_output"](spark, small).collect())
    assert len(docs) == len(found)
    for doc, row in zip(docs, found, strict=True):
        ids = [*bpe(doc["text"]), 0]
        assert tuple(row) == (doc["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sentencepiece_parity(texts):
    with open(PIECES, "rb") as file:
        raw = file.read()
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for threads in (1, 4):
        codec = sentencepiece_codec.Codec(raw, threads)
        for text, (ids, round_trip, parity) in zip(texts, codec.batch(texts), strict=True):
            assert ids.tolist() == reference.encode(text) and round_trip and parity, text


def test_unigram_models_are_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -3.0, 1), ("a", -3.5, 1)]
    model = sentencepiece_codec.Model([p for p, _, _ in pieces], [s for _, s, _ in pieces], [k for _, _, k in pieces])
    tokenizer = sentencepiece_codec.rebuild(model)
    assert tokenizer.encode("ab a", add_special_tokens=False).ids == [3, 1]


def test_sentencepiece_table_decodes(spark, small):
    docs = read_table(spark, small, "documents")
    encoded = sentencepiece_codec.encode(docs, PIECES)
    assert encoded.filter("not round_trip or not parity").count() == 0
    assert sentencepiece_codec.decode(encoded, PIECES).exceptAll(docs.select("doc_id", "text")).count() == 0
