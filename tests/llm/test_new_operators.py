"""Tokenizer alignment, collocations and toxicity against brute force, SQL and held-out labels."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quotemill.llm import collocations, cross_tokenizer, queries, toxicity
from quotemill.llm.common import read_table
from tests.compare import compare, connect

ODD = [
    None,
    "",
    " ",
    "  two  blanks ",
    "plain words here, and here.\nA line\n\n  more",
    "a mark ▁ inside",
    "<s> </s> <|endoftext|> <unk> <0x41>",
    "\x00 é 🙂 ﬀ 漢字 \t x",
    "x" * 3000,
    " ".join(f"w{i % 97}" for i in range(5000)),
]


# ------------------------------------------------------------- operator 11


def slow_alignment(texts: list[str | None], spec_path: str, model_path: str) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    a_tokenizer = Tokenizer.from_file(spec_path)
    a_tokenizer.encode_special_tokens = True
    b_tokenizer = sentencepiece.SentencePieceProcessor(model_file=model_path)
    signs = cross_tokenizer.byte_of_sign()
    a_table = {i: bytes(signs[c] for c in p) if all(c in signs for c in p) else p.encode() for p, i in a_tokenizer.get_vocab().items()}

    def b_bytes(i):
        piece = b_tokenizer.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tokenizer.is_byte(i) else piece.replace("▁", " ").encode()

    made, count = [], Counter()
    for text in texts:
        a = a_tokenizer.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tokenizer.encode(text) if text else []
        pieces = [[a_table[i] for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(p) != f" {text}".encode() for p in pieces):
            made.append(None)
            continue
        spans = [[(sum(map(len, p[:0])), 0)] for p in pieces]
        for side, p in zip(spans, pieces, strict=True):
            side.clear()
            at = 0
            for token in p:
                side.append((at, at + len(token)))
                at += len(token)
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, u) in zip(b, spans[1], strict=True) if s < u and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for high in cuts:
            sides = [[i for i, (s, e) in zip(ids, side, strict=True) if low <= s and e <= high] for ids, side in zip((a, b), spans, strict=True)]
            groups.append("|".join(",".join(map(str, x)) for x in sides))
            low = high
        count.update(links)
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if m is None
        else (*m[:3], len(m[3]), sum(count[x] == top[x[1]] for x in m[3]), sum(count[x] for x in m[3]), m[4])
        for m in made
    ]


@pytest.fixture(scope="module")
def vocabularies(spark):
    return queries.tokenizer_path(spark, queries.BYTE_BPE), queries.tokenizer_path(spark, queries.SENTENCE_PIECES)


@pytest.mark.parametrize("block", [500, cross_tokenizer.BLOCK])
def test_alignment_against_all_spans(spark, vocabularies, block):
    given = [r["text"] for r in read_table(spark, "/root/testdata/sf0.001", "documents").orderBy("n_chars").limit(40).collect()]
    texts = [*(t for t in ODD if t is None or len(t) < 4000), *given, *given[:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with open(vocabularies[0], encoding="utf-8") as spec, open(vocabularies[1], "rb") as raw:
        rows = cross_tokenizer.align(docs, spec.read(), raw.read(), block).collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert found == dict(enumerate(slow_alignment(texts, *vocabularies)))


def test_alignment_of_a_hot_text_and_a_missing_id(spark, vocabularies):
    rows = [(None, "same words again")] * 500 + [(7, "other words")]
    found = cross_tokenizer.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), *vocabularies).collect()
    expected = slow_alignment([t for _, t in rows], *vocabularies)
    assert sorted(tuple(r)[1:] for r in found) == sorted(expected)


def test_windows_that_differ_align_nothing(vocabularies):
    with open(vocabularies[0], encoding="utf-8") as spec, open(vocabularies[1], "rb") as raw:
        aligner = cross_tokenizer.Aligner(spec.read(), raw.read())
    texts = ["one two", "three two", "two one"]
    plain = [f[:4] for f in aligner.batch(texts)]
    aligner.forget()
    # a piece that spells other bytes of the same number: only texts that hold it have no alignment
    place = np.frombuffer(aligner.b.units.batch(["three"])[0][0], np.uint32)[0]
    aligner.b.table[place] = aligner.b.table[place][:-1] + b"?"
    changed = aligner.batch(texts)
    assert changed[1] is None and [f[:4] for f in changed[::2]] == plain[::2]


# ------------------------------------------------------------- operator 12


def test_collocations_against_sql(spark, small):
    n, expected, extra, missing = compare(
        queries.QUERIES["op12_collocations"](spark, small), connect(small), queries.ORACLES["op12_collocations"]
    )
    assert n == expected > 0 and not extra and not missing


def slow_phrases(rows, least, top, inside):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            covered = any(
                100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
                if len(q) > len(p)
            )
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not covered:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def test_collocations_against_counting(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "ü", "zé", "the", "x y", "'s"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words) + rng.choice(["", "", ",", "\t", "\r", "."]) for _ in range(40))) for _ in range(90)]
    rows += [("en", None), ("fr", ""), ("en", " . \n,"), ("en", "New York City " * 300), (None, "alone")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = sorted(tuple(r) for r in collocations.mine(docs, least=3, top=25).collect())
    assert found == slow_phrases(rows, 3, 25, collocations.INSIDE)


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 32])
@pytest.mark.parametrize("width", [1, 2])
def test_filters_are_lossless(bits, width):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, (2 * width, 3000)).astype(np.uint64)
    ids = np.concatenate((ids, ids[:, :1000], np.repeat(ids[:, :1], 400, axis=1)), axis=1)
    layout = collocations.Layout(bits, width, 4)
    filtered = collocations.summed(*layout.pack(ids), np.ones(ids.shape[1], np.int64), layout.half)
    rows = list(layout.write(*filtered))
    upper, lower, n = (np.concatenate(x) for x in zip(*(layout.read(*r) for r in rows), strict=True))
    found = {tuple(map(int, p)): int(c) for p, c in zip(np.array(layout.unpack(upper, lower)).T, n, strict=True)}
    whole = np.concatenate((ids, np.zeros((4 - 2 * width, ids.shape[1]), np.uint64)))
    assert found == Counter(tuple(map(int, p)) for p in whole.T)
    assert max(n) >= 400 and len(rows) == len({r[0] for r in rows})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9])
def test_phrases_of_short_sequences(n):
    ids = np.arange(1, n + 1, dtype=np.uint64)
    every = np.full(1 << collocations.MAP - 3, 255, np.uint8)
    assert collocations.phrases_of(ids, 1).shape == (2, max(0, n - 1))
    assert collocations.phrases_of(ids, 2, every).shape == (4, max(0, n - 2) + max(0, n - 3))
    assert collocations.phrases_of(ids, 2, every * 0).shape == (4, 0)


def test_products_beyond_64_bits(spark):
    big = 1 << 61
    phrases = spark.createDataFrame([(1, 2, 0, 0, big), (1, 2, 3, 0, big // 5 * 4)], collocations.PHRASES)
    words = spark.createDataFrame([("en", w, big + 1, i) for i, w in enumerate("abc", 1)], "lang string, word string, f long, id long")
    rows = {tuple(r)[:4]: tuple(r)[4:] for r in collocations.scored(phrases, words).filter("w3 = 0").collect()}
    assert rows == {(1, 2, 0, 0): (big, big + 1, big + 1, 2_000_000 * big // (2 * big + 2))}
    assert [tuple(r)[:4] for r in collocations.outlying(phrases).orderBy("w3").collect()] == [(1, 2, 0, 0), (1, 2, 3, 0)]


# ------------------------------------------------------------- operator 13


def swaps_distance(a: str, b: str) -> int:
    """Edits, a swap of neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i] + [0] * len(b))
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def variant(rng: random.Random, word: str, edits: int) -> str:
    letters = list(word)
    for _ in range(edits):
        kind, at = rng.randrange(4), rng.randrange(len(letters))
        if kind == 0:
            letters[at] = rng.choice("abxyz1")
        elif kind == 1:
            letters.insert(at, rng.choice("abxyz1"))
        elif kind == 2 and len(letters) > 2:
            del letters[at]
        elif at + 1 < len(letters):
            letters[at : at + 2] = letters[at : at + 2][::-1]
    return "".join(letters)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_against_distances(edits):
    rng = random.Random(edits)
    terms = ["scum", "idiot", "idiots", "trash", "worthless", "moron", "ab", "zébu"]
    root = toxicity.trie([(t, False, 1.0) for t in terms] + [("wort", True, 1.0)])
    for _ in range(1500):
        word = variant(rng, rng.choice(terms), rng.randrange(4))
        expected = {(t, swaps_distance(t, word)) for t in terms}
        expected = {(t, d) for t, d in expected if d <= (edits if len(t) >= toxicity.FUZZY else 0)}
        found = toxicity.matches(root, word, edits)
        assert {(t, e) for t, stem, e in found if not stem} == expected, word
        assert any(stem for _, stem, _ in found) == word.startswith("wort")


def test_gate_lets_every_single_edit_through():
    rng = random.Random(9)
    terms = ["loser", "idiots", "clownery", "disgusting", "scum"]
    lexicon = toxicity.Lexicon([(t, False, 2.0) for t in terms])
    for _ in range(3000):
        word = variant(rng, rng.choice(terms), 1)
        least = min(swaps_distance(t, word) if len(t) >= toxicity.FUZZY else 9 * (t != word) for t in terms)
        found = lexicon.look_up(word)
        assert (found[0][2] if found else None) == (least if least <= 1 else None), word
    assert toxicity.Lexicon([("loser", False, 2.0)], frozenset({"lower"})).look_up("lower") == []
    assert lexicon.look_up("l" * 1_000_000) == []


def test_quoted_hits_are_set_apart():
    lexicon = toxicity.Lexicon([("idiot", False, 3.0)])
    abuse = toxicity.features("you are an idiot and an idoit", lexicon)
    quoted = toxicity.features('he said "you are an idiot" and left\nno quote', lexicon)
    french = toxicity.features("il a dit « idiot » hier", lexicon)
    left_open = toxicity.features('a " mark\nyou idiot', lexicon)
    assert abuse[0] > 0 and abuse[1] > 0 and abuse[3] == 0
    assert quoted[0] == french[0] == 0 and quoted[3] > 0 and french[3] > 0
    assert left_open[0] > 0 and left_open[3] == 0
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * toxicity.N_FEATURES


def test_toxicity_learns_quotation_and_misspelling(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        kind = i % 6
        if kind == 0:
            words[rng.randrange(30)] = rng.choice(["grobbler", "wuzzock"])
        elif kind == 1:
            at = rng.randrange(28)
            words[at : at + 3] = ["“quoted", rng.choice(["grobbler", "wuzzock"]), "there”"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 0)))
    rows += [(10_000, "you grobblerr now"), (10_001, "you wuzozck now"), (10_002, "nothing here"), (None, None), (10_003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r for r in toxicity.query(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    right = [scores[i]["predicted"] == y for i, y in labels if scores[i]["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert scores[10_000]["score"] > scores[10_002]["score"] < scores[10_001]["score"]
    assert scores[None]["score"] == scores[10_003]["score"] == scores[10_002]["score"] and not scores[None]["held_out"]


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["toxic"] for r in read_table(spark, folder, "labels").collect()}
    docs = read_table(spark, folder, "documents")
    docs = docs.filter(docs["doc_id"].isin(sorted(marks)[:2500]))
    rows = [r for r in toxicity.query(docs, read_table(spark, folder, "labels")).collect() if r["held_out"]]
    pairs = Counter((marks[r["doc_id"]], r["predicted"]) for r in rows)
    assert pairs[1, 1] / (pairs[1, 0] + pairs[1, 1]) > 0.85 and pairs[0, 0] / (pairs[0, 0] + pairs[0, 1]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels_and_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, "c d"), (3, "other"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (3, 7), (99, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.query(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.query(docs, ones).collect()} == {1.0}
