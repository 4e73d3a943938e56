"""Near-duplicates, decontamination, classifier, extraction and repeats against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from quotemill.llm import decontamination, html_extraction, quality_classifier, queries, simhash_dedup, suffix_dedup
from quotemill.llm.common import connected_components, read_table


def slow_fingerprint(text, width=3):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = raw.split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius), strict=True):
        i, j = sorted((root(int(i)), root(int(j))), key=lambda k: ids[k])
        parent[j] = i
    return [ids[root(i)] for i in range(len(ids))]


def test_simhash_groups(spark, small):
    docs = read_table(spark, small, "documents").collect()
    ids = [d["doc_id"] for d in docs]
    prints = [slow_fingerprint(d["text"]) for d in docs]
    expected = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, groups(ids, prints), strict=True)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op5_simhash_dedup"](spark, small).collect()}
    assert found == expected


def test_shingle_hash_is_the_same_in_spark(spark):
    value = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert simhash_dedup.signed(xxhash.xxh64_intdigest(b"a b c", 42)) == value


def test_links_of_dense_fingerprints_in_many_tiles(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for base in list(prints)[:12]:
        for _ in range(60):
            value = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    fps = spark.createDataFrame([(simhash_dedup.signed(p),) for p in prints], "fp long")
    edges = simhash_dedup.links(fps, 3, tile=16).collect()
    assert len(edges) < 20 * len(prints)
    merged = {p: p for p in prints}

    def root(x):
        while merged[x] != x:
            x = merged[x]
        return x

    for u, v in ((u % (1 << 64), v % (1 << 64)) for u, v in edges):
        assert (u ^ v).bit_count() <= 3
        a, b = sorted((root(u), root(v)))
        merged[b] = a
    assert [root(p) for p in prints] == groups(prints, prints)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1100)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 7 for k in (7, *range(1000, 1100)))


def test_one_row_of_each_group_stays(spark, small):
    docs = read_table(spark, small, "documents")
    doubled = docs.unionAll(docs.limit(5))
    firsts = {r["component_id"] for r in simhash_dedup.query(docs).collect()}
    kept = simhash_dedup.keep_one(doubled)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(firsts)


def shingles(words):
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def test_edited_passages_against_every_window(spark, small):
    items = [(r["item_id"], r["text"]) for r in read_table(spark, small, "benchmark").collect()]
    index = decontamination.Index(items)
    rng = random.Random(5)
    hits = 0
    for k in range(150):
        item, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            j = rng.randrange(len(words))
            words[j : j + 1] = rng.choice([["zz"], [], [words[j], "qq"], [words[j] + "!!"], [words[j].upper()]])
        text_around = " ".join([f"pre{x}" for x in range(9)] + words + [f"post{x}" for x in range(9)])
        doc, own = decontamination.words(text_around), decontamination.words(text)
        best = max(
            decontamination.similarity(shingles(doc[s : s + len(own)]), shingles(own)) for s in range(len(doc) - len(own) + 1)
        )
        found = [m for m in index.matches(text_around) if m[0] == item]
        assert bool(found) == (best >= 0.8)
        if found:
            hits += 1
            assert abs(found[0][3] - best) < 1e-9
    assert hits > 50


def test_fingerprints_within_the_radius_are_candidates():
    index = decontamination.Index([(1, "one two three four five six seven eight nine ten eleven")])
    rng = random.Random(2)
    for _ in range(300):
        mark = index.prints[0]
        for bit in rng.sample(range(64), decontamination.RADIUS):
            mark ^= 1 << bit
        assert list(index.candidates(mark)) == [0]


def test_pieces_of_a_large_benchmark_find_the_same(spark, small):
    docs, items = read_table(spark, small, "documents"), read_table(spark, small, "benchmark")
    whole = sorted(decontamination.matches(docs, items).collect())
    assert whole and whole == sorted(decontamination.matches(docs, items, most_words=2000).collect())
    dirty = {r[0] for r in whole}
    assert {r["doc_id"] for r in decontamination.clean(docs, items, most_words=2000).collect()} == {
        r["doc_id"] for r in docs.collect()
    } - dirty
    exact = [r["doc_id"] for r in docs.collect() if any(i["text"] in r["text"] for i in items.collect())]
    assert set(exact) <= dirty


def test_classifier_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op7_quality_classifier"](spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id").toPandas()
    rest = scored[scored.held_out]
    assert len(rest) > 50 and ((rest.predicted == 1) == (rest.quality == 1)).mean() > 0.95
    assert ((scored.score >= 0) & (scored.score <= 1) & ((scored.score >= 0.7) == (scored.predicted == 1))).all()


def test_classifier_is_the_same_twice_and_reads_text_only(spark, small):
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    one = sorted(quality_classifier.query(docs, labels).collect())
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source", "n_chars").repartition(3)
    assert one == sorted(quality_classifier.query(other, labels).collect())


def test_classifier_without_labels(spark, small):
    docs, labels = read_table(spark, small, "documents"), read_table(spark, small, "labels")
    assert {r["score"] for r in quality_classifier.query(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_classifier.query(docs, labels.filter("quality = 1")).collect()} == {1.0}


def test_word_vectors_against_neighbours_one_by_one(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "bb", "Cc", "dd", "!", "once"] + [f"u{i}"]) for _ in range(rng.randint(0, 60))) for i in range(40)]
    texts.append("aa bb " * 300)
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    known = quality_classifier.common_words(table)
    counts = Counter(t.lower() for text in texts for t in quality_classifier.tokens(text))
    assert known == {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= quality_classifier.LEAST))}
    index = {w: np.zeros(quality_classifier.SIZE) for w in known}
    for w, places, signs in zip(index, *quality_classifier.index_places(list(known)), strict=True):
        for place, sign in zip(places, signs, strict=True):
            index[w][place] += sign
    expected = {w: v.copy() for w, v in index.items()}
    for text in texts:
        row = [t.lower() for t in quality_classifier.tokens(text)]
        for i, w in enumerate(row):
            for j in range(max(0, i - quality_classifier.WINDOW), min(len(row), i + quality_classifier.WINDOW + 1)):
                if j != i and w in known and row[j] in known:
                    expected[w] += index[row[j]]
    found = quality_classifier.word_vectors(table, known)
    for w, i in known.items():
        assert np.allclose(found[i], expected[w] / max(np.linalg.norm(expected[w]), 1e-12), atol=1e-6)


def test_classifier_learns_from_whole_texts_and_one_text_of_an_id(spark):
    filler = " ".join(f"f{i % 50}" for i in range(3000))
    rows = [(i, f"{filler} {'good' if i % 2 else 'bad'} end") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, (1, "another text"), (1, rows[1][1])], "doc_id long, text string")
    drawn = {r["doc_id"]: r["text"] for r in quality_classifier.sample(docs, labels, 4000).collect()}
    assert drawn[1] == "another text" and all(drawn[i] == text for i, text in rows if i in drawn and i != 1)
    scored = quality_classifier.query(docs.filter("text <> 'another text'"), labels).toPandas()
    assert ((scored.score >= 0.5) == (scored.doc_id % 2 == 1)).mean() > 0.95


def page(n, body, title="T"):
    return (
        f"<html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body>"
        f"<header>Site {n}</header><nav><ul><li><a href=/x>Home</a><li><a>Link {n}</a></ul></nav>{body}"
        f"<footer>&copy; us {n}</footer></body></html>"
    )


def test_extraction_by_markup(spark):
    body = (
        "<div class='ad big'>buy</div><!-- <p>hidden</p> --><main><article><header><h1>A &amp; B</h1></header>"
        "<p>One <b>bo</b>ld,<br>two.<p>Three\n  four&nbsp;five <a href=x>link</a> end<div class=share>share it</div>"
        "<form>name <input></form><aside>see also</aside></article>"
        "<section id=comments><article>a reader says</article></section></main>"
    )
    pages = spark.createDataFrame([(1, "http://h.example/1", page(1, body)), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract(pages).collect()}
    text = "A & B One bold, two. Three four five link end"
    assert found == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}


def test_constant_slots_are_template_and_varying_ones_content(spark):
    rows = []
    for n in range(30):
        paragraphs = "".join(f"<p>text {n} part {k}</p>" for k in range(n % 4 + 1))
        rows.append((n, "http://h.example/a", f"<body><div>Welcome to us</div><div>{paragraphs}</div><div>Call our office</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for row in html_extraction.extract(pages).collect():
        n = row["page_id"]
        assert row["text"] == " ".join(f"text {n} part {k}" for k in range(n % 4 + 1))


def test_copies_do_not_make_an_article_template(spark):
    rows = [(n, f"http://h.example/{n}", page(n, "<article><h1>Same</h1><p>same words</p></article>")) for n in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_extraction.extract(pages).collect()} == {"Same same words"}


def test_extraction_of_the_given_pages(spark, small):
    import html
    import re

    def plain(source):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = (html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", inner))
        return " ".join(x for x in (" ".join(p.split()) for p in parts) if x)

    expected = {r["page_id"]: plain(r["html"]) for r in read_table(spark, small, "pages").collect()}
    assert {r["page_id"]: r["text"] for r in queries.QUERIES["op9_html_extraction"](spark, small).collect()} == expected


def test_tree_matching_against_all_pairings():
    def tree(rng, depth):
        node = html_extraction.Node("d", rng.choice("xy"), 1)
        if depth == 0 or rng.random() < 0.4:
            node.kids, node.text = None, rng.choice("ab")
        else:
            node.kids = [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return node

    def best(a, b):
        if a.key != b.key or (a.kids is None) != (b.kids is None):
            return 0
        if a.kids is None:
            return 1 + (a.text == b.text)
        return 1 + lists(a.kids, b.kids)

    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), (w + lists(x[1:], y[1:])) if (w := best(x[0], y[0])) else 0)

    rng = random.Random(4)
    for _ in range(200):
        a, b = tree(rng, 3), tree(rng, 3)
        assert html_extraction.weight(a, b, {}) == best(a, b)


def test_long_sibling_lists_are_aligned_in_order():
    make = lambda texts: html_extraction.parse("<body>" + "".join(f"<p>{t}</p>" for t in texts))
    a, b = make([f"a{i}" for i in range(300)] + ["end"]), make([f"b{i}" for i in range(400)] + ["end", "more"])
    found = {}
    html_extraction.align(a[0], b[0], {}, found)
    assert found[400].text == "end" and len(found) >= 300


def windows(docs):
    where, words = defaultdict(set), {}
    for name, text in docs:
        words[name] = (text or "").encode().split()
        for s in range(len(words[name]) - 49):
            where[tuple(words[name][s : s + 50])].add(name)
    return where, words


def test_repeats_against_every_window(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, small, "documents").collect()]
    where, words = windows(docs)
    covered = defaultdict(set)
    for row in queries.QUERIES["op10_suffix_dedup"](spark, small).collect():
        for s in range(row["start"], row["start"] + row["n_words"] - 49):
            assert row["other_id"] in where[tuple(words[row["doc_id"]][s : s + 50])] - {row["doc_id"]}
            covered[row["doc_id"]].add(s)
    expected = {
        name: {s for s in range(len(found) - 49) if len(where[tuple(found[s : s + 50])]) > 1} for name, found in words.items()
    }
    assert dict(covered) == {name: starts for name, starts in expected.items() if starts}


def test_hot_passage_at_different_places(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(55)]
    rows = []
    for n in range(300):
        own = [word() for _ in range(rng.randint(0, 60))]
        rows.append((n, " ".join([*own, *(shared if n % 3 == 0 else []), *[word() for _ in range(20)]])))
    found = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(0, 300, 3)) and {r["n_words"] for r in found} == {55}
    cut = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(" ".join(shared) in r["text"] for r in cut.collect()) == 1


def test_copies_that_share_a_passage_with_other_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, tail = [word() for _ in range(60)], [word() for _ in range(30)]
    texts = {2: [*[word() for _ in range(10)], *shared], 5: [*shared, *tail], 7: [*shared, *tail], 9: [*shared, word()]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = suffix_dedup.repeats(docs)
    rows = {tuple(r) for r in found.collect()}
    assert {(5, 0, 90, 7), (7, 0, 90, 5), (5, 0, 60, 2)} <= rows
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_repeats(docs, found).collect()}
    assert cut[2] == " ".join(texts[2]) and cut[5] == " ".join(tail) and cut[7] == "" and cut[9] == texts[9][-1]


def test_pages_without_the_constant_paragraph_lose_nothing(spark):
    rows, expected = [], {}
    for n in range(40):
        own = [f"paragraph {k} of page {n} tells its own story" for k in range(3 if n % 13 == 5 else 5)]
        tail = [] if n % 13 == 5 else ["All of this is under the free licence of the archive"]
        body = "".join(f"<p>{p}</p>" for p in [*own, *tail])
        rows.append((n, f"http://h.example/{n}", f"<html><body><article>{body}</article></body></html>"))
        expected[n] = " ".join(own)
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == expected
