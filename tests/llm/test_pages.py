"""Pages that are deep, broken or oddly marked, and texts with very many findings."""

from __future__ import annotations

import random
import re
import time

import pytest

from quotemill.llm import html_extraction as pages
from quotemill.llm import pii

PAGES = "page_id long, url string, html string"


def texts_of(spark, *htmls: str) -> list[str]:
    """Each page on a host of its own, so that markup alone decides."""
    rows = [(n, f"http://h{n}.example/x", html) for n, html in enumerate(htmls)]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()}
    return [found[n] for n in range(len(htmls))]


def test_deep_pages_are_read_and_aligned(spark):
    deep = lambda word: "<div>" * 10_000 + f"<p>{word} one</p><p>two</p>" + "</div>" * 10_000
    layered = lambda word: "".join(f"<div><p>{word}{n}</p>" for n in range(3000))
    rows = [(n, "http://h/x", html) for n, html in enumerate([deep("a"), deep("b"), layered("c"), layered("d")])]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[0] == "a one two" and found[1] == "b one two"
    assert found[3] == " ".join(f"d{n}" for n in range(3000))


def test_deep_trees_match_level_by_level():
    one, other = (pages.parse("".join(f"<div><p>{w}{n}</p>" for n in range(5000)))[0] for w in "ab")
    assert pages.weight(one, one, {}) > pages.weight(one, other, {}) > 5000


@pytest.mark.parametrize(
    "html",
    [
        "<a b" * 250_000,
        "<a b='" * 170_000 + ">",
        "<a \"> \"x' " * 100_000,
        "<!-" * 300_000,
        "</" * 500_000,
        "<span class=ad>" * 70_000 + "x",
        "<p><button><div>" * 60_000,
        "<script" * 150_000,
        "<table><tr><td>" * 60_000 + "x",
    ],
)
def test_broken_pages_take_time_in_proportion(html):
    start = time.process_time()
    pages.parse(html)
    assert time.process_time() - start < 20


def test_tags_as_a_pattern_finds_them():
    """A plain pattern with the same rules, on short strings of markup signs."""
    pattern = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>", re.S)
    rng = random.Random(4)
    for _ in range(20_000):
        html = "".join(rng.choices(["<", ">", "a", "/", '"', "'", " ", "=", "<a ", "<!--", "-->", "x", "!", "</p>"], k=rng.randint(1, 18)))
        wanted = [(m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or "") for m in pattern.finditer(html)]
        assert list(pages.tags(html)) == wanted, html


def test_what_belongs_to_the_article_stays(spark):
    words = "main words of the page " * 5
    teaser = f'<div class="content"><p>{words}</p><p>more</p><article class="card"><p>teaser</p></article></div>'
    inside = (
        f'<nav>menu</nav><article><p>{words}</p><p class="alert">mind this</p><section id="legal"><p>the law</p></section>'
        '<div class="search-results"><p>found</p></div><p class="side-note">aside note</p><p>x <math><mi>y</mi></math> z</p>'
        '<div class="comments"><p>a reader</p></div><div class="ad">buy</div></article><footer>foot</footer>'
    )
    short = f"<main><p>{words}</p></main><div><p>beside</p></div>"
    words = words.strip()
    assert texts_of(spark, teaser, inside, short) == [
        f"{words} more teaser",
        f"{words} mind this the law found aside note x y z",
        words,
    ]


def test_very_many_findings_as_all_pairs_finds_them():
    rng = random.Random(5)
    parts = ["jo@mail.example.com", "4111 1111 1111 1111", "1980-02-29", "192.168.10.1", "+1 (017) 555-7713", "token=a1b2c3d4@x.example", "and"]

    def plain(text):
        found = []
        for kind in pii.KINDS:
            for match in kind.pattern.finditer(text):
                start, stop = match.span(1)
                if kind.valid(match[1]) and not any(start < b and a < stop for a, b, _ in found):
                    found.append((start, stop, kind))
        return sorted(found, key=lambda f: f[0])

    for _ in range(200):
        text = rng.choice([" ", ", ", "="]).join(rng.choices(parts, k=30))
        assert pii.find(text) == plain(text)
    start = time.process_time()
    assert len(pii.find("jo@mail.example.com " * 60_000)) == 60_000
    assert time.process_time() - start < 20
