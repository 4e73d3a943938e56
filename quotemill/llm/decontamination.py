"""Benchmark passages in documents: SimHash windows of item size, then exact similarity.

Texts are lower-cased; ASCII punctuation and white space separate words. A window of as many words as an
item has gets a 64-bit SimHash of its word shingles. The items' fingerprints stand in a multi-index over the
eight bytes of a fingerprint: if two differ in at most ``RADIUS`` bits, some byte differs in at most
``RADIUS // 8``, so looking up each byte with all its variants up to that distance finds every item within the
radius. A candidate counts if the weighted Jaccard similarity of window and item (shingles with their
counts) is ``SIMILAR`` or more.

A window that has no shingle in common with any item has similarity zero to all of them. So windows are
made only where a shingle of the document is a shingle of an item, aligned to the place it has in that item.

Items are matched in pieces of at most ``PIECE_WORDS`` words; a piece is what an executor holds at a time, and a
larger benchmark takes more passes. No window and no item is left out.

* null or empty text and items without words: no match; an item shorter than a shingle is one shingle;
* repeated rows and several rows of one ``doc_id``: matched each; * ties of the best window: the first; * very
long text: its words as one array of numbers; * empty tables: empty result, nothing filtered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import filter_batches, map_batches

WIDTH = 5
SIMILAR = 0.8
RADIUS = 20
PIECE_WORDS = 2_000_000
PUNCTUATION = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(PUNCTUATION).split() if text else []


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of a sequence of word numbers."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ ids[k : len(ids) - width + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) ^ out >> np.uint64(32)


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared counts over the larger counts."""
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class Index:
    """Items by shingle and by the bytes of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similar: float = SIMILAR):
        self.radius, self.similar = radius, similar
        cut = [(item, found) for item, text in items if (found := words(text))]
        # number 0 is any word that no item has
        self.numbers = {w: i + 1 for i, w in enumerate(sorted({w for _, found in cut for w in found}))}
        self.items, self.prints, seeds = [], [], {}
        self.blocks: list[dict[int, list[int]]] = [{} for _ in range(8)]
        near = [[v for v in range(256) if (v ^ u).bit_count() <= radius // 8] for u in range(256)]
        for place, (item, found) in enumerate(cut):
            ids = np.array([self.numbers[w] for w in found])
            width = min(WIDTH, len(ids))
            hashes = shingle_hashes(ids, width)
            self.items.append((item, len(ids), width, Counter(hashes.tolist())))
            self.prints.append(simhash(hashes))
            for block in range(8):
                for value in near[self.prints[-1] >> 8 * block & 255]:
                    self.blocks[block].setdefault(value, []).append(place)
            for offset, h in enumerate(hashes.tolist()):
                seeds.setdefault((width, h), set()).add((len(ids), offset))
        self.seeds = seeds
        self.seen = {w: np.array(sorted(h for v, h in seeds if v == w), np.uint64) for w in {w for w, _ in seeds}}

    def candidates(self, mark: int) -> Iterator[int]:
        """Items whose fingerprint is within the radius."""
        found = set()
        for block in range(8):
            found.update(self.blocks[block].get(mark >> 8 * block & 255, ()))
        return (place for place in sorted(found) if (self.prints[place] ^ mark).bit_count() <= self.radius)

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)`` of the best window for each item found."""
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        best: dict[int, tuple[float, int, int]] = {}
        for width, known in self.seen.items():
            hashes = shingle_hashes(ids, width)
            if width == 1:
                clean = ids > 0
            else:
                strange = np.concatenate(([0], np.cumsum(ids == 0)))
                clean = strange[width:] == strange[: len(strange) - width] if len(ids) >= width else np.zeros(0, bool)
            spots = np.flatnonzero(clean)
            at = np.searchsorted(known, hashes[spots])
            spots = spots[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes[spots])]
            windows = {(s - o, n) for s in spots.tolist() for n, o in self.seeds[width, int(hashes[s])]}
            # a passage cut off by an end of the text: the part of its window inside the text
            for start, n in sorted(windows):
                low, high = max(0, start), min(len(ids), start + n)
                inside = hashes[low : high - width + 1]
                counts = None
                for place in self.candidates(simhash(inside)):
                    item, size, item_width, own = self.items[place]
                    if size != n or item_width != width:
                        continue
                    counts = counts or Counter(inside.tolist())
                    alike = similarity(counts, own)
                    if alike >= self.similar and (item not in best or alike > best[item][0]):
                        best[item] = (alike, low, high - low)
        return [(item, start, n, alike) for item, (alike, start, n) in sorted(best.items())]


def pieces(benchmark: DataFrame, most_words: int = PIECE_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in pieces of a bounded number of words, one piece at a time."""
    piece, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        piece.append((row[0], row[1]))
        size += len((row[1] or "").split()) + 1
        if size >= most_words:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def matches(docs: DataFrame, benchmark: DataFrame, most_words: int = PIECE_WORDS) -> DataFrame:
    """``(doc_id, item_id, start, n_words, similarity)``: the best window for each document and item."""
    found = None
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"
    source = docs.select(F.col("doc_id").cast("long"), "text")
    for piece in pieces(benchmark, most_words):
        shared = docs.sparkSession.sparkContext.broadcast(piece)

        def setup(shared=shared):
            index = Index(shared.value)

            def work(ids, texts):
                rows = [(i, *match) for i, text in zip(ids, texts, strict=True) for match in index.matches(text)]
                return list(zip(*rows, strict=True)) or [[]] * 5

            return work

        part = map_batches(source, setup, schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, most_words: int = PIECE_WORDS) -> DataFrame:
    """Whole rows of the documents that hold no item."""
    for piece in pieces(benchmark, most_words):
        shared = docs.sparkSession.sparkContext.broadcast(piece)

        def setup(shared=shared):
            index = Index(shared.value)
            return lambda texts: [not index.matches(text) for text in texts]

        docs = filter_batches(docs, "text", setup)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)
