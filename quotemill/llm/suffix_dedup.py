"""Passages that repeat across documents, by sparse suffix arrays.

A text is its words, split at ASCII white space. Of all its suffixes only those at minimiser positions are
retained: in every run of ``RUN`` successive word positions the one whose next ``PREFIX`` words have the
smallest hash. The choice depends on the words alone, so any two equal passages of ``LEAST = PREFIX + RUN - 1`` words
retain a suffix at the same place.

1. Retained suffixes are brought together by their first ``PREFIX`` words. A suffix whose class has one document
   only has no equal neighbour and goes.
2. From each suffix that is left the match is extended left and right, over all passages of ``LEAST`` words whose
   minimiser it is. Such passages are brought together by their words, and those in two or more documents
   are repeats.
3. Repeats that follow each other word by word are joined to maximal ones.

A class is never listed in pairs: its smallest and largest ids are enough to name another document for each member.
Grouped minima combine before the shuffle; joins back to members are equi-joins that AQE splits on hot passages.
Exact copies of a text are one representative with members; they are not compared with each other.

* null or empty text, or fewer than ``LEAST`` words: no rows; * a passage that repeats in one document only, also as
repeated rows of one id: none; * a row without ``doc_id`` cannot be named and takes no part; * very long text: arrays of
eight bytes a word in one row; * empty table: empty result; * other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema, map_batches, once_per_worker
from quotemill.session import settle

PREFIX, RUN = 25, 26
LEAST = PREFIX + RUN - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CACHE = 400_000


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64, kept by the worker and made longer on demand."""
    held = once_per_worker(("powers", base), lambda: {"all": np.ones(1, np.uint64)})
    if len(held["all"]) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        held["all"] = np.cumprod(steps)
    return held["all"][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = once_per_worker(("words",), dict)
    if len(known) > CACHE:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word)
    return np.array([known[word] for word in words], np.uint64)


def run_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words from the prefix sums of a polynomial in ``BASE``."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = (sums[width:] - sums[:-width]) * powers(INVERSE, n)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(29)


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)))))


def minimisers(prefixes: np.ndarray) -> np.ndarray:
    """For every ``RUN`` successive hashes the position of the smallest, the first among equals."""
    if len(prefixes) < RUN:
        return np.zeros(0, np.int64)
    picked = []
    for at in range(0, len(prefixes) - RUN + 1, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(prefixes[at : at + (1 << 16) + RUN - 1], RUN)
        picked.append(view.argmin(1) + np.arange(at, at + len(view)))
    return np.concatenate(picked)


def retained(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, d1, d2, hashes, places``: a digest of the words, and the suffixes at minimiser positions."""

    def setup():
        def work(ids, texts):
            out = [[], [], [], [], [], []]
            for name, text in zip(ids, texts, strict=True):
                words = text.split() if text else []
                if len(words) < LEAST:
                    continue
                prefixes = run_hashes(prefix_sums(word_hashes(words)), PREFIX)
                places = np.unique(minimisers(prefixes))
                digest = xxhash.xxh128_digest(b" ".join(words))
                first, second = np.frombuffer(digest, np.int64).tolist()
                row = (name, len(words), first, second, prefixes[places].view(np.int64), places)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    schema = "doc_id long, n_words int, d1 long, d2 long, hashes array<long>, places array<int>"
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_batches(source, setup, schema)


def passages(candidates: DataFrame) -> DataFrame:
    """``(passage, doc_id, start)`` for texts with the ``places`` of suffixes that have neighbours."""
    schema = "passage long, doc_id long, start int"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, raw, spots = (batch.column(k)[row].as_py() for k in range(3))
                sums = prefix_sums(word_hashes(raw.split()))
                # the LEAST words from each start have one minimiser among the suffixes they hold whole
                starts = np.flatnonzero(np.isin(minimisers(run_hashes(sums, PREFIX)), np.array(spots, np.int64)))
                whole = run_hashes(sums, LEAST)
                if len(starts):
                    columns = [whole[starts].view(np.int64), np.full(len(starts), name, np.int64), starts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return candidates.select("doc_id", F.col("text").cast("binary"), "places").mapInArrow(run, schema)


def shared_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two or more documents have, with the smallest and the largest of them."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return ends.filter("low <> high")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, start, n_words, other_id``: words that repeat in another document, in maximal stretches.

    ``start`` counts words from 0. Every ``LEAST`` words of a stretch occur in ``other_id``. A text with exact copies is one
    stretch from end to end; the copy of smallest id has the stretches it shares with other texts besides.
    """
    suffixes = settle(retained(docs), "suffix-retained")
    texts = settle(
        suffixes.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "suffix-texts"
    )
    copied = texts.filter("low <> high")
    copies = suffixes.join(copied.select("d1", "d2", "low", "high"), ["d1", "d2"]).select(
        "doc_id",
        F.lit(0).alias("start"),
        "n_words",
        F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other_id"),
    )
    kept = suffixes.join(texts.select(F.col("low").alias("doc_id")), "doc_id", "left_semi")
    kept = kept.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "doc_id", F.col("s.hashes").alias("h"), F.col("s.places").alias("place")
    )
    neighbours = settle(shared_keys(kept, "h").select("h"), "suffix-neighbours")
    spots = settle(
        kept.join(neighbours, "h").groupBy("doc_id").agg(F.collect_list("place").alias("places")), "suffix-spots"
    )
    # several rows of one id: one with the digest that was compared would do, all give the same passages or their own
    candidates = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").join(spots, "doc_id")
    rows = settle(passages(candidates), "suffix-passages")
    common = settle(shared_keys(rows, "passage"), "suffix-common")
    hits = rows.join(common, "passage").select(
        "doc_id", "start", F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other")
    )
    # a document's hits, bounded by its words, joined into stretches
    per_doc = hits.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "other"))).alias("hits"))

    def setup():
        def work(ids, lists):
            out = [[], [], [], []]
            for name, found in zip(ids, lists, strict=True):
                starts = np.array([h["start"] for h in found])
                others = np.array([h["other"] for h in found])
                cuts = np.flatnonzero((np.diff(starts) != 1) | (np.diff(others) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
                    row = (name, int(starts[a]), int(starts[b - 1] - starts[a]) + LEAST, int(others[a]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            return out

        return work

    stretches = map_batches(per_doc, setup, "doc_id long, start int, n_words int, other_id long", rows=64)
    return copies.unionAll(stretches).distinct()


def cut_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text`` without the words that a document of smaller id has too; other texts stay as they are."""
    later = found.filter("other_id < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("cuts"))
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(later, "doc_id", "left")

    def setup():
        def work(ids, texts, cuts):
            out = []
            for text, spans in zip(texts, cuts, strict=True):
                if spans:
                    words = text.encode().split()
                    keep = np.ones(len(words), bool)
                    for span in spans:
                        keep[span["start"] : span["start"] + span["n_words"]] = False
                    text = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()
                out.append(text)
            return ids, out

        return work

    return map_batches(joined, setup, "doc_id long, text string")


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs)
