"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

A token is a run of word characters or of other visible ones. Its index vector has ``NONZERO`` entries of
+1 or -1 at places given by its hash. The vector of a word of the sample is its own index vector plus the
sum of those of its neighbours over the sample, scaled to length one; any other token has its index vector. A
document is the mean over its tokens, with a few ratios of its token counts. A network of two layers in numpy
gives a logit, divided by a temperature that makes the probabilities right on rows not used for the weights.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of their
id. Their whole texts are counted and summed in Spark tasks: the ``WORDS`` commonest words get vectors, context sums combine in
a task and then by word, and a row of features for each text reaches the driver. Only the text is an input.

* rows held out: crc32 of the id as text, modulo 4, is 2 (not held out where the id is null); * null or empty
text: no tokens, score 0; * labels that are null, neither 0 nor 1, or of no document: left out; several labels of
a document: the largest; * several texts of a document: the least in byte order is learned from, each is scored; * no usable
labels: every text with tokens scores 0.5, with one class only it scores the share of that class; * repeated rows: each gets a row; * empty documents: empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema, filter_batches, map_batches
from quotemill.session import settle

SAMPLE_ROWS = 4000
WORDS = 50_000
PARTS = 32
STRETCH = 200_000
SIZE = 64
NONZERO = 4
HIDDEN = 24
WINDOW = 2
LEAST = 3
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def index_places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors, a row a word."""
    raw = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    mixed = (raw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    lanes = mixed[:, None] >> (np.arange(NONZERO, dtype=np.uint64) * np.uint64(8))
    return (lanes % np.uint64(SIZE)).astype(np.int64), 1.0 - 2.0 * (lanes >> np.uint64(7) & np.uint64(1)).astype(np.float64)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def index_sum(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Weighted sum of index vectors."""
    if not words:
        return np.zeros(SIZE)
    places, signs = index_places(words)
    return np.bincount(places.ravel(), (signs * weights[:, None]).ravel(), SIZE) / np.sqrt(NONZERO)


def context_sums(texts: list[str], known: dict[str, int]) -> np.ndarray:
    """Sums of the neighbours' index vectors of each known word; whole numbers, so that they add up the same in any order."""
    places, signs = index_places(list(known))
    own = np.zeros((len(known) + 1, SIZE), np.float64)  # the last row: a word that is not known
    np.add.at(own, (np.arange(len(known))[:, None], places), signs)
    total = np.zeros((len(known), SIZE), np.float64)
    gap = [len(known)] * WINDOW
    flat: list[int] = []

    def add():
        row = np.array(flat, np.int64)
        order = np.argsort(row, kind="stable")
        starts = np.flatnonzero(np.diff(row[order], prepend=-1))
        ids = row[order][starts]
        for shift in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            sums = np.add.reduceat(own[np.roll(row, -shift)][order], starts, axis=0)
            total[ids[ids < len(known)]] += sums[ids < len(known)]
        flat.clear()

    for text in texts:
        flat += [known.get(t.lower(), len(known)) for t in tokens(text)] + gap
        if len(flat) >= STRETCH:
            add()
    if flat:
        add()
    return total


def features(text: str, known: dict[str, int], vectors: np.ndarray) -> np.ndarray | None:
    """Pooled vector and ratios; none for a text without tokens."""
    row = tokens(text)
    n = len(row)
    if not n:
        return None
    found, again = Counter(row), sum(map(eq, row, islice(row, 1, None)))
    upper = sum(c for t, c in found.items() if len(t) > 1 and t.isupper())
    marks = sum(c for t, c in found.items() if not (t[0].isalnum() or t[0] == "_"))
    plain, rest = [], []
    for t, c in found.items():
        place = known.get(t.lower())
        if place is None:
            rest.append((t, c))
        else:
            plain.append((place, c))
    pooled = index_sum([t.lower() for t, _ in rest], np.array([c for _, c in rest], np.float64))
    if plain:
        places, weights = np.array(plain).T
        pooled += weights @ vectors[places]
    pooled /= n
    top = max(found.values()) / n
    ratios = [np.log1p(n) / 10, len(found) / n, top, again / n, upper / n, marks / n, np.linalg.norm(pooled), np.log1p(len(text) / n)]
    return np.concatenate((pooled, ratios))


@dataclass
class Model:
    known: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(scale(x, self.mean, self.spread) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None]) -> list[float]:
        made = [features(text, self.known, self.vectors) if text else None for text in texts]
        some = [m for m in made if m is not None]
        if self.constant is not None:
            found = iter([self.constant] * len(some))
        elif some:
            # rounded, so that a score does not depend on the rows it is worked out with
            found = iter(sigmoid(self.logits(np.array(some)) / self.temperature).round(9).tolist())
        return [0.0 if m is None else next(found) for m in made]


def scale(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standard units, within the range that the network has seen."""
    return np.clip((x - mean) / spread, -6, 6)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(
    x: np.ndarray, labels: np.ndarray, calibrate: np.ndarray, known: dict[str, int], vectors: np.ndarray, seed: int = 7, rounds: int = 400
) -> Model:
    """Weights from the rows of features outside ``calibrate``, the temperature from those inside."""
    fit = ~calibrate
    y, own = labels.astype(np.float64), x[fit]
    mean, spread = own.mean(0), own.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if s and i % 2 == 0 else np.zeros(s) for i, s in enumerate(shapes)]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    scaled, target = scale(own, mean, spread), y[fit]
    # both classes weigh the same half, softened, so that the rarer one is learned too
    share = np.clip(target.mean(), 0.02, 0.98)
    weight = np.sqrt(np.where(target == 1, 0.5 / share, 0.5 / (1 - share)))
    for turn in range(1, rounds + 1):
        hidden = np.tanh(scaled @ w[0] + w[1])
        gap = weight * (sigmoid(hidden @ w[2] + w[3]) - target) / len(target)
        back = gap[:, None] * w[2] * (1 - hidden**2)
        grads = [scaled.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ gap + 1e-4 * w[2], gap.sum()]
        for i, g in enumerate(grads):  # Adam
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            w[i] = w[i] - 0.02 * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
    model = Model(known, vectors, mean, spread, w[0], w[1], w[2], float(w[3]), 1.0)
    rows = calibrate if calibrate.any() else fit
    logits, target = model.logits(x[rows]), y[rows]

    def loss(temperature: float) -> float:
        p = np.clip(sigmoid(logits / temperature), 1e-9, 1 - 1e-9)
        return float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).mean())

    model.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(doc_id, quality, calibrate, text)`` of at most ``rows`` labelled rows that are not held out, with whole texts."""
    marks = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).filter(~held_out())
    texts = docs.select("doc_id", "text").filter(~held_out() & F.col("text").rlike("\\S"))
    # the rows first, by their ids alone, then the texts of those
    chosen = marks.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    calibrate = F.crc32(F.col("doc_id").cast("string")) % 4 == 3
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return settle(found.select("doc_id", "quality", calibrate.alias("calibrate"), "text"), "quality-sample")


def common_words(texts: DataFrame) -> dict[str, int]:
    """The ``WORDS`` commonest of the words that occur ``LEAST`` times or more, by their letters where equal."""

    def setup():
        def work(rows):
            counts = Counter(t.lower() for text in rows for t in tokens(text))
            return list(counts), list(counts.values())

        return work

    counted = map_batches(texts, setup, "word string, n long", rows=64).groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return {w: i for i, w in enumerate(sorted(r["word"] for r in rows))}


def word_vectors(texts: DataFrame, known: dict[str, int]) -> np.ndarray:
    """A vector of length one for each known word: its own index vector and those of its neighbours over all ``texts``."""
    if not known:
        return np.zeros((0, SIZE), np.float32)
    schema = "part int, place int, sums binary"
    shared, out = texts.sparkSession.sparkContext.broadcast(known), arrow_schema(schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros((len(words), SIZE))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                total += context_sums(batch.column(0).slice(at, 64).to_pylist(), words)
        used = np.flatnonzero(total.any(1))
        columns = [used % PARTS, used, [total[k].tobytes() for k in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def joined(table: pa.Table) -> pa.Table:
        place, row = np.unique(table["place"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(place), SIZE))
        np.add.at(sums, row, np.frombuffer(b"".join(table["sums"].to_pylist())).reshape(-1, SIZE))
        columns = [place % PARTS, place, [x.tobytes() for x in sums]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    places, signs = index_places(list(known))
    total = np.zeros((len(known), SIZE))
    np.add.at(total, (np.arange(len(known))[:, None], places), signs)
    # a row for each known word
    for row in texts.mapInArrow(local, schema).groupBy("part").applyInArrow(joined, schema).collect():
        total[row["place"]] += np.frombuffer(row["sums"])
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return total.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model from a bounded sample of labelled rows; texts stay in Spark, what comes back are words, vectors and features."""
    drawn = sample(docs, labels, rows)
    own = drawn.filter("not calibrate").select("text")
    known = common_words(own)
    vectors = word_vectors(own, known)
    shared = docs.sparkSession.sparkContext.broadcast((known, vectors))

    def setup():
        def work(ids, qualities, calibrates, texts):
            made = [features(t, *shared.value) for t in texts]
            kept = [i for i, m in enumerate(made) if m is not None]
            return [[column[i] for i in kept] for column in (ids, qualities, calibrates, made)]

        return work

    columns = drawn.select(F.col("doc_id").cast("string").alias("name"), "quality", "calibrate", "text")
    table = map_batches(columns, setup, "name string, quality int, calibrate boolean, x array<double>", rows=64)
    table = table.orderBy("name").collect()
    found = np.array([r["quality"] for r in table], np.int64)
    if len(set(found.tolist())) < 2:
        return Model({}, np.zeros((0, SIZE), np.float32), *[np.zeros(0)] * 5, 0.0, 1.0, float(found.mean()) if len(found) else 0.5)
    calibrate = np.array([r["calibrate"] for r in table])
    if len(set(found[~calibrate].tolist())) < 2:
        calibrate[:] = False
    return train(np.array([r["x"] for r in table]), found, calibrate, known, vectors)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def setup():
        model = Model(**shared.value)

        def work(ids, held, texts):
            scores = model.scores(texts)
            return ids, held, scores, [int(s >= threshold) for s in scores]

        return work

    columns = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return map_batches(columns, setup, "doc_id long, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows whose text scores the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def setup():
        model = Model(**shared.value)
        return lambda texts: [s >= threshold for s in model.scores(texts)]

    return filter_batches(docs, "text", setup)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
