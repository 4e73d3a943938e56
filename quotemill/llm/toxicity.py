"""Toxicity: a learned lexicon, found also where misspelled, weighed by the words around it.

* **Lexicon.** Over the training rows, words and stems (first letters of a longer word, counted where a text holds two such
  words), both outside quotations, whose documents are toxic far more often than the rest. A trie holds them with their weights.
* **Misspellings.** A Levenshtein automaton of a text's word (bit masks of the places reached with 0, 1, … edits, swapped
  neighbours being one) is run along the trie. A term of ``FUZZY`` letters or more may be ``EDITS`` away; a word that
  clean training documents use as it is, is no misspelling.
* **Context.** A hit looks at ``WINDOW`` words on both sides: whether it stands in quotation marks, the learned weights
  of the words there (of words as they are in the lexicon, in toxic against clean documents), and other hits near it. Quoted and
  abusive hits are separate inputs.
* **Score.** A logistic model of these inputs, Newton steps in numpy, weighted back to the shares of the classes. It is
  calibrated on all training rows, being fitted by likelihood.

Learned only from rows that are not held out: at most ``SAMPLE_ROWS`` of each class, the first by a hash of their id;
their whole texts are counted in Spark tasks. At most ``TERMS`` terms and as many context words and exceptions are kept.
``doc_id``, language and source are never inputs of a score.

* rows held out: crc32 of the id as text, modulo 4, is 2 (not held out where the id is null); * null or empty text, or no hit:
the score of a text without hits; * labels that are null or neither 0 nor 1, or of no document: left out; several labels
of a document: the largest; * several texts of one ``doc_id``: the least in byte order is learned from, each is scored; * no usable
labels: every score is 0; one class only: its share; * ties of terms: by their letters; * a very long text: one pass;
a very long word: no more of it than the longest term; * repeated rows: each gets a row; * empty table: empty result; * other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import map_batches, once_per_worker
from quotemill.session import settle

SAMPLE_ROWS = 4000
TERMS = 400
STEMS = (4, 5, 6, 7)
FUZZY = 5
EDITS = 1
WINDOW = 4
THRESHOLD = 0.3
LEAST_DOCS = 3
LEAST_WEIGHT = 3.0
CACHE = 400_000
# words, quotation marks (straight, opening, closing) and line ends
TOKEN = re.compile(r"\w+|[\"“”„«»\n]")
OPENING, CLOSING, STRAIGHT = frozenset("“„«"), frozenset("”»"), '"'


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


# ------------------------------------------------------------- trie, automaton


class Node:
    __slots__ = ("next", "word", "stem")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.word = self.stem = None


def trie(terms: list[tuple[str, bool, float]]) -> Node:
    """``(term, is_stem, weight)`` by letters."""
    root = Node()
    for term, is_stem, _ in terms:
        node = root
        for letter in term:
            node = node.next.setdefault(letter, Node())
        if is_stem:
            node.stem = term
        else:
            node.word = term
    return root


def automaton_step(masks: tuple, before: tuple, letter_mask: int, swap_mask: int, full: int) -> tuple:
    """Places of the word reached after one more letter of a term, by number of edits.

    Bit ``i`` of ``masks[e]`` says: the first ``i`` letters of the word match the term so far with ``e`` edits. ``letter_mask`` has
    bit ``i`` where letter ``i`` of the word is the new one; ``before`` are the masks two letters ago, where the new letter swapped
    with the one before matches at the bits of ``swap_mask``.
    """
    out = []
    for e, mask in enumerate(masks):
        reached = (mask & letter_mask) << 1
        if e:
            reached |= masks[e - 1]  # the term has a letter more
            reached |= masks[e - 1] << 1  # another letter
            reached |= out[e - 1] << 1  # the word has a letter more
            reached |= (before[e - 1] & swap_mask) << 2
        out.append(reached & full)
    return tuple(out)


def matches(root: Node, word: str, edits: int = EDITS, fuzzy: int = FUZZY) -> list[tuple[str, bool, int]]:
    """``(term, is_stem, edits)`` of all terms that the word spells, and of the stems that it begins with.

    Terms shorter than ``fuzzy`` letters and stems are only found without edits.
    """
    full = (1 << len(word) + 1) - 1
    letters: dict[str, int] = {}
    for i, letter in enumerate(word):
        letters[letter] = letters.get(letter, 0) | 1 << i
    start = tuple((1 << e + 1) - 1 for e in range(edits + 1))
    start = tuple(m & full for m in start)
    nothing = (0,) * (edits + 1)
    found, last = [], 1 << len(word)
    stack = [(root, start, nothing, "", 0)]
    while stack:
        node, masks, before, letter, depth = stack.pop()
        if node.word is not None:
            for e in range(edits + 1 if depth >= fuzzy else 1):
                if masks[e] & last:
                    found.append((node.word, False, e))
                    break
        if node.stem is not None and masks[0]:
            found.append((node.stem, True, 0))
        for following, child in node.next.items():
            # swapped: the word has the new letter, then the one before it
            swap = letters.get(following, 0) & letters.get(letter, 0) >> 1 if letter else 0
            moved = automaton_step(masks, before, letters.get(following, 0), swap, full)
            if any(moved):
                stack.append((child, moved, masks, following, depth + 1))
    return found


@dataclass
class Lexicon:
    """Terms with weights, words that are no misspellings, weights of context words."""

    terms: list[tuple[str, bool, float]]
    exceptions: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.root = trie(self.terms)
        self.weight = {(t, s): w for t, s, w in self.terms}
        self.longest = max((len(t) for t, _, _ in self.terms), default=0)
        fuzzy = [t for t, s, _ in self.terms if not s and len(t) >= FUZZY]
        # one edit, or a swap, leaves either the first or the last letters of a term as they are: two of five letters, three of seven
        kept = [(t, 2 if len(t) < 7 else 3) for t in fuzzy]
        self.heads, self.tails = {t[:n] for t, n in kept}, {t[-n:] for t, n in kept}
        self.exact = {t for t, s, _ in self.terms if not s}
        self.stems = {t for t, s, _ in self.terms if s}
        self.sizes = sorted({len(t) for t in self.stems})
        self.clean: set[str] = set()
        self.hits: dict[str, list[tuple[float, bool, int]]] = {}

    def look_up(self, word: str) -> list[tuple[float, bool, int]]:
        """Weight, whether by stem, and edits, of the terms in a word; the least edits of each kind."""
        near = len(word) <= self.longest + EDITS and (
            word[:2] in self.heads or word[:3] in self.heads or word[-2:] in self.tails or word[-3:] in self.tails
        )
        if not (near or word in self.exact or any(word[:n] in self.stems for n in self.sizes)):
            return []
        found = matches(self.root, word[: self.longest + EDITS + 1])
        whole = [(e, t) for t, s, e in found if not s and (e == 0 or word not in self.exceptions)]
        out = []
        if whole:
            least = min(e for e, _ in whole)
            out.append((max(self.weight[t, False] for e, t in whole if e == least), False, least))
        else:
            stems = [self.weight[t, True] for t, s, _ in found if s]
            if stems:
                out.append((max(stems), True, 0))
        return out

    def find(self, words: set[str]) -> dict[str, list[tuple[float, bool, int]]]:
        """The words of a text that hit."""
        if len(self.clean) > CACHE:
            self.clean.clear()
        for word in words - self.clean - self.hits.keys():
            found = self.look_up(word)
            if found:
                if len(self.hits) > CACHE:
                    self.hits.clear()
                self.hits[word] = found
            else:
                self.clean.add(word)
        return {w: self.hits[w] for w in words if w in self.hits}


# ------------------------------------------------------------------- features


def marked_words(tokens: list[str]) -> tuple[list[str], list[bool]]:
    """The words, and whether each is quoted; a quotation ends with its paragraph at the latest."""
    words, quoted, inside, straight = [], [], 0, False
    for token in tokens:
        if token == "\n":
            inside, straight = 0, False
        elif token == STRAIGHT:
            straight = not straight
        elif token in OPENING:
            inside += 1
        elif token in CLOSING:
            inside = max(0, inside - 1)
        else:
            words.append(token)
            quoted.append(straight or inside > 0)
    return words, quoted


def windows(tokens: list[str], hits: dict) -> tuple[int, list[tuple[str, bool, list[str]]]]:
    """Number of words; of each hit the word, whether it is quoted, and the words around it."""
    words, quoted = marked_words(tokens)
    around = []
    for i, word in enumerate(words):
        if word in hits:
            around.append((word, quoted[i], words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]))
    return len(words), around


N_FEATURES = 12


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    tokens = TOKEN.findall((text or "").lower())
    hits = lexicon.find(set(tokens))
    if not hits:
        return [0.0] * N_FEATURES
    n, around = windows(tokens, hits)
    exact = near = stems = quoted = abuse = close = context = 0.0
    best, distinct = 0.0, set()
    for word, in_quotes, others in around:
        weight, by_stem, edits = hits[word][0]
        side = sum(lexicon.context.get(o, 0.0) for o in others)
        side = max(-3.0, min(3.0, side))
        if in_quotes:
            quoted += 1
            continue
        context += side
        abuse += weight / (1 + np.exp(-side))
        close += any(o in hits for o in others)
        distinct.add(word)
        best = max(best, weight if not edits else weight / 2)
        if by_stem:
            stems += 1
        elif edits:
            near += 1
        else:
            exact += 1
    total = exact + near + stems
    return [
        np.log1p(exact),
        np.log1p(near),
        np.log1p(stems),
        np.log1p(quoted),
        np.log1p(abuse),
        np.log1p(close),
        np.log1p(len(distinct)),
        best,
        float(exact > 0),
        np.log1p(1000 * total / (n + 20)),
        np.log1p(1000 * stems / (n + 20)),
        context / (1 + total),
    ]


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]
    exceptions: frozenset[str]
    context: dict[str, float]
    weights: list[float]
    constant: float | None = None

    def scores(self, lexicon: Lexicon, texts: list[str | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        x = np.array([features(t, lexicon) for t in texts]).reshape(-1, N_FEATURES)
        return sigmoid(x @ np.array(self.weights[1:]) + self.weights[0]).round(9).tolist()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps, the constant first and without ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ w)
        slope = design.T @ (weight * (p - y)) + penalty * w
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w


# ------------------------------------------------------------------- learning


def counted_terms(text: str) -> list[tuple[str, bool]]:
    """Distinct words of a text outside quotations, and the stems that two or more of these begin with."""
    words = Counter(w for w, quoted in zip(*marked_words(TOKEN.findall(text.lower())), strict=True) if not quoted and len(w) > 2)
    stems = Counter()
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                stems[word[:size]] += n
    return [*((w, False) for w in words), *((s, True) for s, n in stems.items() if n >= 2)]


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> tuple[Column, Column]:
    """Log odds ratio of two shares, with halves added, and how many standard errors it is."""
    odds = F.log((toxic + 0.5) / (F.lit(n_toxic) - toxic + 0.5)) - F.log((clean + 0.5) / (F.lit(n_clean) - clean + 0.5))
    error = F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return odds, odds / error


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, toxic, text)`` of at most ``rows`` labelled rows a class that are not held out; sizes of the classes."""
    marks = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    texts = docs.select("doc_id", "text").filter(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # ids that have a text; their whole texts are fetched for the chosen ones only
    known = settle(marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "toxic-labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    halves = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    chosen = halves[0].unionAll(halves[1])  # at most 2 * rows rows of two numbers
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return settle(found, "toxic-sample"), sizes


def learn_terms(rows: DataFrame, n: dict[int, int]) -> list[tuple[str, bool, float]]:
    def setup():
        def work(marks, texts):
            total: dict[tuple[str, bool], list[int]] = {}
            for mark, text in zip(marks, texts, strict=True):
                for key in counted_terms(text):
                    total.setdefault(key, [0, 0])[mark] += 1
            return [k[0] for k in total], [k[1] for k in total], [v[1] for v in total.values()], [v[0] for v in total.values()]

        return work

    counted = (
        map_batches(rows.select("toxic", "text"), setup, "term string, stem boolean, bad long, good long", rows=64)
        .groupBy("term", "stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    odds, errors = log_odds(F.col("bad"), F.col("good"), n[1], n[0])
    chosen = (
        counted.withColumns({"weight": odds, "sure": errors})
        .filter((F.col("bad") >= LEAST_DOCS) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("sure") >= 2.5))
        .orderBy(F.desc("sure"), "term", "stem")
        .limit(TERMS)
        .collect()
    )
    # a stem that one word makes up is that word
    words = [(r["term"], r["bad"]) for r in chosen if not r["stem"]]
    chosen = [r for r in chosen if not r["stem"] or not any(w.startswith(r["term"]) and 5 * n >= 4 * r["bad"] for w, n in words)]
    stems = {r["term"] for r in chosen if r["stem"]}
    # a stem speaks for the longer stems and the words that begin with it, unless a word is more telling
    weight = {r["term"]: r["weight"] for r in chosen if r["stem"]}
    kept = []
    for r in chosen:
        shorter = [weight[r["term"][:k]] for k in range(1, len(r["term"])) if r["term"][:k] in stems]
        if not shorter or max(shorter) < r["weight"] - 0.5:
            kept.append((r["term"], r["stem"], round(r["weight"], 6)))
    return kept


def learn_context(rows: DataFrame, terms: list) -> tuple[frozenset[str], dict[str, float]]:
    """Words of clean documents that only look like a term, and weights of the words around hits."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def setup():
        lexicon = Lexicon(shared.value)

        def work(marks, texts):
            out = [[], [], []]
            for mark, text in zip(marks, texts, strict=True):
                tokens = TOKEN.findall(text.lower())
                hits = lexicon.find(set(tokens))
                near = [w for w, h in hits.items() if h[0][2] > 0]
                plain = {w: h for w, h in hits.items() if not h[0][1] and not h[0][2]}
                beside = {o for _, _, others in windows(tokens, plain)[1] for o in others if o not in hits} if plain else set()
                found = [*((w, True) for w in near), *((w, False) for w in beside)]
                out[0] += [w for w, _ in found]
                out[1] += [k for _, k in found]
                out[2] += [mark] * len(found)
            return out

        return work

    counted = settle(
        map_batches(rows.select("toxic", "text"), setup, "word string, near boolean, toxic int", rows=64)
        .groupBy("word", "near")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")),
        "toxic-context",
    )
    plain = counted.filter("near and good > bad").orderBy(F.desc("good"), "word").limit(100 * TERMS).collect()
    totals = counted.filter("not near").agg(F.max("bad").alias("bad"), F.max("good").alias("good")).first()
    bad, good = float((totals["bad"] or 0) + 1), float((totals["good"] or 0) + 1)
    odds, errors = log_odds(F.col("bad"), F.col("good"), bad, good)
    telling = (
        counted.filter("not near and bad + good >= 8")
        .withColumns({"weight": odds, "sure": F.abs(errors)})
        .filter("sure >= 3")
        .orderBy(F.desc("sure"), "word")
        .limit(TERMS)
        .collect()
    )
    return frozenset(r["word"] for r in plain), {r["word"]: round(max(-1.5, min(1.5, r["weight"])), 6) for r in telling}


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model; what reaches the driver is the lexicon, the context words and ``N_FEATURES`` numbers a sampled row."""
    drawn, sizes = sample(docs, labels, rows)
    n = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model([], frozenset(), {}, [], float(max(n, default=0)))
    terms = learn_terms(drawn, n)
    exceptions, context = learn_context(drawn, terms)
    shared = docs.sparkSession.sparkContext.broadcast((terms, exceptions, context))

    def setup():
        lexicon = Lexicon(*shared.value)
        return lambda ids, marks, texts: (ids, marks, [features(t, lexicon) for t in texts])

    columns = drawn.select(F.col("doc_id").cast("string").alias("name"), "toxic", "text")
    table = map_batches(columns, setup, "name string, toxic int, x array<double>", rows=64).orderBy("name").collect()
    y = np.array([r["toxic"] for r in table], float)
    x = np.array([r["x"] for r in table]).reshape(-1, N_FEATURES)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    return Model(terms, exceptions, context, logistic(x, y, weight).round(9).tolist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def setup():
        model = Model(**shared.value)
        key = ("toxicity", hash((tuple(model.terms), model.exceptions, tuple(sorted(model.context.items())))))
        lexicon = once_per_worker(key, lambda: Lexicon(model.terms, model.exceptions, model.context))

        def work(ids, held, texts):
            scores = model.scores(lexicon, texts)
            return ids, held, scores, [int(s >= threshold) for s in scores]

        return work

    columns = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return map_batches(columns, setup, "doc_id long, held_out boolean, score double, predicted int")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
