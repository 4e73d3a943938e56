"""Alignment of two tokenizers over the same bytes, and corpus counts of the id pairs that meet.

Every text is tokenised whole by both: ``A`` a byte-level BPE over a blank and the text, ``B`` a SentencePiece model, which
puts that blank itself. Byte offsets follow from the lengths of the tokens. A window begins where a space-marked token of A and
one of B begin at the same byte, which is an end shared by the tokens before. The alignment of a window (groups, links,
bytes) depends on its two tuples of ids alone and is kept by these tuples; the bytes of all windows must
give the text again, so that no shared end is taken on trust. Where no blank is followed by white space, what stands between
blanks is tokenised by itself as within the text (``units``), and its window is found by its spelling, which has one pair of
tuples: both sides are checked to spell it when it is first met. Any other text is tokenised and cut whole.

Links of a text are kept as distinct pairs with numbers, in blocks of whole texts of about ``BLOCK`` bytes. A block
sends each of its distinct pairs once: summed over the corpus, compared with the best of the B id, and joined back to the
blocks that hold the pair. So what is shuffled grows with the distinct pairs of blocks, not with links, a block is
bounded, and a pair that all blocks hold is one row of each.

* null or empty text, or one whose tokens do not give its bytes (one that holds ``▁``): zeros and no digest; * null
``doc_id``: a row like any other; * repeated rows: each gets a row and counts; * ties for the best: all of them; * a very long
text: a block of its own, a window without blanks in linear time; * empty table: empty result; * other columns are not
read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema, once_per_worker
from quotemill.llm.sentencepiece_codec import BYTE, MARK, parse, separable
from quotemill.llm.units import UnitEncoder, byte_bpe
from quotemill.session import settle

BLOCK = 1 << 20
WINDOWS = 300_000
ROWS = 256
# a blank before white space: what follows is no unit
BROKEN = re.compile(r" \s")

BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "digests array<string>, sizes array<int>, places binary, numbers binary, pairs array<long>, counts array<long>"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_of_sign() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 signs stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of an id."""

    def __init__(self, units: UnitEncoder, table: list[bytes]):
        self.units, self.table = units, table
        self.length = np.array([len(t) for t in table], np.int64)
        self.marked = np.array([t[:1] == b" " for t in table])


def byte_side(spec: str) -> Side:
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(spec).get_vocab(with_added_tokens=True)
    signs, table = byte_of_sign(), [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        known = all(c in signs for c in piece)
        table[i] = bytes(signs[c] for c in piece) if known else piece.encode()
    return Side(byte_bpe(spec), table)


def piece_side(raw: bytes) -> Side:
    import sentencepiece

    model, processor = parse(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    table = [
        bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()
        for p, kind in zip(model.pieces, model.kinds, strict=True)
    ]
    whole = not (separable(model) and model.dummy_prefix and model.extra_spaces)
    opens = {" ": np.array([p.startswith(MARK) for p in model.pieces])}
    odd = lambda text: whole or MARK in text
    return Side(UnitEncoder(processor.encode, opens, dummy=True, odd=odd), table)


class Aligner:
    """Both sides, and the windows met so far by their id tuples."""

    def __init__(self, spec: str, raw: bytes):
        self.a, self.b = byte_side(spec), piece_side(raw)
        # an id as it is written in a group: not the last of its side, or the last
        n_a, n_b = len(self.a.table), len(self.b.table)
        self.signs = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        self.sign_sizes = np.array([len(s) for s in self.signs], np.int64)
        self.place, self.warm, self.known = {}, set(), {}
        self.texts, self.raws, self.links, self.sizes = [], [], [], [[], [], []]

    def forget(self) -> None:
        """Keep only the windows that came back since the last time, if these are not most of them."""
        warm = [u for u in self.warm if u in self.place] if 2 * len(self.warm) < WINDOWS else []
        kept = [self.place[u] for u in warm if self.place[u] >= 0]
        old = (self.texts, self.raws, self.links, *self.sizes)
        self.texts, self.raws, self.links, *self.sizes = ([side[i] for i in kept] for side in old)
        self.place = dict(zip((u for u in warm if self.place[u] >= 0), range(len(kept)), strict=True))
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.warm: set[str] = set()

    def learn(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Align new windows, all in one pass: a window of both sides has as many bytes on each."""
        a, b = (np.frombuffer(b"".join(k[side] for k in keys), np.uint32).astype(np.int64) for side in (0, 1))
        a_last, b_last = (np.cumsum([len(k[side]) // 4 for k in keys]) - 1 for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        raw = b"".join(map(self.a.table.__getitem__, a.tolist()))
        other = b"".join(map(self.b.table.__getitem__, b.tolist()))

        # links: of each A token the run of B tokens that overlap it
        low = np.searchsorted(b_ends, a_ends - self.a.length[a], "right")
        number = np.searchsorted(b_ends - self.b.length[b], a_ends, "left") - low
        after = np.cumsum(number)
        run = np.arange(after[-1]) - np.repeat(after - number, number)
        links = (np.repeat(a, number) << 32 | b[np.repeat(low, number) + run]).tobytes()

        # groups end where both sides end; the tokens of a group are written one side after the other
        a_shared, b_shared = np.isin(a_ends, b_ends), np.isin(b_ends, a_ends)
        a_group, b_group = np.cumsum(a_shared) - a_shared, np.cumsum(b_shared) - b_shared
        b_before = np.concatenate(([0], np.flatnonzero(b_shared) + 1))
        a_through = np.flatnonzero(a_shared) + 1
        b_place = np.arange(len(b)) + a_through[b_group]
        codes = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.a.table), len(self.b.table)
        codes[np.arange(len(a)) + b_before[a_group]] = a + n_a * a_shared
        codes[b_place] = 2 * n_a + b + n_b * b_shared
        text = "".join(map(self.signs.__getitem__, codes.tolist()))
        text_ends = np.cumsum(self.sign_sizes[codes])[b_place[b_last]].tolist()

        raw_ends, link_ends, groups = a_ends[a_last].tolist(), (8 * after[a_last]).tolist(), np.cumsum(a_shared)[a_last]
        starts = [[0, *ends[:-1]] for ends in (raw_ends, link_ends, text_ends)]
        raws = [raw[i:j] for i, j in zip(starts[0], raw_ends, strict=True)]
        if raw != other:  # a window whose two sides spell different bytes aligns nothing
            raws = [r if r == other[i:j] else None for r, i, j in zip(raws, starts[0], raw_ends, strict=True)]
        self.known.update(zip(keys, range(len(self.raws), len(self.raws) + len(keys)), strict=True))
        for sizes, last in zip(self.sizes, (a_last, b_last, groups - 1), strict=True):
            sizes += np.diff(last, prepend=-1).tolist()
        self.raws += raws
        self.links += [links[i:j] for i, j in zip(starts[1], link_ends, strict=True)]
        self.texts += [text[i:j] for i, j in zip(starts[2], text_ends, strict=True)]

    def learn_units(self, units: list[str]) -> None:
        """Numbers of the windows of blank-separated units, by the ids that both sides give them; none where bytes differ."""
        keys, fit = [], np.array([1 + len(u.encode()) for u in units])
        right = np.ones(len(units), bool)
        for side in (self.a, self.b):
            side.units.learn(units)
            ids = list(map(side.units.known.__getitem__, units))
            side.units.known.clear()
            starts = np.cumsum([0, *(len(x) // 4 for x in ids[:-1])])
            right &= np.add.reduceat(side.length[np.frombuffer(b"".join(ids), np.uint32)], starts) == fit
            keys.append(ids)
        keys, fit = list(zip(*keys, strict=True)), right.tolist()
        new = list(dict.fromkeys(k for k, ok in zip(keys, fit, strict=True) if ok and k not in self.known))
        if new:
            self.learn(new)
        self.place.update((u, self.known[k] if ok else -1) for u, k, ok in zip(units, keys, fit, strict=True))

    def windows(self, n_bytes: int, a: bytes, b: bytes) -> list[tuple[bytes, bytes]] | None:
        """The text cut where a space-marked token begins on both sides; none where the numbers of bytes differ."""
        a_ids, b_ids = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        if not len(a_ids) or not len(b_ids):
            return None
        a_ends, b_ends = np.cumsum(self.a.length[a_ids]), np.cumsum(self.b.length[b_ids])
        if a_ends[-1] != n_bytes or b_ends[-1] != n_bytes:
            return None
        a_marks, b_marks = np.flatnonzero(self.a.marked[a_ids]), np.flatnonzero(self.b.marked[b_ids])
        a_at, b_at = a_ends[a_marks] - self.a.length[a_ids[a_marks]], b_ends[b_marks] - self.b.length[b_ids[b_marks]]
        place = np.minimum(np.searchsorted(b_at, a_at), max(len(b_at) - 1, 0))
        shared = np.flatnonzero((b_at[place] == a_at) & (a_at > 0)) if len(b_at) else np.zeros(0, np.int64)
        a_cut = [0, *(4 * a_marks[shared]).tolist(), len(a)]
        b_cut = [0, *(4 * b_marks[place[shared]]).tolist(), len(b)]
        return list(zip(map(a.__getitem__, map(slice, a_cut, a_cut[1:])), map(b.__getitem__, map(slice, b_cut, b_cut[1:])), strict=True))

    def cut(self, text: str) -> list[str] | None:
        """Units that begin a space-marked token on both sides, a blank before each; none if the text has to be seen whole."""
        if self.b.units.odd(text):
            return None
        units = text.split(" ")
        return units if BROKEN.search(f" {text} ") is None else None

    def batch(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        """Of each text numbers of tokens and groups, the digest of the groups, the links as packed pairs; none where bytes differ."""
        if len(self.raws) > WINDOWS:
            self.forget()
        cuts = [self.cut(t) if t else None for t in texts]
        met = set(chain.from_iterable(c for c in cuts if c))
        new = met - self.place.keys()
        self.warm |= met - new
        if new:
            self.learn_units(sorted(new))
            gc.freeze()  # what is kept holds no cycles: do not search it again and again
        out = []
        for text, units in zip(texts, cuts, strict=True):
            raw = f" {text}".encode() if text else b""
            if units:
                found = list(map(self.place.__getitem__, units))
            else:
                keys = self.windows(len(raw), self.a.units.whole(f" {text}"), self.b.units.whole(text)) if text else None
                missing = [k for k in dict.fromkeys(keys or []) if k not in self.known]
                if missing:
                    self.learn(missing)
                found = [self.known[k] for k in keys or []]
            parts = list(map(self.raws.__getitem__, found)) if -1 not in found else []
            if not parts or None in parts or b"".join(parts) != raw:
                out.append(None)
                continue
            signs = "".join(map(self.texts.__getitem__, found))[:-1]
            links = np.frombuffer(b"".join(map(self.links.__getitem__, found)), np.int64)
            sizes = [sum(map(x.__getitem__, found)) for x in self.sizes]
            out.append((*sizes, hashlib.sha256(signs.encode()).hexdigest(), links))
        return out


def narrow(numbers: np.ndarray) -> bytes:
    """In two, four or eight bytes each, as the largest needs."""
    most = int(numbers.max(initial=0))
    return numbers.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<i8").tobytes()


def widen(raw: bytes, n: int) -> np.ndarray:
    kind = {2: "<u2", 4: "<u4", 8: "<i8"}[len(raw) // n] if n else "<i8"
    return np.frombuffer(raw, kind).astype(np.int64)


def align_blocks(docs: DataFrame, spec: str, raw: bytes, block: int = BLOCK) -> DataFrame:
    """Blocks of whole texts: statistics and digest of each text, its distinct pairs by their place among those of the block."""
    shared = docs.sparkSession.sparkContext.broadcast((spec, raw))  # the two vocabulary files
    key = (zlib.crc32(spec.encode()), zlib.crc32(raw))
    out = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once_per_worker(("cross_tokenizer", key), lambda: Aligner(*shared.value))
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            pairs, places, counts = [np.zeros(0, np.int64)] * 3
            if any(len(h[6]) for h in held):
                pairs, places = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
                numbers = np.concatenate([h[7] for h in held])
                counts = np.bincount(places, numbers, len(pairs)).astype(np.int64)
            else:
                numbers = np.zeros(0, np.int64)
            columns = [[h[i] for h in held] for i in range(6)]
            sizes = [len(h[6]) for h in held]
            packed = [narrow(places), narrow(numbers)]
            row = [number, *columns, sizes, *packed, pairs, counts]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                names, texts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for name, text, found in zip(names, texts, aligner.batch(texts), strict=True):
                    if found is None:
                        held.append((name, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    else:
                        n_a, n_b, n_groups, digest, links = found
                        held.append((name, n_a, n_b, n_groups, len(links), digest, *np.unique(links, return_counts=True)))
                    size += len(text or "") + 64
                    if size >= block:
                        yield flush()
                        number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of the pair over the corpus, and whether no other pair of its B id has more."""
    counted = settle(
        blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.counts").alias("n"))
        .withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))),
        "pair-counts",
    )
    # at most a row per id of B's vocabulary
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, spec: str, raw: bytes, block: int = BLOCK) -> DataFrame:
    """Columns ``ALIGNED``, a row for each row of ``docs``."""
    blocks = settle(align_blocks(docs, spec, raw, block), "aligned-blocks")
    pairs = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = settle(pair_counts(blocks), "pairs")
    back = pairs.join(known, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("x"))
    back = back.select("block", F.col("x.n").alias("n"), F.col("x.best").alias("best"))
    whole = blocks.drop("pairs", "counts").join(back, "block", "left")
    out = arrow_schema(ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                places, numbers = (widen(row[c], sum(row["sizes"])) for c in ("places", "numbers"))
                n, best = np.array(row["n"] or [], np.int64), np.array(row["best"] or [], bool)
                # sums of exact integers, cut at the ends of the texts
                ends = np.cumsum([0, *row["sizes"]])
                total = np.concatenate(([0], np.cumsum(numbers * n[places], dtype=np.int64)))
                good = np.concatenate(([0], np.cumsum(numbers * best[places], dtype=np.int64)))
                columns = [
                    *(row[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")),
                    np.diff(good[ends]),
                    np.diff(total[ends]),
                    row["digests"],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return whole.select("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "places", "numbers", "n", "best").mapInArrow(
        run, ALIGNED
    )


def query(docs: DataFrame, bpe_path: str, model_path: str) -> DataFrame:
    with open(bpe_path, encoding="utf-8") as spec, open(model_path, "rb") as raw:
        return align(docs, spec.read(), raw.read())
