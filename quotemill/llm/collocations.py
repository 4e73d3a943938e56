"""Phrases whose words come together more often than apart, counted in counting quotient filters.

1. A task turns its texts into blocks of one language: the distinct words of the block, their counts, and the texts as places
   among them, with a mark wherever a piece ends.
2. Words are summed over the blocks. Only words that reach ``least`` get an id: a phrase is never commoner than
   its words. The ids go back to the blocks that hold the word, by an equi-join of a row per block and word.
3. Each phrase of such words is its ids packed into one number: pairs in ``2 * bits`` bits, three and four words in ``4 * bits``.
   An invertible permutation (a Feistel network of the two halves) spreads these numbers evenly; the upper bits are the
   quotient, the rest the remainder, kept in full, so that counts are exact and the phrase can be read back. A
   filter is sorted by quotient and remainder, and counts below 255 take a byte. A task merges the filters of its blocks and
   sends a row for each quotient, however often a phrase occurs there. Pairs are counted first; three and four words only
   where every pair passes a bit map of the frequent ones, whose size is fixed and which holds none of them back.
4. The filters of all tasks are merged quotient by quotient. Their number follows the corpus (``RUN`` entries each, as the
   permutation deals phrases out evenly), so that no group grows with the input.
5. Cuts, containment in longer phrases, words and ranks are joins and a window with a limit.

* null or empty text: no words; * null language: ``und``; * repeated rows: each counts; * ties: by the contract's
orders, the smallest cut, the phrase in byte order; * a very long text: a block of its own; * empty table: empty result;
* other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema
from quotemill.session import settle

LEAST = 30
LONGEST = 4
TOP = 2000
INSIDE = 80
BLOCK = 500_000
RUN = 1 << 17
PENDING = 1 << 20
# bits of the map of frequent pairs, whatever their number
MAP = 26
CHUNK = 18

ENDS = b".,;:!?\n\x0b\x0c\r"
TO_MARK = bytes.maketrans(ENDS, b"." * len(ENDS))

BLOCKS = "block long, lang string, words array<string>, counts array<long>, places binary"
FILTERS = "quotient long, upper binary, lower binary, counts binary, large binary"
PHRASES = ", ".join(f"w{k} long" for k in range(1, LONGEST + 1)) + ", f long"
IDS = [f"w{k}" for k in range(1, LONGEST + 1)]


# ------------------------------------------------------------------ blocks


def rows_of(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple]:
    """Rows as Python values, ``rows`` at a time."""
    for at in range(0, batch.num_rows, rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def word_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of one language each; place 0 ends a piece, place ``i`` is word ``i - 1`` of the block."""
    out = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str):
            known, parts = held.pop(lang)
            sizes.pop(lang)
            places = np.concatenate(parts)
            words = [w.decode() for w in list(known)[1:]]
            counts = np.bincount(places, minlength=len(known))[1:]
            row = [number, lang, words, counts, places.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

        for lang, text in (row for batch in batches for row in rows_of(batch)):
            found = (text or "").encode().lower().translate(TO_MARK).replace(b".", b" . ").split()
            if not found:
                continue
            known, parts = held.setdefault(lang, ({b".": 0}, []))
            for word in set(found).difference(known):
                known[word] = len(known)
            parts.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
            parts.append(np.zeros(1, np.uint32))
            sizes[lang] = sizes.get(lang, 0) + len(found)
            # many languages share the room of one block
            if sum(sizes.values()) >= size:
                yield flush(max(sizes, key=sizes.get))
                number += 1
        for lang in list(held):
            yield flush(lang)
            number += 1

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, BLOCKS)


def numbered_words(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, word, f, id)``: ids without gaps from 1, numbered from per-partition offsets."""
    counted = (
        blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
        .groupBy("lang", F.col("x.words").alias("word"))
        .agg(F.sum("x.counts").alias("f"))
        .filter(F.col("f") >= least)
    )
    # monotonically_increasing_id: partition number in the upper bits, position in the lower 33
    placed = settle(counted.withColumn("place", F.monotonically_increasing_id()), "words-placed")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    named = placed.withColumn("part", part).join(offsets, "part")
    position = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return settle(named.select("lang", "word", "f", (F.col("offset") + position + 1).alias("id")), "words")


# ----------------------------------------------------------------- filters


def mixed(x: np.ndarray, turn: int, mask: int) -> np.ndarray:
    x = (x + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) & np.uint64(mask)


def permute(upper: np.ndarray, lower: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of ``half``-bit numbers."""
    mask = (1 << half) - 1
    upper = upper ^ mixed(lower, 1, mask)
    lower = lower ^ mixed(upper, 2, mask)
    return upper ^ mixed(lower, 3, mask), lower


def restore(upper: np.ndarray, lower: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << half) - 1
    upper = upper ^ mixed(lower, 3, mask)
    lower = lower ^ mixed(upper, 2, mask)
    return upper ^ mixed(lower, 1, mask), lower


def summed(upper: np.ndarray, lower: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted, each entry once with the sum of its counts."""
    if half <= 32:
        key = upper << np.uint64(half) | lower
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
    else:
        order = np.lexsort((lower, upper))
        a, b = upper[order], lower[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else order
    if not len(order):
        return upper, lower, counts
    kept = order[first]
    return upper[kept], lower[kept], np.add.reduceat(counts[order], first)


def narrow(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(raw: bytes, width: int) -> np.ndarray:
    if not width:
        raise ValueError("an entry has no bytes")
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


class Layout:
    """How a packed phrase is split: ``bits`` of an id, ``width`` ids a half, ``quotient`` bits of the upper half."""

    def __init__(self, bits: int, width: int, quotient: int):
        self.bits, self.width, self.half = bits, width, width * bits
        self.quotient = min(quotient, self.half - 1)
        self.rest = self.half - self.quotient
        self.upper_bytes, self.lower_bytes = (self.rest + 7) // 8, (self.half + 7) // 8

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids``: twice ``width`` rows, zeros where a phrase has no word."""
        shift = np.uint64(self.bits)
        halves = ids if self.width == 1 else (ids[0] << shift | ids[1], ids[2] << shift | ids[3])
        return permute(halves[0], halves[1], self.half)

    def unpack(self, upper: np.ndarray, lower: np.ndarray) -> list[np.ndarray]:
        """All four ids."""
        upper, lower = restore(upper, lower, self.half)
        if self.width == 1:
            return [upper, lower, *[np.zeros(len(upper), np.uint64)] * 2]
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        return [upper >> shift, upper & mask, lower >> shift, lower & mask]

    def write(self, upper: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> Iterator[list]:
        """A row of ``FILTERS`` for each quotient of a sorted filter."""
        quotients = upper >> np.uint64(self.rest)
        starts = np.flatnonzero(np.diff(quotients.astype(np.int64), prepend=-1)).tolist()
        rest = upper & np.uint64((1 << self.rest) - 1)
        for i, j in zip(starts, [*starts[1:], len(upper)], strict=True):
            n = counts[i:j]
            yield [
                int(quotients[i]),
                narrow(rest[i:j], self.upper_bytes),
                narrow(lower[i:j], self.lower_bytes),
                np.minimum(n, 255).astype(np.uint8).tobytes(),
                n[n >= 255].astype("<i8").tobytes(),
            ]

    def read(self, quotient: int, upper: bytes, lower: bytes, counts: bytes, large: bytes) -> tuple:
        n = np.frombuffer(counts, np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(large, "<i8")
        high = np.uint64(quotient << self.rest)
        return widen(upper, self.upper_bytes) | high, widen(lower, self.lower_bytes), n


def map_place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a pair of ids stands in the map of frequent pairs."""
    return (permute(first, second, 32)[0] >> np.uint64(32 - MAP)).astype(np.int64)


def phrases_of(ids: np.ndarray, width: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Runs of words of a sequence of ids, where 0 is none, a column each: pairs, or with ``width`` 2 three and four words
    all of whose pairs are in the map ``frequent``."""
    here = ids[:-1].astype(bool) & ids[1:].astype(bool)
    if width == 1:
        at = np.flatnonzero(here)
        return np.array([ids[at], ids[at + 1]], np.uint64).reshape(2, -1)
    at = np.flatnonzero(here)
    place = map_place(ids[at], ids[at + 1])
    here[at] = frequent[place >> 3] >> (place & 7).astype(np.uint8) & 1
    found = []
    for n in range(3, LONGEST + 1):
        # a phrase of n words holds n - 1 pairs
        start = np.flatnonzero(np.logical_and.reduce([here[k : len(here) - n + 2 + k] for k in range(n - 1)]))
        rows = [ids[start + k] if k < n else np.zeros(len(start), np.uint64) for k in range(LONGEST)]
        found.append(np.array(rows, np.uint64).reshape(LONGEST, -1))
    return np.concatenate(found, axis=1)


def number_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``ids binary``: the texts of a block as ids, 0 for a rarer word and the end of a piece."""
    pairs = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    own = pairs.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "at", "id")
    back = own.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("x"))
    back = back.select("block", F.col("x.at").alias("at"), F.col("x.id").alias("ids"))
    out = arrow_schema("ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                places = np.frombuffer(batch.column(0)[n].as_py(), "<u4")
                at, ids = (batch.column(k)[n].values.to_numpy(zero_copy_only=False) for k in (1, 2))
                table = np.zeros(int(places.max(initial=0)) + 1, np.uint32)
                # places of the words in the array count from 0, those in the texts from 1
                table[at.astype(np.int64) + 1] = ids
                yield pa.RecordBatch.from_arrays([pa.array([table[places].astype("<u4").tobytes()], out[0].type)], schema=out)

    return blocks.select("block", "places").join(back, "block").select("places", "at", "ids").mapInArrow(run, "ids binary")


def block_filters(numbered: DataFrame, layout: Layout, frequent=None, pending: int = PENDING) -> DataFrame:
    """``numbered(ids)`` to rows of ``FILTERS``; a task merges what its blocks hold before it sends."""
    out = arrow_schema(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            return summed(*(np.concatenate(x) for x in zip(*held, strict=True)), layout.half)

        def rows():
            table = list(zip(*layout.write(*merged()), strict=True))
            if table:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(table, out, strict=True)], schema=out)

        known = frequent and np.frombuffer(frequent.value, np.uint8)
        for batch in batches:
            for n in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[n].as_py(), "<u4").astype(np.uint64)
                packed = layout.pack(phrases_of(ids, layout.width, known))
                held.append(summed(*packed, np.ones(len(packed[0]), np.int64), layout.half))
                size += len(held[-1][0])
                if size >= pending:
                    held = [merged()]
                    size = len(held[0][0])
                if size >= 2 * pending // 3:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    return numbered.mapInArrow(run, FILTERS)


def merge_filters(filters: DataFrame, layout: Layout, least: int = LEAST) -> DataFrame:
    """``PHRASES`` that reach ``least`` over all filters."""
    out = arrow_schema(PHRASES)

    def run(table: pa.Table) -> pa.Table:
        parts = [layout.read(*row.values()) for row in table.to_pylist()]
        upper, lower, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)), layout.half)
        often = n >= least
        columns = [*layout.unpack(upper[often], lower[often]), n[often]]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return filters.groupBy("quotient").applyInArrow(run, PHRASES)


def pair_map(pairs: DataFrame) -> bytes:
    """A map of the frequent pairs, ``2 ** MAP`` bits at any size: it may let a rarer pair through, never hold a frequent one back."""
    schema = "chunk int, bits binary"
    out = arrow_schema(schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP - 3, np.uint8)
        for batch in batches:
            place = map_place(*(c.to_numpy(zero_copy_only=False).astype(np.uint64) for c in batch.columns))
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        chunks = bits.reshape(-1, 1 << CHUNK - 3)
        used = np.flatnonzero(chunks.any(1))
        columns = [used, [chunks[k].tobytes() for k in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def joined(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()]
        return pa.table([table["chunk"][:1], pa.array([np.bitwise_or.reduce(rows).tobytes()], out[1].type)], schema=out)

    total = np.zeros((1 << MAP - CHUNK, 1 << CHUNK - 3), np.uint8)
    parts = pairs.select("w1", "w2").mapInArrow(local, schema).groupBy("chunk").applyInArrow(joined, schema)
    for row in parts.collect():  # 2 ** (MAP - CHUNK) rows at most
        total[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return total.tobytes()


def frequent_phrases(blocks: DataFrame, words: DataFrame, least: int = LEAST, run: int = RUN) -> DataFrame:
    """Exact counts of all phrases of 2 to 4 words that reach ``least``: pairs first, then what only frequent pairs make up."""
    spark = blocks.sparkSession
    bounds = words.agg(F.max("id").alias("most"), F.sum("f").alias("n")).first()
    if bounds["most"] is None:
        return spark.createDataFrame([], PHRASES)
    bits = int(bounds["most"]).bit_length()
    numbered = settle(number_words(blocks, words), "numbered-blocks")
    layout = Layout(bits, 1, max(4, (bounds["n"] // run).bit_length()))
    pairs = settle(merge_filters(block_filters(numbered, layout), layout, least), "pairs")
    often = pairs.agg(F.sum("f").alias("n")).first()["n"]
    if often is None:
        return pairs
    layout = Layout(bits, 2, max(4, (2 * often // run).bit_length()))
    frequent = spark.sparkContext.broadcast(pair_map(pairs))
    longer = settle(merge_filters(block_filters(numbered, layout, frequent), layout, least), "phrases")
    return pairs.unionAll(longer)


# ------------------------------------------------------------------ scores


def exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def keyed(names: list[str], values: list[str | None]) -> list[Column]:
    return [(F.col(v) if v else F.lit(0).cast("long")).alias(n) for n, v in zip(names, values, strict=True)]


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``w1..w4, a, l, r, score`` of the lowest-scoring cut, the smallest of equal ones."""
    singles = words.select(*keyed(IDS, ["id", None, None, None]), "f")
    parts = phrases.unionByName(singles).filter("w4 = 0")
    left, right = ["l1", "l2", "l3"], ["r1", "r2", "r3"]
    cuts = []
    for k in range(1, LONGEST):
        first = [IDS[i] if i < k else None for i in range(3)]
        rest = [IDS[k + i] if k + i < LONGEST else None for i in range(3)]
        cuts.append(F.struct(F.lit(k).alias("k"), *keyed(left, first), *keyed(right, rest)))
    rows = phrases.select(*IDS, F.col("f").alias("a"), F.explode(F.filter(F.array(*cuts), lambda c: c["r1"] > 0)).alias("cut"))
    rows = rows.select(*IDS, "a", "cut.*")
    for names, alias in ((left, "l"), (right, "r")):
        side = parts.select(*(F.col(i).alias(n) for i, n in zip(IDS, names, strict=False)), F.col("f").alias(alias))
        rows = rows.join(side, names)
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy(*IDS, "a").agg(best).select(*IDS, "a", "best.l", "best.r", "best.score")


def outlying(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Phrases that lie in no longer one that is at least ``inside`` percent as common."""
    short = ["s1", "s2", "s3"]
    runs = []
    for size in (2, 3):
        for start in range(LONGEST - size + 1):
            run = [IDS[start + i] if i < size else None for i in range(3)]
            # a run of two in the first three words lies in any longer phrase, the others in one of four words
            proper = F.lit(True) if size == 2 and start + size <= 3 else F.col("w4") > 0
            runs.append(F.when(proper, F.struct(*keyed(short, run))))
    held = phrases.filter("w3 > 0").select("f", F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())).alias("x"))
    most = held.select("x.*", "f").groupBy(*short).agg(F.max("f").alias("longer"))
    here = [F.col(i) == F.col(s) for i, s in zip(IDS, short, strict=False)]
    covered = exact("longer") * 100 >= exact("f") * inside
    rows = phrases.join(most, [*here, F.col("w4") == 0], "left")
    return rows.filter(~F.coalesce(covered, F.lit(False))).select(*IDS, "f")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    blocks = settle(word_blocks(docs), "word-blocks")
    words = numbered_words(blocks, least)
    phrases = frequent_phrases(blocks, words, least)
    kept = scored(phrases, words).join(outlying(phrases, inside).select(*IDS), IDS, "left_semi")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("lang").agg(F.sum(total).alias("n"))
    places = F.filter(F.array(*(F.struct(F.lit(k).alias("at"), F.col(i).alias("id")) for k, i in enumerate(IDS))), lambda p: p["id"] > 0)
    spelled = (
        kept.withColumn("p", F.explode(places))
        .select(*kept.columns, "p.*")
        .join(words.select("id", "lang", "word"), "id")
        .groupBy(*kept.columns)
        .agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("p"))
        .withColumn("phrase", F.concat_ws(" ", "p.word"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return mine(docs)


def oracle() -> str:
    """The contract in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS n, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS p "
        f"FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM words WHERE len(ws) >= {n})"
        for n in range(1, LONGEST + 1)
    )
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
grams AS ({grams}),
counted AS MATERIALIZED (SELECT lang, n, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT lang, n, p, f AS a, string_split(p, ' ') AS ws FROM counted WHERE n > 1),
cuts AS (
  SELECT lang, n, p, a, k, array_to_string(list_slice(ws, 1, k), ' ') AS p1, array_to_string(list_slice(ws, k + 1, n), ' ') AS p2
  FROM (SELECT *, unnest(range(1, n)) AS k FROM candidates)),
scores AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.p1 JOIN counted y ON y.lang = c.lang AND y.p = c.p2),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, a, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM (SELECT *, unnest(range(2, n)) AS m FROM candidates WHERE n > 2))),
covers AS (SELECT lang, p, max(a) AS longer FROM inner_runs GROUP BY lang, p),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.p) AS rank, s.p AS phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN covers c ON c.lang = s.lang AND c.p = s.p
  WHERE c.longer IS NULL OR 100::HUGEINT * c.longer < {INSIDE} * s.a)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""
