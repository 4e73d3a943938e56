"""SimHash near-duplicate groups by tiled exact comparison.

One 64-bit fingerprint per text; two texts are linked when theirs differ in at most ``radius`` bits.
The distinct fingerprints are laid out in tiles by the population counts of their four 16-bit quarters.
Counts of a quarter can differ by no more than the bits that differ in it, so a pair of tiles whose
counts differ by more than the radius in sum holds no link and is never formed. The others are compared
completely, by numpy exclusive-or and bit counts. A pair of tiles gives a spanning forest of its links,
not all of them.

Nothing is capped: a cell with many fingerprints becomes several tiles, and all of these are compared.

* null text: like the empty one, fingerprint zero; * empty table: empty result; * repeated rows: each gets
a row; * null ``doc_id``: linked as any other, never the id of a component unless no row has an id.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import connected_components, map_batches
from quotemill.session import settle

SEED = 42
TILE = 512
SLICE = 1 << 15


def fingerprint(text: str | bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles: a bit is set if it is set in over half of their hashes."""
    if not text:
        return 0
    raw = text.encode() if isinstance(text, str) else text
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        pairs = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
        hashes = np.array([digest(line[i:j], SEED) for i, j in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``; the fingerprint as a signed long."""

    def setup():
        return lambda ids, texts: (ids, [signed(fingerprint(text, width)) for text in texts])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), setup, "doc_id long, fp long")


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles, as index pairs into ``a`` and ``b``."""
    label = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    step = max(1, (1 << 20) // max(1, len(b)))
    links = []
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if same:
            near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = False
        for row in np.flatnonzero(near.any(1)).tolist():
            i, hits = at + row, np.flatnonzero(near[row])
            roots, first = np.unique(label[hits + shift], return_index=True)
            for root, j in zip(roots.tolist(), hits[first].tolist(), strict=True):
                if label[i] != root:
                    links.append((i, j))
                    label[label == root] = label[i]
    return links


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the fingerprints that the full comparison connects.

    ``fps(fp)`` holds distinct fingerprints.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    cell = sum((quarter[k] * 17**k for k in range(1, 4)), quarter[0]).cast("int")
    placed = fps.select("fp", cell.alias("cell"))
    # at most 17^4 cells whatever the input
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = settle(
        placed.join(F.broadcast(parts), "cell")
        .groupBy("cell", F.pmod(F.hash("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("fps")),
        "simhash-tiles",
    )
    moves = [m for m in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, m)) <= radius and m >= (0, 0, 0, 0)]
    here = [F.floor(F.col("cell") / 17**k).cast("int") % 17 for k in range(4)]
    move = F.explode(F.array(*(F.array(*map(F.lit, m)) for m in moves)))
    left = (
        tiles.select("cell", "part", "fps", *(h.alias(f"h{k}") for k, h in enumerate(here)), move.alias("move"))
        .withColumns({f"t{k}": F.col(f"h{k}") + F.col("move")[k] for k in range(4)})
        .filter(" and ".join(f"t{k} between 0 and 16" for k in range(4)))
        .select(
            F.col("cell").alias("from_cell"),
            F.col("part").alias("from_part"),
            F.col("fps").alias("a"),
            F.expr("t0 + 17 * t1 + 289 * t2 + 4913 * t3").alias("cell"),
        )
    )
    # only cells that exist travel further
    left = left.join(F.broadcast(parts.select("cell")), "cell", "left_semi")
    pairs = left.join(tiles, "cell").filter("cell <> from_cell or from_part <= part")
    pairs = pairs.select("a", F.col("fps").alias("b"), F.expr("cell = from_cell and part = from_part").alias("same"))

    def setup():
        def work(lefts, rights, sames):
            u, v = [], []
            for left_fps, right_fps, same in zip(lefts, rights, sames, strict=True):
                a = np.array(left_fps, np.int64)
                b = np.array(right_fps, np.int64)
                for i, j in tile_links(a.view(np.uint64), b.view(np.uint64), radius, same):
                    u.append(int(a[i]))
                    v.append(int(b[j]))
            return u, v

        return work

    return map_batches(pairs, setup, "u long, v long", rows=64)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the smallest id that links reach."""
    marked = settle(fingerprints(docs, width), "simhash-docs")
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), radius), "simhash")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    lows = rooted.filter("linked").groupBy("root").agg(F.min("low").alias("component_low"))
    named = settle(
        rooted.join(lows, "root", "left").select("fp", F.coalesce("component_low", "low").alias("component_id")),
        "simhash-named",
    )
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns, and of which of them are null."""
    columns = [docs[f"`{name}`"] for name in docs.columns]
    hashed = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)]
    return F.xxhash64(*hashed, *(c.isNull() for c in columns))


def keep_rows(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """One whole row of each component: of the smallest id, null ids last, and of the smallest hash of the row among those.

    ``marked(doc_id, row, node)`` has a line for each row of ``docs``, ``roots(node, root)`` the nodes that are linked.
    """
    rows = marked.groupBy("node", "doc_id", "row").agg(F.count("*").alias("n_rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "n_rows")).alias("first")
    nodes = rows.groupBy("node").agg(first).join(roots, "node", "left")
    winners = settle(
        nodes.groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("won_id"), F.col("first.row").alias("won_row"), F.col("first.n_rows").alias("won_rows")),
        "dedup-winners",
    )
    key = row_hash(docs)
    kept = []
    for repeated in (False, True):
        # as many winners as documents, nearly: the same shuffled join at every size, without sorting texts
        ids = winners.filter("won_rows > 1") if repeated else winners.filter("won_rows = 1").hint("shuffle_hash")
        found = docs.join(ids, docs["doc_id"].eqNullSafe(ids["won_id"]) & (key == ids["won_row"]), "left_semi")
        if repeated:
            found = found.groupBy(found["doc_id"], row_hash(found)).agg(F.first(F.struct("*")).alias("one")).select("one.*")
        kept.append(found)
    return kept[0].unionAll(kept[1])


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One whole row of each group, decided by each row's own text whatever its id."""

    def setup():
        return lambda ids, rows, texts: (ids, rows, [signed(fingerprint(text, width)) for text in texts])

    columns = docs.select(F.col("doc_id").cast("long"), row_hash(docs).alias("row"), F.col("text").cast("binary"))
    marked = settle(map_batches(columns, setup, "doc_id long, row long, node long"), "simhash-rows")
    classes = settle(marked.select(F.col("node").alias("fp")).distinct(), "simhash-classes")
    return keep_rows(docs, marked, connected_components(links(classes, radius), "simhash"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
