"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A leaf covers ``LEAF`` blank-separated units (see ``units``) and holds its length in characters and its
number of ids; the inner nodes of a perfect binary tree hold the sums of both. An edit finds its leaves by
descending the character sums. Only these leaves are encoded again, and with them as many neighbours as
it takes for both borders of the changed stretch to be borders of units again; then the sums on the way to the
root are updated. Everything else keeps its counts.

A text that cannot be cut into units is one leaf.

* null text: empty, no ids; edits outside the text are cut to it; edits that overlap an earlier one (by start,
then end) are left out and not counted; * very long text: a tree of its length over ``LEAF`` units;
* repeated rows: each gets a row; * empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema, once_per_worker
from quotemill.llm.units import UnitEncoder, byte_bpe

LEAF = 32
# units kept by a worker; two workers of a task hold some, one for the trees and one for the edits
UNITS = 320_000
EDIT = "array<struct<start: int, stop: int, text: string>>"
TREE = "chars array<long>, ids array<long>"


def build(text: str, cut: list[str] | None, counts: list[int] | None, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Character and id sums in heap order: the root is at 1, the leaves fill the second half."""
    if cut is None or counts is None:
        leaf_chars, leaf_ids = [len(text)], [whole]
    else:
        sizes = np.array([len(part) + 1 for part in cut])
        sizes[0] -= 1
        starts = np.arange(0, len(cut), LEAF)
        leaf_chars, leaf_ids = np.add.reduceat(sizes, starts), np.add.reduceat(np.array(counts), starts)
    width = 1 << max(0, len(leaf_chars) - 1).bit_length()
    chars, ids = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
    chars[width : width + len(leaf_chars)], ids[width : width + len(leaf_ids)] = leaf_chars, leaf_ids
    while width > 1:
        for tree in (chars, ids):
            tree[width // 2 : width] = tree[width : 2 * width].reshape(-1, 2).sum(1)
        width //= 2
    return chars, ids


def find(chars: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds character ``place`` and the place where it begins."""
    node, start = 1, 0
    while node < len(chars) // 2:
        node *= 2
        if place >= start + chars[node] and chars[node + 1]:
            start += int(chars[node])
            node += 1
    return node - len(chars) // 2, start


def border(text: str, place: int) -> bool:
    """Whether ids left and right of ``place`` do not depend on each other."""
    if place <= 0 or place >= len(text):
        return True
    return not text[place - 1].isspace() and text[place] == " " and place + 1 < len(text) and not text[place + 1].isspace()


def recount(text: str, chars: np.ndarray, ids: np.ndarray, edits: list[dict], encode) -> tuple[str, int, int, int]:
    """Apply edits to text and tree: the new text, its number of ids, edits applied, characters encoded.

    ``chars`` and ``ids`` are updated in place.
    """
    chosen, last = [], 0
    for edit in sorted(edits, key=lambda e: (e["start"], e["stop"])):
        start, stop = max(0, min(edit["start"], len(text))), max(0, min(edit["stop"], len(text)))
        if start >= last and stop >= start:
            chosen.append((start, stop, edit["text"] or ""))
            last = stop
    if not chosen:
        return text, int(ids[1]), 0, 0
    new, shifts, at = [], [], 0
    for start, stop, put in chosen:
        new += (text[at:start], put)
        at = stop
        shifts.append((stop, len(put) - (stop - start)))
    after = "".join(new) + text[at:]
    half = len(chars) // 2
    leaves = np.flatnonzero(chars[half:])
    n_leaves = int(leaves[-1]) + 1 if len(leaves) else 1
    old_starts = np.concatenate(([0], np.cumsum(chars[half : half + n_leaves])))
    stops, deltas = np.array([s for s, _ in shifts]), np.cumsum([0] + [d for _, d in shifts])

    def moved(place: int) -> int:
        """Where an old place that no edit covers lies now; text put in at the place itself goes left of it."""
        return place + int(deltas[np.searchsorted(stops, place, side="right")])

    # stretches of leaves that edits touch, widened to clean borders
    touched: list[list[int]] = []
    for start, stop, _ in chosen:
        low, high = find(chars, start)[0], find(chars, max(start, stop - 1))[0]
        # a change next to a border touches the leaf on its other side
        low -= low > 0 and start <= old_starts[low] + 1
        high += high + 1 < n_leaves and stop >= old_starts[high + 1]
        if touched and low <= touched[-1][1]:
            touched[-1][1] = max(touched[-1][1], high)
        else:
            touched.append([low, high])
    n = 0
    while n < len(touched):
        low, high = touched[n]
        if low > 0 and not border(after, moved(int(old_starts[low]))):
            touched[n][0] -= 1
        elif high + 1 < n_leaves and not border(after, moved(int(old_starts[high + 1]))):
            touched[n][1] += 1
        else:
            if n and touched[n - 1][1] >= touched[n][0]:
                touched[n - 1] = [touched[n - 1][0], max(touched[n - 1][1], high)]
                del touched[n]
                n -= 1
            else:
                n += 1
    encoded = 0
    for low, high in touched:
        begin = 0 if low == 0 else moved(int(old_starts[low]))
        end = len(after) if high + 1 >= n_leaves else moved(int(old_starts[high + 1]))
        # the first leaf of the stretch takes all of it
        encoded += end - begin
        for leaf, size, count in [(low, end - begin, encode(after[begin:end])), *((k, 0, 0) for k in range(low + 1, high + 1))]:
            node = half + leaf
            more, grown = size - chars[node], count - ids[node]
            while node:
                chars[node] += more
                ids[node] += grown
                node //= 2
    return after, int(ids[1]), len(chosen), encoded


LONG_NUMBER = re.compile(r"\d[\d .()-]{5,}\d")


def cleaning_edits(text: str) -> list[dict]:
    """The edits of the query: mask long numbers, and cut lines that repeat an earlier one."""
    edits = [{"start": m.start(), "stop": m.end(), "text": "<number>"} for m in LONG_NUMBER.finditer(text)]
    if "\n" in text:
        seen, at = set(), 0
        for line in text.split("\n"):
            if line in seen and line:
                edits.append({"start": at - 1, "stop": at + len(line), "text": ""})
            seen.add(line)
            at += len(line) + 1
    return edits


def trees(docs: DataFrame, spec: str) -> DataFrame:
    """``docs`` with the columns ``chars`` and ``ids`` of their trees (columns of these names are replaced)."""
    base = docs.drop("chars", "ids")
    shared, key = docs.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    place, schema = base.columns.index("text"), f"{TREE}"
    whole_schema = base.schema.fields

    from pyspark.sql.types import StructType

    out_type = StructType([*whole_schema, *StructType.fromDDL(schema).fields])
    out = arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(("byte_bpe", key), lambda: byte_bpe(shared.value, limit=UNITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                made = [build(*parts) for parts in counted(encoder, piece.column(place).to_pylist())]
                new = [pa.array([m[k] for m in made], out.field(len(whole_schema) + k).type) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], schema=out)

    return base.mapInArrow(run, out_type)


def counted(encoder: UnitEncoder, texts: list[str | None]) -> Iterator[tuple]:
    """``build``'s arguments for each text; the number of ids of each unit."""
    blobs, cuts = encoder.batch(texts)
    for text, blob, cut in zip(texts, blobs, cuts, strict=True):
        total, counts = len(blob) // 4, None
        if cut is not None:
            counts = [0, *(len(encoder.known[part]) // 4 for part in cut[1:])]
            counts[0] = total - sum(counts)
        yield text or "", cut, counts, total


def apply_edits(grown: DataFrame, spec: str, keep_text: bool = True) -> DataFrame:
    """``(doc_id, text, chars, ids, edits)`` to counts before and after, the new text and the new tree."""
    shared, key = grown.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    schema = "doc_id long, n_tokens long, n_edits int, n_tokens_after long, n_chars_after long, n_chars_encoded long"
    schema += f", text_after string, {TREE}" if keep_text else ""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(("byte_bpe", key), lambda: byte_bpe(shared.value, limit=UNITS))

        def size(text: str) -> int:
            """Ids of a stretch: its units are mostly known."""
            return len(encoder.batch([text])[0][0]) // 4

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    text = row["text"] or ""
                    chars, ids = np.array(row["chars"], np.int64), np.array(row["ids"], np.int64)
                    before = int(ids[1])
                    after, n, applied, encoded = recount(text, chars, ids, row["edits"] or [], size)
                    rows.append((row["doc_id"], before, applied, n, len(after), encoded, after, chars, ids)[: len(out)])
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return grown.select(F.col("doc_id").cast("long"), "text", "chars", "ids", "edits").mapInArrow(run, schema)


def with_cleaning_edits(docs: DataFrame) -> DataFrame:
    find_edits = F.pandas_udf(lambda texts: texts.map(lambda t: cleaning_edits(t or "")), EDIT)
    return docs.withColumn("edits", find_edits("text"))


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    return apply_edits(with_cleaning_edits(trees(docs.select("doc_id", "text"), spec)), spec, keep_text=False)
