"""Token ids as files of canonical, length-limited Huffman codes.

1. The documents are sorted by id over the whole cluster; each task encodes its range and cuts it into
   blocks of whole documents.
2. The ids are counted over all blocks. Package-merge gives the best code lengths up to ``LONGEST`` bits.
   The counts and lengths are bounded by the vocabulary, so they may pass through the driver.
3. Each block becomes one row of the files: its documents, their numbers of ids, the packed bits, and the
   bit offset of every ``STRIDE``-th id. The code lengths are a file of their own.
4. Reading decodes each block by itself: a table of ``2^LONGEST`` entries gives id and length for the next
   bits; all checkpoints of a block advance together, one id a step.

Files are Parquet rows written by Spark, so that any store and a repeated task are safe; files of a
lower number hold smaller ids.

* null text: empty, only the end id; * null ``doc_id``: first in order; * repeated rows: each is written,
in any order among equals; * a very long text: one block of its own; * empty table: empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema, once_per_worker
from quotemill.llm.units import byte_bpe
from quotemill.session import scratch_path

LONGEST = 20
STRIDE = 256
BLOCK = 1 << 17
UNITS = 1_400_000  # kept in a worker: about 200 MB
END = 0

BLOCKS = "part int, block int, start long, doc_ids array<long>, counts array<int>, ids binary"
FILES = "part int, block int, start long, doc_ids array<long>, counts array<int>, checkpoints array<long>, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best lengths of a prefix code with no word over ``longest`` bits (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("more ids than code words")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    levels, merged = [], weight
    leaf = np.ones(len(used), bool)
    for _ in range(longest - 1):
        levels.append(leaf)
        packs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weight, packs))
        order = np.argsort(both, kind="stable")
        merged, leaf = both[order], order < len(used)
    levels.append(leaf)
    take, total = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        total[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = total
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by id, from the lengths alone: shorter first, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        if len(ids):
            code <<= length - last
            last = length
            codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
            code += len(ids)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, most significant first, and the bit offset of every ``STRIDE``-th."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    length = lengths[ids].astype(np.int64)
    end = np.cumsum(length)
    start = end - length
    word, over = start >> 6, (end + 63 >> 6) - 1
    room = 64 - (start & 63) - length
    code = codes[ids]
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros(int(over[-1]) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.add.reduceat(high, first)
    split = np.flatnonzero(room < 0)
    words[over[split]] |= code[split] << (64 + room[split]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], start[::STRIDE]


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for every value of the next bits."""
    longest = int(lengths.max(initial=1)) or 1
    ids, sizes = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    span = np.left_shift(1, longest - lengths[order].astype(np.int64))
    filled = int(span.sum())
    ids[:filled] = np.repeat(order, span)
    sizes[:filled] = np.repeat(lengths[order], span)
    return ids, sizes, longest


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ``n`` ids of a block; the pieces between checkpoints are decoded side by side."""
    ids, sizes, longest = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.array(checkpoints, np.int64)
    out = np.zeros((len(at), STRIDE), np.uint32)
    last = n - STRIDE * (len(at) - 1)
    for step in range(STRIDE if len(at) > 1 else last):
        if step == last and len(at) > 1:
            at = at[:-1]
        place = at >> 3
        peek = (ahead[place] << (at & 7).astype(np.uint32)) >> np.uint32(32 - longest)
        out[: len(at), step] = ids[peek]
        at = at + sizes[peek]
    return out.reshape(-1)[:n]


def encode_blocks(docs: DataFrame, spec: str, parts: int) -> DataFrame:
    """Blocks of ids in document order; ``start`` counts from the first id of the part."""
    placed = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    vocabulary, key = docs.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(("byte_bpe_marks", key), lambda: byte_bpe(vocabulary.value, marks=True, limit=UNITS))
        part, block, start, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, counts, pieces = [], [], []
        end = np.array([END], np.uint32).tobytes()

        def flush():
            raw = np.frombuffer(b"".join(pieces), np.uint32)
            raw = raw.astype(np.uint16) if len(encoder.opens[" "]) <= 1 << 16 else raw
            row = [[part], [block], [start], [ids], [counts], [raw.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                names, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                for name, found in zip(names, encoder.batch(texts)[0], strict=True):
                    pieces += (found, end)
                    ids.append(name)
                    counts.append(len(found) // 4 + 1)
                    size += counts[-1]
                    if size >= BLOCK:
                        yield flush()
                        block, start, size = block + 1, start + size, 0
                        ids, counts, pieces = [], [], []
        if ids:
            yield flush()

    return placed.mapInArrow(run, BLOCKS)


def raw_ids(blob: bytes, counts: list[int]) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if len(blob) < 4 * sum(counts) else np.uint32)


def count_ids(blocks: DataFrame) -> DataFrame:
    """``(id, n)``: counted in each task first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                found = np.bincount(raw_ids(batch.column(1)[row].as_py(), batch.column(0)[row].as_py()))
                short, long_ = sorted((total, found), key=len)
                total = long_.astype(np.int64)
                total[: len(short)] += short
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    partial = blocks.select("counts", "ids").mapInArrow(run, "id long, n long")
    return partial.groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, spec: str, path: str, parts: int | None = None) -> None:
    """Write the ids of every document below ``path``: ``code`` (lengths) and ``blocks``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = scratch_path(spark, "token-blocks")
    encode_blocks(docs, spec, parts).write.option("compression", "zstd").parquet(work)
    blocks = spark.read.schema(BLOCKS).parquet(work)
    counted = count_ids(blocks).collect()  # a row per id of the vocabulary
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    shift, base = 0, {}
    sizes = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    for r in blocks.groupBy("part").agg(F.sum(sizes).alias("n")).orderBy("part").collect():  # a row per part
        base[r["part"]] = shift
        shift += r["n"]
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), base))
    schema = arrow_schema(FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_length, codes, bases = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                bits, checkpoints = pack(raw_ids(row["ids"], row["counts"]), code_length, codes)
                start = row["start"] + bases[row["part"]]
                new = [row["part"], row["block"], start, row["doc_ids"], row["counts"], checkpoints, bits]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(new, schema, strict=True)], schema=schema)

    blocks.mapInArrow(run, FILES).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, emit, schema: str) -> DataFrame:
    """Decode the files; ``emit(doc_ids, starts, arrays of ids)`` makes the columns of ``schema``."""
    (row,) = spark.read.parquet(f"{path}/code").collect()
    lengths = np.frombuffer(row["lengths"], np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value, canonical(shared.value))
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = unpack(row["bits"], row["checkpoints"], int(counts.sum()), table)
                ends = np.cumsum(counts)
                made = emit(row["doc_ids"], row["start"] + ends - counts, np.split(ids, ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, out, strict=True)], schema=out)

    return spark.read.schema(FILES).parquet(f"{path}/blocks").mapInArrow(run, schema)


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as file:
        write_ids(docs, file.read(), path)

    def emit(names, starts, arrays):
        return names, starts, [len(a) for a in arrays], [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]

    return read_ids(spark, path, emit, "doc_id long, start long, n_tokens long, ids_crc32 long")
