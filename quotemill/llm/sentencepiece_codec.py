"""SentencePiece models on the tokenizers library.

The model file is read as a protobuf message, and its normaliser, metaspace mark, pieces with scores and
byte fallback are rebuilt: a unigram model keeps its scores; a BPE model gets the merges that its scores
stand for (a pair is merged the earlier, the higher the score of what it makes). Texts are encoded in
batches by ``units.UnitEncoder``; with ``threads`` over 1 the library works on the new units of a batch in
that many threads.

Parity: every unit that a worker has not seen is encoded by the sentencepiece library too, and a text whose
units differ anywhere is reported. No piece has the mark after another character (else units are not used),
so equal units make equal texts.

* null or empty text: no ids, round trip and parity hold; * very long text: units of it, no quadratic
step; * repeated rows: each gets a row; * empty table: empty result; * other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import arrow_schema, once_per_worker
from quotemill.llm.units import UnitEncoder

MARK = "▁"
# Fixed values of the public protobuf schema: field numbers, and kinds of pieces and models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of each field of a protobuf message: whole numbers, or raw bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    extra_spaces: bool = True


def parse(raw: bytes) -> Model:
    model = Model()
    for number, value in fields(raw):
        if number == PIECES:
            entry = dict(fields(value))
            model.pieces.append(entry.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
            model.kinds.append(entry.get(3, NORMAL))
        elif number == TRAINER:
            entry = dict(fields(value))
            model.kind, model.byte_fallback = entry.get(3, UNIGRAM), bool(entry.get(35, 0))
        elif number == NORMALIZER:
            entry = dict(fields(value))
            model.char_map, model.dummy_prefix = entry.get(2, b""), bool(entry.get(3, 1))
            model.extra_spaces = not entry.get(4, 1)
    model.unknown = model.kinds.index(UNKNOWN)
    return model


def rebuild(model: Model):
    """A tokenizers ``Tokenizer`` that gives the ids of the model."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    ids = {piece: i for i, piece in enumerate(model.pieces)}
    if model.kind == BPE:
        usable = {p: model.scores[i] for p, i in ids.items() if model.kinds[i] in (NORMAL, USER)}
        merges = sorted(
            (
                (-usable[p], ids[p[:cut]], ids[p[cut:]], p[:cut], p[cut:])
                for p in usable
                for cut in range(1, len(p))
                if p[:cut] in usable and p[cut:] in usable
            ),
            key=lambda m: m[:3],
        )
        core = models.BPE(
            ids, [m[3:] for m in merges], unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    else:
        scored = list(zip(model.pieces, model.scores, strict=True))
        core = models.Unigram(scored, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if not model.extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if separable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]*"), "isolated")
    return tokenizer


def separable(model: Model) -> bool:
    """No piece holds the mark after another character, and the normaliser changes no text."""
    return not model.char_map and not any(MARK in p.lstrip(MARK) for p in model.pieces)


class Codec:
    """Encoder, decoder and parity check of one model, kept by the worker."""

    def __init__(self, raw: bytes, threads: int = 1):
        import sentencepiece

        self.model = parse(raw)
        self.tokenizer = rebuild(self.model)
        self.threads = threads
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.table = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode()
            for p, kind in zip(self.model.pieces, self.model.kinds, strict=True)
        ]
        opens = np.array([p.startswith(MARK) for p in self.model.pieces])
        whole = not (separable(self.model) and self.model.dummy_prefix and self.model.extra_spaces)
        odd = lambda text: whole or MARK in text
        self.units = UnitEncoder(self.encode, {" ": opens}, dummy=True, odd=odd, check=self.differing)

    def encode(self, text: str) -> list[int]:
        if self.threads < 2 or not separable(self.model) or "  " in text or MARK in text or len(text) < 1 << 14:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        # cut at blanks into a piece per thread; a piece after the first starts with its own mark
        step, cuts = len(text) // self.threads + 1, [0]
        while (cut := text.find(" ", cuts[-1] + step)) >= 0:
            cuts.append(cut + 1)
        parts = [text[i:j].removesuffix(" ") if j else text[i:] for i, j in zip(cuts, [*cuts[1:], None], strict=True)]
        return [i for e in self.tokenizer.encode_batch(parts, add_special_tokens=False) for i in e.ids]

    def differing(self, parts: list[str], found: list[bytes]) -> list[str]:
        expected = self.reference.encode(parts, num_threads=self.threads)
        return [p for p, a, b in zip(parts, expected, found, strict=True) if a != np.frombuffer(b, np.uint32).tolist()]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw[self.model.dummy_prefix and raw[:1] == b" " :].decode(errors="replace")

    def batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """Ids, whether they decode to the text, whether the sentencepiece library gives the same."""
        blobs, cuts = self.units.batch(texts)
        out = []
        for text, blob, cut in zip(texts, blobs, cuts, strict=True):
            ids, text = np.frombuffer(blob, np.uint32), text or ""
            if cut is None:
                same = self.reference.encode(text) == ids.tolist()
            else:
                same = not self.units.wrong or self.units.wrong.isdisjoint(cut)
            out.append((ids, self.decode(ids) == text, same))
        return out


def mapped(docs: DataFrame, model_path: str, schema: str, emit, threads: int = 1) -> DataFrame:
    with open(model_path, "rb") as file:
        raw = file.read()
    shared, key, out = docs.sparkSession.sparkContext.broadcast(raw), zlib.crc32(raw), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once_per_worker(("sentencepiece", key, threads), lambda: Codec(shared.value, threads))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                names, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                columns = emit(names, codec.batch(texts))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, threads: int = 1) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip, parity``."""

    def emit(names, found):
        return names, [f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]

    schema = "doc_id long, ids array<int>, n_tokens long, round_trip boolean, parity boolean"
    return mapped(docs, model_path, schema, emit, threads)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of ``(doc_id, ids)``."""
    with open(model_path, "rb") as file:
        raw = file.read()
    shared, key, out = encoded.sparkSession.sparkContext.broadcast(raw), zlib.crc32(raw), arrow_schema("doc_id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once_per_worker(("sentencepiece", key, 1), lambda: Codec(shared.value))
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0), out[0].type), pa.array(texts, out[1].type)], schema=out)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(docs: DataFrame, model_path: str) -> DataFrame:
    """A digest of ``encode``: the checksum of the ids as little-endian unsigned 32-bit integers."""

    def emit(names, found):
        sums = [zlib.crc32(f[0].tobytes()) for f in found]
        return names, [len(f[0]) for f in found], sums, [f[1] for f in found], [f[2] for f in found]

    return mapped(docs, model_path, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean", emit)
