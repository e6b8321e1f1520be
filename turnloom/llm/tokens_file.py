"""Token-id files: one id array over all documents with Elias-Fano encoded document boundaries.

A file holds a run of documents in ascending order: the boundaries (where each document ends) as an
Elias-Fano sequence, then the ids as little-endian unsigned 32-bit integers. The boundaries' high
parts are a unary bit vector and their low parts are packed bits, so n documents over u ids take
about n * (2 + log2(u / n)) bits. Select on the high bits returns an offset: a directory of 32-bit
numbers, stored with the file, says where every `SELECT_EVERY`-th set bit lies, and the bytes from
there are counted. Files hold `DOCS_PER_FILE` documents at most and are written by the tasks of a range
partitioning; where a file starts in the whole sequence is a prefix sum over one row per file.

Null and empty texts are a document of the end id alone. Documents with equal ids
are ordered by a hash of their text, then by the text, repeated rows being equal. A null doc_id sorts first. An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .pieces import RememberedPieces, Vocabulary, byte_symbols, pieces
from .storage import stored

END_ID = 2
MAGIC = b"TIDS\x01\x00\x00\x00"
DOCS_PER_FILE = 256
SELECT_EVERY = 64
REMEMBERED_BYTES = 40 << 20  # of pieces and ids, in each of two generations
TEXT_BYTES = 1 << 20  # text encoded together in a task; a longer single text is encoded alone


class EliasFano:
    """A non-decreasing sequence of numbers in [0, bound]."""

    def __init__(self, count: int, bound: int, high: np.ndarray, low: np.ndarray, places: np.ndarray):
        self.count, self.bound, self.high, self.low, self.places = count, bound, high, low, places
        self.width = self.low_bits(count, bound)

    @staticmethod
    def low_bits(count: int, bound: int) -> int:
        return max(0, (bound // count).bit_length() - 1) if count else 0

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        count = len(values)
        width = cls.low_bits(count, bound)
        values = values.astype(np.int64)
        bits = np.zeros(count + (bound >> width) + 1, np.uint8)
        ones = (values >> width) + np.arange(count)
        bits[ones] = 1
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel() if width else np.zeros(0, np.uint8)
        return cls(count, bound, np.packbits(bits, bitorder="little"), np.packbits(low, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values at the given places: where the k-th set bit lies gives the high part."""
        which = np.asarray(which, np.int64)
        at = self.places[which // SELECT_EVERY].astype(np.int64) if len(which) else which
        byte = at >> 3
        masked = self.high[byte] & (0xFF << (at & 7)).astype(np.uint8)  # bits from the directory's place on
        rest = which % SELECT_EVERY  # set bits to pass over
        held = np.bitwise_count(masked).astype(np.int64)
        while (on := np.flatnonzero(rest >= held)).size:
            rest[on] -= held[on]
            byte[on] += 1
            masked[on] = self.high[byte[on]]
            held[on] = np.bitwise_count(masked[on])
        bits = (masked[:, None] >> np.arange(8)) & 1
        place = np.argmax((np.cumsum(bits, axis=1) == (rest + 1)[:, None]) & (bits == 1), axis=1)
        high = byte * 8 + place - which
        if not self.width:
            return high
        at = which[:, None] * self.width + np.arange(self.width)
        low = (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return (high << self.width) | low

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.count, self.bound, len(self.high)) + self.places.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        count, bound, high = struct.unpack_from("<QQQ", data, at)
        at += 24
        low, places = (cls.low_bits(count, bound) * count + 7) // 8, -(-count // SELECT_EVERY)
        bits = at + 4 * places
        return cls(count, bound, np.frombuffer(data, np.uint8, high, bits), np.frombuffer(data, np.uint8, low, bits + high), np.frombuffer(data, "<u4", places, at)), bits + high + low


def pack(documents: list[bytes]) -> bytes:
    """A file of documents, each the bytes of its ids."""
    ends = np.cumsum([len(d) // 4 for d in documents])
    return MAGIC + EliasFano.of(ends, int(ends[-1]) if len(ends) else 0).to_bytes() + b"".join(documents)


def unpack(data: bytes) -> tuple[EliasFano, memoryview]:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    ends, at = EliasFano.from_bytes(data, len(MAGIC))
    return ends, memoryview(data)[at:]


def documents(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """Where each document of a file starts, and the bytes of its ids."""
    ends, ids = unpack(data)
    stops = ends.select(np.arange(ends.count)).tolist()
    for a, b in zip([0, *stops], stops):
        yield a, ids[4 * a : 4 * b]


class Encoder:
    """The tokenizers library's model on single words, whose pattern and normal form are the vocabulary's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.symbols = dict(enumerate(byte_symbols()))
        self.vocabulary = Vocabulary(path)
        self.vocabulary.ids, self.vocabulary.merges = {}, []  # the model holds them
        self.known = RememberedPieces(self.vocabulary, self.word, {})

    def word(self, word: str) -> bytes:
        """The ids of a word; the model reads a symbol for each of its bytes."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8", "replace").decode("latin-1").translate(self.symbols)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Bytes of the ids of each text."""
        if self.known.size > REMEMBERED_BYTES:
            old, self.known.old = self.known, {}
            self.known = RememberedPieces(self.vocabulary, self.word, old)
        get = self.known.__getitem__
        return [b"".join(map(get, pieces(t))) for t in texts]


_LOADED: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _LOADED:
        _LOADED[name] = Encoder(SparkFiles.get(name))
    return _LOADED[name]


def _encoded(name: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    last = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            for piece in B.slices(batch, "text", TEXT_BYTES):
                ids = [b + last for b in encoder.encode(piece.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column("part"), piece.column("doc_id"), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return run


def in_order(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text) in ascending doc_id order over the parts of a range partitioning.

    Only ids and hashes are sampled for the ranges; the hash parts rows that share an id.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    ordered = hashed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    return ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, ids) of one part as files."""
    chunk = 0
    for batch in batches:
        for k in range(0, batch.num_rows, DOCS_PER_FILE):
            piece = batch.slice(k, DOCS_PER_FILE)
            found = piece.column("ids").to_pylist()
            numbers = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [piece.column("part").slice(0, 1), pa.array([chunk], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([sum(map(len, found)) // 4], pa.int64()), numbers, pa.array([pack(found)], pa.binary())],
                names=["part", "chunk", "n_docs", "n_ids", "doc_ids", "data"],
            )
            chunk += 1


def write_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes documents (part, doc_id, text), which are in order within each part, and writes them as files.

    One row per file: part, chunk, n_docs, n_ids, doc_ids of the file and the file's bytes. A part is
    encoded and cut into files as it streams by, so no task holds more than a file and the text of it.
    """
    docs.sparkSession.sparkContext.addFile(path)
    encode = _encoded(os.path.basename(path), end_id)
    schema = f"part int, chunk int, n_docs long, n_ids long, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, data binary"
    return stored(docs.mapInArrow(lambda batches: _cut(encode(batches)), schema), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """Ids before each file: a prefix sum in two steps, over the files of a part and over one row per part."""
    heads = files.select("part", "chunk", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    return heads.withColumn("inner", inner).join(before, "part").select("part", "chunk", (F.col("before") + F.col("inner")).alias("file_start"))


def read_files(files: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Places inside a file come from its boundaries; only these slim rows meet the files' starts.
    """
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["part", "chunk", "doc_id", "place", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [(a, len(b) // 4, zlib.crc32(b)) for a, b in documents(batch.column("data")[row].as_py())]
                where = [pa.array([batch.column(c)[row].as_py()] * len(found), pa.int32()) for c in ("part", "chunk")]
                columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*where, batch.column("doc_ids")[row].values, *columns], names=names)

    read = files.select("part", "chunk", "doc_ids", "data").mapInArrow(run, f"part int, chunk int, doc_id {kind}, place long, n_tokens long, ids_crc32 long")
    return read.join(file_starts(files), ["part", "chunk"]).select("doc_id", (F.col("file_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_file_report(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, writes the files, and reads every document back from them."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read_files(write_files(in_order(slim), path))
