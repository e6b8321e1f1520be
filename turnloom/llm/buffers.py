"""Words, word hashes and shingles of many texts at once, on the bytes of an Arrow string column.

All separators used by the operators are ASCII bytes, and every byte of a non-ASCII character in
UTF-8 is above 0x7F, so splitting bytes gives the same words as splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text handled at once in a task; a longer single text is a slice of its own


def _table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: `[^\x20\x09-\x0D]+`
BLANK_WORDS = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
PLAIN_WORDS = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    """Words of a slice: the first and last byte (exclusive), the row, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into pieces of about `limit` text bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of every row; no word crosses a row."""
    rows = len(offsets) - 1
    inside = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False  # a row starts afresh
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(start, end, row, first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans hash equally in every process."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    full = np.flatnonzero(size)
    begin = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(begin, size)
    power = np.cumprod(np.full(int(size.max()) + 1, _BASE, dtype=np.uint64))
    value = (data[np.repeat(start, size) + within].astype(np.uint64) + np.uint64(1)) * power[within]
    out = np.zeros(len(start), np.uint64)
    if len(full):
        out[full] = np.add.reduceat(value, begin[full])
    return mix(out + size.astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of n words and the first window of each row.

    With `short`, a row of one to n - 1 words has its whole sequence as one window.
    """
    count = np.diff(first)
    many = np.maximum(count - n + 1, 0)
    if short:
        many = np.where((count > 0) & (count < n), 1, many)
    at = np.zeros(len(first), np.int64)
    np.cumsum(many, out=at[1:])
    where = np.repeat(first[:-1] - at[:-1], many) + np.arange(int(at[-1]))
    width = np.repeat(np.minimum(count, n), many)
    value = np.full(len(where), np.uint64(n))
    for k in range(n):
        ok = width > k
        step = mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[np.minimum(where + k, len(hashes) - 1)] if len(hashes) else value)
        value = np.where(ok, step, value)
    return mix(value + width.astype(np.uint64)), at
