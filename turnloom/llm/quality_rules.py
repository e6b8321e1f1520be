"""Quality rules by compression bands, beside simple counts.

A text is rejected when its zstandard ratio (compressed size / size) lies outside the limits of its
length band, or when fixed chunks holding more than `CHUNK_SHARE` of its bytes lie outside the
limits of their own length: repetitive text compresses too well, encoded or random text too little.

Null and empty texts have no words, fail the base rule and are not kept. Very long texts are
compressed whole and chunk by chunk. Repeated rows are judged one by one; ties cannot occur; an
empty table gives an empty result; only the id and text columns are read, other columns pass through
`keep_good` unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B

LEVEL = 3
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.5
#: length band (bytes, exclusive upper end), lowest and highest ratio that passes
BANDS = [
    (256, 0.35, 1.10),
    (512, 0.30, 0.95),
    (1024, 0.28, 0.90),
    (2048, 0.26, 0.85),
    (4096, 0.24, 0.80),
    (8192, 0.22, 0.76),
    (16384, 0.21, 0.75),
    (1 << 62, 0.20, 0.74),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = 1
_BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def outside(size: int, ratio: float) -> bool:
    low, high = next((low, high) for end, low, high in BANDS if size < end)
    return not low <= ratio <= high


def bands(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of bytes in chunks outside their limits, and whether the text passes."""
    size = len(text)
    if not size:
        return 0.0, 0.0, False
    whole = len(compressor.compress(text)) / size
    if size <= CHUNK_BYTES:
        share = float(outside(size, whole))
    else:
        bad = 0
        for k in range(0, size, CHUNK_BYTES):
            chunk = text[k : k + CHUNK_BYTES]
            if outside(len(chunk), len(compressor.compress(chunk)) / len(chunk)):
                bad += len(chunk)
        share = bad / size
    return whole, share, not outside(size, whole) and share <= CHUNK_SHARE


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every text of a column."""
    data, offsets = B.texts(column)
    found = B.words(data, offsets, B.BLANK_WORDS)
    rows = len(offsets) - 1

    def by_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[offsets])

    hashes = B.span_hashes(data, found.start, found.end)
    value, first = B.windows(hashes, found.first, 3, short=False)
    row = np.repeat(np.arange(rows), np.diff(first))
    _, where, many = np.unique(B.mix(value ^ B.mix(row.astype(np.uint64))), return_inverse=True, return_counts=True)
    again = np.flatnonzero(many[where] > 1)
    word = found.first[row[again]] + again - first[row[again]]
    repeated = np.zeros(len(hashes), np.int64)
    for k in range(3):
        repeated[word + k] = 1
    return {
        "n_words": np.diff(found.first),
        "word_chars": by_row(B.BLANK_WORDS[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": by_row(SYMBOLS[data]),
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in column.to_pylist()], np.int64),
        "n_repeat_words": np.bincount(found.row, weights=repeated, minlength=rows).astype(np.int64),
    }


def _measure(pass_through: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for piece in B.slices(batch, text):
                values = piece.column(text)
                made = counts(values)
                judged = [bands(t.encode("utf-8", "replace") if t else b"", compressor) for t in values.to_pylist()]
                columns = [piece.column(c) for c in pass_through] + [pa.array(made[c], pa.int64()) for c in COUNTS]
                columns += [pa.array([j[k] for j in judged], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*pass_through, *COUNTS, "zstd_ratio", "bad_chunk_share", "bands_pass"])

    return run


_MADE = ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunk_share double, bands_pass boolean"


def _verdict(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("bands_pass"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: the counts, the compression figures, and the two verdicts. No shuffle."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return _verdict(slim.mapInArrow(_measure(["doc_id"], "text"), f"doc_id {kind}{_MADE}"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns of the input."""
    inner = [f"_c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*inner)
    at = inner[docs.columns.index(text)]
    schema = ", ".join(f"{c} {renamed.schema[c].dataType.simpleString()}" for c in inner)
    judged = _verdict(renamed.mapInArrow(_measure(inner, at), schema + _MADE))
    return judged.filter("kept").select(*inner).toDF(*docs.columns)
