"""Lines of text files by their position, with an index that lets a slice be read alone.

Files are cut into byte ranges. A range owns the lines that begin in it, and the index holds how many
those are: a count of line breaks, without decoding. Prefix sums over the ranges, in the order of path
and place, give each range the position of its first line, so a slice of positions is read from the
ranges that hold it and from no others. Every line has a position, one that cannot be parsed as well.

Lines end with a line feed; a carriage return before it is no part of the line. A gzipped file cannot
be entered in the middle, so it is one range. Empty files have no lines. A line may be longer than a
range; the range it begins in reads it to its end.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import running_total
from .folders import MOST_TASKS, files_of, folder_listing, opened

RANGE_BYTES = 64 << 20
_CHUNK = 1 << 20
_BATCH_BYTES = 4 << 20
_BATCH_LINES = 8192


def line_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, begin, end): byte ranges of files (path, size)."""
    step = F.when(F.endswith("path", F.lit(".gz")), F.col("size")).otherwise(F.lit(range_bytes).cast("long"))
    cut = files.filter("size > 0").select("path", "size", step.alias("step"))
    begun = cut.select("path", "size", "step", F.explode(F.expr("sequence(0L, size - 1, step)")).alias("begin"))
    return begun.select("path", "begin", F.least(F.col("begin") + F.col("step"), "size").alias("end"))


def _read(path: str) -> io.BufferedIOBase:
    store, name = opened(path)
    raw = store.open_input_file(name)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, _CHUNK)


def _count(path: str, begin: int, end: int) -> int:
    """Lines that begin in the range: at byte 0, and after each line break but the last byte's."""
    with _read(path) as file:
        if path.endswith(".gz"):
            total, last = 0, b"\n"
            while chunk := file.read(_CHUNK):
                total += chunk.count(b"\n")
                last = chunk[-1:]
            return total + (last != b"\n")
        at = max(begin - 1, 0)
        file.seek(at)
        total = int(begin == 0)
        while at < end - 1:
            chunk = file.read(min(_CHUNK, end - 1 - at))
            if not chunk:
                break
            total += chunk.count(b"\n")
            at += len(chunk)
        return total


def _lines(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin in the range, in order."""
    with _read(path) as file:
        if path.endswith(".gz"):
            yield from (line.rstrip(b"\n") for line in file)
            return
        at = begin
        if begin:
            file.seek(begin - 1)
            at = begin - 1 + len(file.readline())
        while at < end:
            line = file.readline()
            if not line:
                return
            at += len(line)
            yield line.rstrip(b"\n")


def line_index(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, begin, end, lines, first) of files (path, size): each range's lines and the position of the first of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_count(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["path", "begin", "end", "lines"])

    ranges = line_ranges(files, range_bytes)
    dealt = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)), "path", "begin")
    total = running_total(dealt.mapInArrow(counted, "path string, begin long, end long, lines long"), ["path", "begin"], "lines", "_until")
    return total.select("path", "begin", "end", "lines", (F.col("_until") - F.col("lines")).alias("first"))


def ranges_of(index: DataFrame, start: int, count: int) -> DataFrame:
    """The ranges of an index that hold lines of the positions [start, start + count)."""
    return index.filter((F.col("lines") > 0) & (F.col("first") < start + count) & (F.col("first") + F.col("lines") > start))


def read_lines(index: DataFrame, start: int, count: int) -> DataFrame:
    """(position, value) of the lines at positions [start, start + count). Other ranges are not opened."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        values: list[str] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["position", "value"])

        for batch in batches:
            for path, begin, end, first in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "first")), strict=True):
                for position, line in enumerate(_lines(path, begin, end), first):
                    if position >= start + count:
                        break
                    if position >= start:
                        places.append(position)
                        values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                        size += len(line)
                    if size > _BATCH_BYTES or len(places) >= _BATCH_LINES:
                        yield made()
                        places, values, size = [], [], 0
        yield made()

    wanted = ranges_of(index, start, count).select("path", "begin", "end", "first")
    return wanted.repartition(max(1, min(wanted.count(), MOST_TASKS)), "path", "begin").mapInArrow(read, "position long, value string")


def slice_lines(spark: SparkSession, folder: str, start: int, count: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(position, value) of the lines [start, start + count) of all files below a folder, in the order of their paths."""
    return read_lines(line_index(files_of(folder_listing(spark, folder)), range_bytes), start, count)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(position, the schema's fields, broken): lines as JSON; `broken` ones, blank ones among them, keep their position and have no fields."""
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = lines.select("position", parsed.alias("p"))
    broken = F.col("p").isNull() | F.col("p._broken").isNotNull()
    fields = [c for c in out.schema["p"].dataType.fieldNames() if c != "_broken"]
    return out.select("position", *(F.when(~broken, F.col(f"p.{c}")).alias(c) for c in fields), broken.alias("broken"))
