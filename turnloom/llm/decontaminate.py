"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

A pattern is a window of benchmark words. Patterns of one length are searched together: a shift
table keyed by blocks of two words says how far the window may move without missing an occurrence,
the hash of the last block selects the patterns that may end here, and the words themselves are
compared before an occurrence counts.

The tables are sent to every executor, so they are compiled from at most `PASS_BYTES` of benchmark
text. Items are cut into parts that overlap by a window less one word, and a benchmark of more text
takes several passes over the unchanged documents. Of all passes but the last, only what was found is
stored, by the digest of the text; the last one adds it to what it finds itself. A document keeps its
hit words as spans without overlap and each item once.

Null or empty texts have no words and are never hit; repeated rows each get their own result; item
ids are compared as strings; items with a null id are named "null"; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .storage import forget, stored, with_perhaps

WINDOW = 10
PASS_BYTES = 8 << 20  # benchmark text searched for in one pass over the documents
TEXT_BYTES = 1 << 20  # text searched at once in a task; a longer single text is searched alone
PART_WORDS = 50_000  # words of an item that are searched for together
_SPANS = "array<struct<first:int,end:int>>"
#: words are runs of bytes other than 00-2F, 3A-60 and 7B-7F once A-Z is in lower case
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


class WuManber:
    """Shift table, suffix buckets and patterns for word sequences of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)

    def add(self, pattern: tuple[bytes, ...], items: tuple[str, ...]) -> None:
        for end in range(self.block, self.length + 1):
            key = pattern[end - self.block : end]
            self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
        self.bucket[pattern[-self.block :]].append((pattern, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """First word and items of every occurrence."""
        at, size, block, length, default, shift = self.length, len(words), self.block, self.length, self.default, self.shift.get
        blocks = list(zip(words, words[1:])) if block == 2 else [(w,) for w in words]
        while at <= size:
            key = blocks[at - block]
            step = shift(key, default)
            if step:
                at += step
                continue
            first = at - length
            candidate = None
            for pattern, items in self.bucket[key]:
                candidate = candidate or tuple(words[first:at])
                if pattern == candidate:
                    yield first, items
            at += 1


def compile_items(rows: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """Search tables for the windows of the given (item_id, text) rows."""
    by_pattern: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in rows:
        found = item_words(text)
        if found:
            for k in range(max(len(found) - window, 0) + 1):
                by_pattern[tuple(found[k : k + window])].add(item)
    tables: dict[int, WuManber] = {}
    for pattern, items in by_pattern.items():
        tables.setdefault(len(pattern), WuManber(len(pattern))).add(pattern, tuple(sorted(items)))
    return list(tables.values())


def _passes(benchmark: DataFrame, item_id: str, text: str, window: int) -> list[DataFrame]:
    """Parts of the items, dealt over passes of bounded text by their hash."""
    lowered = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), words.alias("words")).filter("size(words) > 0")
    begins = F.explode(F.expr(f"sequence(0, greatest(size(words) - {window}, 0), {PART_WORDS})")).alias("begin")
    parts = items.select("id", "words", begins).select("id", F.expr(f"array_join(slice(words, begin + 1, {PART_WORDS + window - 1}), ' ')").alias("part"))
    total = parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    passes = int(total // PASS_BYTES) + 1
    return [parts.filter(F.pmod(F.xxhash64("id", "part"), F.lit(passes)) == k) for k in range(passes)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that cover the same words without overlap, in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def occurrences(found: list[bytes], tables: list[WuManber], hits: list[tuple[int, int]], held: set[str]) -> tuple[list[dict], list[str]]:
    """Spans and items of the words `found`, those known already (`hits`, `held`) among them."""
    for table in tables:
        for first, owners in table.find(found):
            if hits and hits[-1][0] <= first <= hits[-1][1]:
                hits[-1] = (hits[-1][0], max(hits[-1][1], first + table.length))
            else:
                hits.append((first, first + table.length))
            held.update(owners)
    return [{"first": a, "end": b} for a, b in merged(hits)], sorted(held)


def hit_texts(docs: DataFrame, text: str, tables: Broadcast) -> DataFrame:
    """digest, spans and items of the different texts in which a pattern of `tables` occurs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch, text, TEXT_BYTES):
                digests, spans, names = [], [], []
                for value in piece.column(text):
                    own, items = occurrences(item_words(value.as_py()), tables.value, [], set())
                    if own:
                        digests.append(hashlib.sha256(value.as_buffer()).digest())
                        spans.append(own)
                        names.append(items)
                arrays = [pa.array(digests, pa.binary()), pa.array(spans, _ARROW_SPANS), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["digest", "spans", "items"])

    found = docs.select(text).mapInArrow(search, f"digest binary, spans {_SPANS}, items array<string>")
    return found.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))


def with_earlier(docs: DataFrame, text: str, earlier: list[DataFrame], into: str, items: str) -> DataFrame:
    """Adds what earlier passes found in a row's text; only rows that a bounded bitmap cannot clear are shuffled."""
    nothing = {into: F.lit(None).cast(_SPANS), items: F.lit(None).cast("array<string>")}
    if not earlier:
        return docs.withColumns(nothing)
    digest, flag = f"{into}_digest", f"{into}_perhaps"
    every = reduce(DataFrame.unionByName, earlier).groupBy(F.col("digest").alias(digest))
    every = every.agg(F.flatten(F.collect_list("spans")).alias(into), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items))
    every = stored(every, "window-hits")
    forget(*earlier)
    marked = with_perhaps(docs.withColumn(digest, F.unhex(F.sha2(F.col(text).cast("binary"), 256))), digest, every.select(digest), flag)
    hit = marked.filter(flag).join(every, digest, "left")
    return hit.unionByName(marked.filter(f"not {flag}").withColumns(nothing)).drop(digest, flag)


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "spans", keep_text: bool = True) -> DataFrame:
    """Adds `into`: the words hit, as positions [first, end) without overlap; `into`_items, the items found, and `into`_words.

    Without `keep_text` the text column ends here.
    """
    spark = docs.sparkSession
    items, words = f"{into}_items", f"{into}_words"
    send = lambda piece: spark.sparkContext.broadcast(compile_items([(r[0], r[1]) for r in piece.collect()], window))
    *firsts, last = _passes(benchmark, item_id, item_text, window)
    earlier = []
    for piece in firsts:
        sent = send(piece)
        earlier.append(stored(hit_texts(docs, text, sent), "pass-hits"))
        sent.destroy()
    out = with_earlier(docs, text, earlier, into, items).withColumn(words, F.lit(None).cast("long"))
    tables = send(last)
    kept = [c for c in out.columns if keep_text or c != text]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch, text, TEXT_BYTES):
                spans, names, counts = [], [], []
                for value, old, known in zip(piece.column(text), piece.column(into), piece.column(items), strict=True):
                    found = item_words(value.as_py())
                    own, held = occurrences(found, tables.value, [(s["first"], s["end"]) for s in old.as_py() or ()], set(known.as_py() or ()))
                    spans.append(own)
                    names.append(held)
                    counts.append(len(found))
                made = {into: pa.array(spans, _ARROW_SPANS), items: pa.array(names, pa.list_(pa.string())), words: pa.array(counts, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else piece.column(c) for c in kept], names=kept)

    return out.mapInArrow(search, out.select(kept).schema)


_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def covered(spans: Column) -> Column:
    """Number of words inside spans without overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: word and hit counts, items found, their digest, and whether any window occurs."""
    found = find_windows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, window=window, keep_text=False)
    return found.select(
        "doc_id",
        F.col("spans_words").alias("n_words"),
        covered(F.col("spans")).alias("n_hit"),
        F.array_sort("spans_items").alias("items"),
    ).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
