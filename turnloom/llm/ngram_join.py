"""Self-join of documents on the Jaccard similarity of their word shingles, heavy and light by size.

Texts with one shingle set are one class from the start. Light (small) sets enumerate their subsets
of the fixed size that a partner must share: sets that meet on a subset are linked, with nothing left
to verify. Heavy (large) sets are written to inverted lists, in an order that puts shingles shared
by many documents last: two linked sets share one of the first n - ceil(0.8 n) + 1. The size at which
sets turn heavy is where enumerating costs more than scanning lists does, measured on the input.

Only connected components are asked for, so a list is first scanned against its leader alone and the
leader's pairs are verified. The leader is the set whose shingles are the most common, as a text's are
that others were copied from. Then pairs of a list whose documents are still in different components
are met, where their first common shingle can stand at the places it has in both sets and their
parities do not rule them out, and verified. A set's parities are 1,024 bits, each telling whether the
elements that fall there are odd in number: two sets differ in at least as many elements as bits.
Before whole sets are compared, pairs are tried on parities of four bits an element and more.
No pair that may be linked is skipped, so the result is exact. Lists known to be long are dealt over
several tasks, each part with a leader of its own, and the parts' leaders are joined.

Null and empty texts (and texts without words) have no shingles, are linked with nothing and are
their own component; a text of one to four words is one shingle. A null doc_id gets a null component.
Repeated rows each get a row; rows that share a doc_id but not a text are each placed by their text.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .components import components
from .storage import forget, perhaps_in, stored

SHINGLE = 5
PERCENT = 80
SMALL_MOST = 16  # no set above this size is enumerated, whatever the costs
COUNT_WINDOW = 2_000_000  # shingles counted together in a task when looking for common ones
LOCAL_MIN = 4  # documents of a window that must hold a shingle for its count to be told
COMMON_MOST = 1 << 18  # common shingles known to every task: 4 MB at every size of input
SPLIT_CLASS = 10  # lists of 2^10 documents and more are dealt over several tasks
PARITIES = 16  # numbers of 64 bits that hold a set's parities


def required(n: int, m: int) -> int:
    """Least overlap of linked sets of n and m elements."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def partners(n: int) -> range:
    """Sizes of sets that a set of n elements may be linked with."""
    return range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)


def enumeration_cost(n: int) -> int:
    return sum(math.comb(n, required(n, m)) for m in partners(n) if required(n, m) <= n)


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every text, repeats included, and where each text's begin."""
    data, offsets = B.texts(column)
    data = B.lower(data)
    found = B.words(data, offsets, B.BLANK_WORDS)
    return B.windows(B.span_hashes(data, found.start, found.end), found.first, SHINGLE, short=True)


def _set_id(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents with the logarithm of their count, found by counting all documents.

    Tasks count the shingles of the different texts of a window and tell those of LOCAL_MIN documents
    or more; the sums' largest COMMON_MOST are kept. They only set the order of lists, so a shingle
    that no window tells costs time and never a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def told() -> pa.RecordBatch:
            value, many = np.unique(np.concatenate(held), return_counts=True)
            keep = many >= LOCAL_MIN
            return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(many[keep].astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for piece in B.slices(batch, "text"):
                value, first = shingle_hashes(piece.column("text"))
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = np.unique(value[a:b])
                    key = _set_id(own)
                    if b > a and key not in seen:
                        seen.add(key)
                        held.append(own)
                        size += len(own)
                if size >= COUNT_WINDOW:
                    yield told()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield told()

    told = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = told.orderBy(F.desc("c"), "h").limit(COMMON_MOST).toArrow()
    value = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(value)
    many = found.column("c").to_numpy()[order]
    return value[order], np.minimum(np.floor(np.log2(np.maximum(many, 1))).astype(np.uint64), np.uint64(30))


def ordered(value: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shingles as numbers whose order puts common ones last: the count class above 58 bits of the hash."""
    out = value >> np.uint64(6)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], value), len(common[0]) - 1)
        out = out | np.where(common[0][at] == value, common[1][at] << np.uint64(58), np.uint64(0))
    return out


def parities(own: np.ndarray, size: int = 64 * PARITIES) -> np.ndarray:
    """Whether the elements that fall on each of `size` bits are odd in number."""
    counts = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def long_parities(own: np.ndarray) -> np.ndarray:
    """Parities of at least four bits an element, a power of two."""
    return parities(own, 64 << max(len(own) // 16, 1).bit_length())


def parities_allow(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """Whether sets of n and m elements can have the overlap they need; longer parities are folded to the shorter ones' length."""
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * required(n, m)


def sets_allow(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """Whether two sets are linked."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (n + m - both)


def features(docs: DataFrame, common) -> DataFrame:
    """doc_id, n, set_id, the first elements of the set (all of a small one), its parities, and how common its elements are."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch, "text"):
                value, first = shingle_hashes(piece.column("text"))
                value = ordered(value, sent.value)
                sizes, ids, heads, bits, known = [], [], [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = np.unique(value[a:b])
                    n = len(own)
                    sizes.append(n)
                    ids.append(_set_id(own))
                    heads.append(own[: n if n <= SMALL_MOST else prefix_size(n)].view(np.int64))
                    bits.append(parities(own))
                    known.append(int((own >> np.uint64(58)).sum()) / max(n, 1))

                def lists(values: list[np.ndarray]) -> pa.Array:
                    counts = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(counts), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))

                arrays = [piece.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary()), lists(heads), lists(bits), pa.array(known, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "set_id", "head", "bits", "known"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, set_id binary, head array<bigint>, bits array<bigint>, known double")


def boundary(classes: DataFrame) -> int:
    """Size of the largest sets that enumerate subsets: the largest for which that costs less than scanning.

    Scanning costs the prefix times the mean length of a list that a small set meets.
    """
    keys = classes.filter(F.col("n") <= SMALL_MOST).select(F.explode(F.expr("slice(head, 1, cast(n - ceil(n * 0.8) + 1 as int))")).alias("key"))
    row = keys.groupBy("key").agg(F.count("*").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("mean")).first()
    mean = row["mean"] or 1.0
    best = 1
    for n in range(2, SMALL_MOST + 1):
        if enumeration_cost(n) <= prefix_size(n) * mean * n:  # a scanned candidate is verified element by element
            best = n
    return best


def light_edges(classes: DataFrame, most: int) -> DataFrame:
    """Links among sets of up to `most` elements, as stars: the sets that share a subset of the size their sizes ask for."""
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, low, high, which = [], [], [], []
            for row, (n, head) in enumerate(zip(batch.column("n").to_pylist(), batch.column("head").to_pylist(), strict=True)):
                for m in partners(n):
                    need = required(n, m)
                    if m > most or need > min(n, m):
                        continue
                    for subset in itertools.combinations(head, need):
                        keys.append(hashlib.blake2b(np.array(subset, np.int64).tobytes(), digest_size=16).digest())
                        low.append(min(n, m))
                        high.append(max(n, m))
                        which.append(row)
            at = pa.array(which, pa.int64())
            arrays = [pa.array(keys, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), batch.column("n").take(at), batch.column("v").take(at)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "low", "high", "n", "v"])

    small = classes.filter(F.col("n") <= most).select("v", "n", "head")
    subsets = small.mapInArrow(run, f"key binary, low int, high int, n int, v {kind}")
    leaders = subsets.groupBy("key", "low", "high").agg(F.min(F.when(F.col("n") == F.col("low"), F.col("v"))).alias("low_v"), F.min(F.when(F.col("n") == F.col("high"), F.col("v"))).alias("high_v"), F.count("*").alias("c")).filter("c > 1")
    met = subsets.join(leaders, ["key", "low", "high"])
    other = F.when(F.col("n") == F.col("low"), F.col("high_v")).otherwise(F.col("low_v"))
    return met.select(other.alias("a"), F.col("v").alias("b")).filter("a is not null and a <> b").distinct()


def shared_lists(classes: DataFrame, above: int) -> DataFrame:
    """Entries of the inverted lists with two documents or more: key, v, n, the key's place in the set, and the leader of the list's part."""
    least = -(-PERCENT * (above + 1) // 100)  # small sets that a heavy one may be linked with are listed too
    head = F.expr("slice(head, 1, cast(n - ceil(n * 0.8) + 1 as int))")
    entries = classes.filter(F.col("n") >= least).select("v", "n", F.col("known").cast("float").alias("known"), F.posexplode(head).alias("place", "key"))
    # the key tells how many documents hold it, so lists known to be long are cut before they meet in a task
    parts = F.expr(f"cast(shiftleft(1L, greatest(cast(shiftright(key, 58) as int) - {SPLIT_CLASS - 1}, 0)) as bigint)")
    window = Window.partitionBy("key", "part")
    led = entries.withColumn("part", F.pmod(F.xxhash64("v"), parts)).withColumn("lead", F.min(F.struct((-F.col("known")).alias("known"), "v", "n")).over(window)).withColumn("c", F.count("*").over(window))
    return led.filter((F.col("c") > 1) | (parts > 1)).select("key", "v", "n", "place", "lead")


def _sizes_allow(a: str, b: str) -> Column:
    return F.lit(100) * F.least(F.col(a), F.col(b)) >= F.lit(PERCENT) * F.greatest(F.col(a), F.col(b))


def _overlap_needed(n: str, m: str) -> str:
    """SQL: the least overlap of linked sets of n and m elements."""
    return f"cast(ceil({PERCENT} * ({n} + {m}) / {100 + PERCENT}) as int)"


def _parities_allow(x: str, y: str, n: str, m: str) -> Column:
    """Whether two sets can have the overlap they need: they differ where their parities do."""
    differ = " + ".join(f"bit_count(get({x}, {k}) ^ get({y}, {k}))" for k in range(PARITIES))
    return F.expr(f"{differ} <= {n} + {m} - 2 * {_overlap_needed(n, m)}")


def possible(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those that their sizes and parities do not rule out."""
    side = lambda v: classes.select(F.col("v").alias(v), F.col("n").alias(f"n_{v}"), F.col("bits").alias(f"bits_{v}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_allow("n_a", "n_b")).filter(_parities_allow("bits_a", "bits_b", "n_a", "n_b")).select("a", "b")


def compared(docs: DataFrame, pairs: DataFrame, shown: Callable[[np.ndarray], np.ndarray], allow: Callable[..., bool]) -> DataFrame:
    """Of stored pairs (a, b) of doc_ids, those that `allow` lets pass, given each set's size and what `shown` makes of it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = perhaps_in(docs.select("doc_id", "text"), "doc_id", ids).join(ids, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch, "text"):
                value, first = shingle_hashes(piece.column("text"))
                own = [np.unique(value[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(map(len, own), pa.int32()), pa.array([shown(s).tobytes() for s in own], pa.binary())], names=["doc_id", "n", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(batch.column(f"n_{k}").to_pylist(), [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(f"data_{k}")]) for k in "ab"]
            keep = [allow(n, x, m, y) for n, x, m, y in zip(*sides[0], *sides[1], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = stored(texts.mapInArrow(sets, f"doc_id {kind}, n int, data binary"), "sets")
    side = lambda k: found.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("data").alias(f"data_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "data_a", "n_b", "data_b")
    out = stored(both.mapInArrow(compare, f"a {kind}, b {kind}"), "pairs")
    forget(found)
    return out


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those whose texts' sets are similar enough: what the long parities let pass is compared whole."""
    pairs = stored(pairs, "pairs")
    near = compared(docs, pairs, long_parities, parities_allow)
    out = compared(docs, near, lambda own: own, sets_allow)
    forget(pairs, near)
    return out


def star_pairs(entries: DataFrame) -> DataFrame:
    """For every document, the leader it shares most lists with; and the leaders of a long list's parts, joined."""
    pairs = entries.select(F.col("lead.v").alias("a"), F.col("lead.n").alias("m"), F.col("v").alias("b"), "n").filter("a <> b")
    counted = pairs.filter(_sizes_allow("m", "n")).groupBy("a", "b").agg(F.count("*").alias("c"))
    best = counted.groupBy("b").agg(F.max(F.struct("c", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    split = entries.filter(F.shiftright("key", 58) >= SPLIT_CLASS).select("key", "lead").distinct()
    first = split.groupBy("key").agg(F.min("lead").alias("top"))
    tops = split.join(first, "key").select(F.col("top.v").alias("a"), F.col("top.n").alias("m"), F.col("lead.v").alias("b"), F.col("lead.n").alias("n"))
    counted = tops.filter("a <> b").filter(_sizes_allow("m", "n")).groupBy("a", "b").agg(F.count("*").alias("c"))
    return best.unionByName(counted.groupBy("b").agg(F.max(F.struct("c", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")).distinct()


def open_pairs(classes: DataFrame, entries: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of a list in different components that may be similar, without those already tried.

    Of linked sets of n and m elements that need an overlap of k, the first common element is among the
    first n - k + 1 of the one and the first m - k + 1 of the other. Lists of the same documents, as the
    shingles of a passage have them, are met as one list in which each document has its foremost place.
    """
    placed = entries.join(labels.withColumnRenamed("vertex", "v"), "v", "left").select("key", "v", "n", "place", F.coalesce("component", "v").alias("label"))
    same = F.struct(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(v))").alias("x"), F.expr("bit_xor(xxhash64(v, 1))").alias("y")).alias("list")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), same).filter("low <> high").select("key", "list")
    once = placed.join(mixed, "key").groupBy("list", "v").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.min("place").alias("place"))
    left = stored(once.join(classes.select("v", "bits"), "v"), "open-lists")
    names = ["v", "n", "place", "label", "bits"]
    x = left.select("list", *(F.col(c).alias(f"{c}_x") for c in names))
    y = left.select("list", *(F.col(c).alias(f"{c}_y") for c in names))
    need = _overlap_needed("n_x", "n_y")
    met = x.join(y, "list").filter("v_x < v_y and label_x <> label_y").filter(_sizes_allow("n_x", "n_y"))
    met = met.filter(f"place_x <= n_x - {need} and place_y <= n_y - {need}").filter(_parities_allow("bits_x", "bits_y", "n_x", "n_y"))
    pairs = met.select(F.col("v_x").alias("a"), F.col("v_y").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = stored(pairs.join(done, ["a", "b"], "left_anti"), "open-pairs")
    forget(left)
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(features(docs, common_shingles(docs)), "sets-heads")
    placed = rows.filter("n > 0 and doc_id is not null")
    classes = stored(placed.groupBy("set_id").agg(F.min("doc_id").alias("v"), *(F.first(c).alias(c) for c in ("n", "head", "bits", "known"))), "classes")
    most = boundary(classes)
    entries = stored(shared_lists(classes, most), "lists")
    tried = stored(star_pairs(entries), "stars")
    labels = components(light_edges(classes, most).unionByName(verified(docs, possible(classes, tried))))
    more = verified(docs, open_pairs(classes, entries, labels, tried))
    labels = components(labels.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(more))
    forget(entries, tried, more)
    named = classes.select("set_id", "v").join(labels, F.col("v") == F.col("vertex"), "left").select("set_id", F.coalesce("component", "v").alias("component_id"))
    out = rows.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
