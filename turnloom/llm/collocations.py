"""Phrase collocation mining by Toivonen's method: a sample proposes, full passes count exactly.

Phrases of one to `LONGEST` words within a piece of text are counted by language. A phrase occurs no
more often than the phrases inside it, so it can be frequent only if both phrases one word shorter
are (Apriori).

1. A sample of the documents is mined level by level at a lowered threshold. What is frequent there
   is proposed; its negative border is every other phrase whose two shorter phrases are proposed.
2. All words are counted, then the proposed phrases and the border: the full pass is two jobs, so that
   a task holds less.
3. A frequent phrase of the border is a failure of the sample: longer phrases over it were never
   counted. Then a further pass counts all phrases that may still be frequent: those not counted yet
   whose parts each were counted and are frequent, or were not counted and may be frequent. That
   closes the border: whatever is left out has a part that was counted and is not frequent.
4. Frequent phrases are spelled by joins: a phrase is counted under the hash of all its words but the
   last and the hash of the last, and words are counted by their text.

Tests of membership in a set of phrases use a filter of `FILTER_WORDS * 64` bits, broadcast at this
size whatever the corpus. A phrase let through by chance is one more that is counted; none is missed.
Hashes have 64 bits, so counts are exact unless two frequent phrases, or two words or phrases in one
task, share one. Tasks sum their counts before they are shuffled.

Null texts are empty, a null language is `und`, ids may be null or repeat. Repeated rows count each
time. Texts of any length are read whole. Equal scores are ordered by count and phrase. An empty
table gives an empty result; only id, text and language are read, whatever the names of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .storage import forget, stored

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
SAMPLE_OF = 8  # one document in so many is in the sample
LOWERED = 0.4  # the sample's threshold, of what MIN_COUNT comes to there
FILTER_WORDS = 1 << 20
SLICE_BYTES = 1 << 19  # text counted at once in a task; a longer single text is counted alone
TALLY = 1 << 18  # different phrases whose counts a task holds before it hands them on
BATCH_ROWS = 1 << 15  # counts handed on together
SALTS = 64
UNKNOWN = "und"

_ENDS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])  # where pieces end
WORDS = B._table(bytes([0x20, 0x09, *_ENDS]))
ENDS = ~B._table(_ENDS)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: phrases of k words, of which the first k - 1 have the hash p and the last has w. Single words have a name, language and word with a tab between;
#: k = 0 is a language's number of words
_COUNTED = "k int, name string, p long, w long, n long"
FOUND = "k int, h long, p long, w long, lang string, phrase string, n long"


def _joined(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all its words but the last, and the last."""
    return B.mix(p * _STEP + w)


def _word_hashes(words: pa.Array) -> np.ndarray:
    data, at = B.texts(words)
    return B.span_hashes(data, at[:-1], at[1:])


def _mask(h: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return one << (h >> np.uint64(20) & np.uint64(63)) | one << (h >> np.uint64(26) & np.uint64(63)) | one << (h >> np.uint64(32) & np.uint64(63))


@dataclass
class PhraseFilter:
    """A set of hashes: all that were put in are found, and a few others."""

    bits: np.ndarray

    @classmethod
    def of(cls, hashes: DataFrame) -> PhraseFilter:
        """Of rows of FOUND; at most FILTER_WORDS rows reach the driver."""
        bit = lambda k: f"shiftleft(1L, cast(shiftrightunsigned(h, {k}) & 63 as int))"
        words = hashes.filter("k > 0").groupBy(F.expr(f"h & {FILTER_WORDS - 1}").alias("word")).agg(F.expr(f"bit_or({bit(20)} | {bit(26)} | {bit(32)})").alias("bits")).toArrow()
        out = np.zeros(FILTER_WORDS, np.uint64)
        out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return cls(out)

    def holds(self, h: np.ndarray) -> np.ndarray:
        mask = _mask(h)
        return self.bits[h & np.uint64(FILTER_WORDS - 1)] & mask == mask


class Slice:
    """Words of some texts, and hashes of the phrases that begin at each of them."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = B.texts(texts)
        self.data = B.lower(raw)
        self.words = B.words(self.data, offsets, WORDS)
        start, end, row, first = self.words
        ends = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(ENDS[self.data], out=ends[1:])
        own = ends[start]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
        self.piece = np.cumsum(fresh)
        self.word = B.span_hashes(self.data, start, end)
        self.lang = _word_hashes(langs)[row]
        self.hashes = [_joined(self.lang, self.word)]

    def phrases(self, k: int) -> np.ndarray:
        """Hashes of the phrases of k words, by first word. Phrases across pieces are among them."""
        while len(self.hashes) < k:
            last, n = self.hashes[-1], len(self.hashes)
            self.hashes.append(_joined(last[:-1], self.word[n:]))
        return self.hashes[k - 1]

    def within(self, k: int) -> np.ndarray:
        """Which phrases of k words lie in one piece."""
        return self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1] if len(self.piece) >= k else np.zeros(0, bool)

    def text(self, at: np.ndarray) -> pa.Array:
        """The words at the given places."""
        start, size = self.words.start[at], self.words.end[at] - self.words.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(start - offsets[:-1], size) + np.arange(int(offsets[-1]))]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))

    def possible(self, k: int, known: PhraseFilter) -> np.ndarray:
        """Phrases of k words whose two shorter phrases are known."""
        there = known.holds(self.phrases(k - 1))
        return there[:-1] & there[1:] & self.within(k)


class Tally:
    """Counts of phrases of k words by hash, merged now and then, with what else is handed on of each."""

    def __init__(self, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, list[pa.Array]]] = []
        self.size = 0

    def add(self, own: Slice, langs: pa.Array, at: np.ndarray) -> None:
        """The phrases that begin at the given words."""
        if not len(at):
            return
        hashes, first, counts = np.unique(own.phrases(self.k)[at], return_index=True, return_counts=True)
        at = at[first]
        if self.k == 1:
            held = [pc.binary_join_element_wise(langs.take(pa.array(own.words.row[at])), own.text(at), "\t")]
        else:
            held = [pa.array(x.view(np.int64)) for x in (own.phrases(self.k - 1)[at], own.word[at + self.k - 1])]
        self.parts.append((hashes, counts, held))
        self.size += len(hashes)

    def merge(self) -> None:
        if len(self.parts) > 1:
            hashes, first, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64)
            held = [pa.concat_arrays(x).take(pa.array(first)) for x in zip(*(p[2] for p in self.parts))]
            self.parts = [(hashes, counts, held)]
        self.size = sum(len(p[0]) for p in self.parts)

    def handed_on(self, most: int) -> Iterator[pa.RecordBatch]:
        """The counts, where they are of more than `most` hashes."""
        if self.size > most:
            self.merge()
            if self.size > most // 2:
                [(hashes, counts, held)], self.parts, self.size = self.parts, [], 0
                n = len(hashes)
                named = [held[0], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())] if self.k == 1 else [pa.nulls(n, pa.string()), *held]
                made = pa.RecordBatch.from_arrays([pa.array(np.full(n, self.k, np.int32)), *named, pa.array(counts)], names=["k", "name", "p", "w", "n"])
                for at in range(0, n, BATCH_ROWS):
                    yield made.slice(at, BATCH_ROWS)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for batch in batches:
        for piece in B.slices(batch, "text", size):
            yield piece, Slice(piece.column("text"), piece.column("lang"))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND from counts: hashes, and language and word of single words."""
    for batch in batches:
        k = batch.column("k").to_numpy()
        names = [("", "", "") if i > 1 else (n, "", "") if i == 0 else n.rpartition("\t") for i, n in zip(k.tolist(), batch.column("name").to_pylist())]
        lang = pa.array([x[0] for x in names], pa.string())
        phrase = pa.array([x[2] for x in names], pa.string())
        single, none = k == 1, k == 0
        p, w = (pc.fill_null(batch.column(c), 0).to_numpy().view(np.uint64) for c in ("p", "w"))
        p, w = np.where(single, _word_hashes(lang), p), np.where(single, _word_hashes(phrase), w)
        h = _joined(p, w)
        given = [pc.if_else(pa.array(single), phrase, None), *(pa.array(x.view(np.int64)) for x in (h, p, w))]
        lang = pc.if_else(pa.array(single | none), lang, None)
        yield pa.RecordBatch.from_arrays([batch.column("k"), *given[1:], lang, given[0], batch.column("n")], names=["k", "h", "p", "w", "lang", "phrase", "n"])


def frequent(docs: DataFrame, levels: list[int], known: PhraseFilter | None, found: PhraseFilter | None, least: int, what: str) -> DataFrame:
    """A stored table (FOUND) of the phrases that occur `least` times or more, of those counted now.

    Without `found`, counted are all words, if level 1 is asked for, and the phrases made possible by
    `known`. With it, those count as done, `found` says which of them are frequent, and counted are
    all others that may be. With level 1 each language's number of words is a row as well.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, found))

    def chosen(own: Slice) -> Iterator[tuple[int, np.ndarray]]:
        known, found = sent.value
        may = found.holds(own.phrases(1)) if found else None
        for k in levels:
            if k == 1:
                yield k, np.arange(len(own.word))
                continue
            done = own.possible(k, known)
            if found is None:
                yield k, np.flatnonzero(done)
                continue
            may = may[:-1] & may[1:] & own.within(k)
            yield k, np.flatnonzero(may & ~done)
            may &= ~done | found.holds(own.phrases(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {k: Tally(k) for k in levels}
        totals: dict[str, int] = {}
        for piece, own in _pieces(batches, SLICE_BYTES):
            langs = piece.column("lang")
            for lang, n in zip(langs.to_pylist(), np.diff(own.words.first).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            for k, at in chosen(own):
                tallies[k].add(own, langs, at)
                yield from tallies[k].handed_on(TALLY)
        for tally in tallies.values():
            yield from tally.handed_on(0)
        if 1 in levels and totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(totals, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(totals.values(), pa.int64())], names=["k", "name", "p", "w", "n"])

    counted = docs.select("text", "lang").mapInArrow(run, _COUNTED).groupBy("k", "name", "p", "w").agg(F.sum("n").alias("n"))
    return stored(counted.filter((F.col("n") >= least) | (F.col("k") == 0)).mapInArrow(_spelled, FOUND), what)


def proposed(docs: DataFrame, min_count: int) -> PhraseFilter:
    """A filter of the phrases that are frequent in a sample of the documents, told by a hash of their ids."""
    sample = stored(docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLE_OF)) == 0).select("text", "lang"), "phrase-sample")
    least = max(2, int(min_count / SAMPLE_OF * LOWERED))
    levels = [frequent(sample, [1], None, None, least, "phrase-proposals")]
    while len(levels) < LONGEST and not levels[-1].filter("k > 0").isEmpty():
        levels.append(frequent(sample, [len(levels) + 1], PhraseFilter.of(levels[-1]), None, least, "phrase-proposals"))
    out = PhraseFilter.of(reduce(DataFrame.unionByName, levels))
    forget(sample, *levels)
    return out


def failures(found: DataFrame, known: PhraseFilter) -> DataFrame:
    """Frequent phrases that longer ones could be made of but that `known` lacks."""
    sent = found.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h[~sent.value.holds(h.view(np.uint64))], pa.int64())], names=["h"])

    return found.filter(F.col("k").between(1, LONGEST - 1)).select("h").mapInArrow(run, "h long")


def mined(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, k, phrase, n) of all frequent phrases with their counts, and (lang, n) of all words of a language.

    Sample, full pass, and a pass that closes the border where the sample failed; then phrases are
    spelled, each as one frequent phrase and one more frequent word.
    """
    known = proposed(docs, min_count)
    longer = list(range(2, LONGEST + 1))
    tables = [frequent(docs, [1], None, None, min_count, "words-found"), frequent(docs, longer, known, None, min_count, "phrases-found")]
    counted = tables[0].unionByName(tables[1])
    if not failures(counted, known).isEmpty():
        tables.append(frequent(docs, longer, known, PhraseFilter.of(counted), min_count, "phrases-found"))
    every = reduce(DataFrame.unionByName, tables)
    words = tables[0].filter("k = 1")
    last = words.select("lang", "w", F.col("phrase").alias("last"))
    levels = [words.select("lang", "k", "h", "phrase", "n")]
    for k in range(2, LONGEST + 1):
        begun = levels[-1].select("lang", F.col("h").alias("p"), F.col("phrase").alias("begun"))
        own = every.filter(F.col("k") == k).select("k", "h", "p", "w", "n").join(begun, "p").join(last, ["lang", "w"])
        levels.append(stored(own.select("lang", "k", "h", F.concat_ws(" ", "begun", "last").alias("phrase"), "n"), "phrases-spelled"))
    counts = stored(reduce(DataFrame.unionByName, levels).drop("h"), "phrase-counts")
    totals = stored(tables[0].filter("k = 0").select("lang", "n").coalesce(1), "phrase-totals")  # a row for each language
    forget(*tables, *levels[1:])
    return counts, totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score): the lowest-scoring cut of every phrase of two words or more."""
    words = F.split("phrase", " ")
    phrases = counts.filter("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    parts = phrases.select("lang", "k", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(w, cut + 1, k), ' ')").alias("right"))
    known = counts.filter(F.col("k").between(1, LONGEST - 1))
    both = parts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    whole = both.join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return whole.groupBy("lang", "k", "phrase", "a", "n").agg(best).select("lang", "k", "phrase", "a", "best.l", "best.r", "n", "best.score")


def maximal(counts: DataFrame) -> DataFrame:
    """(lang, phrase): phrases that some longer frequent phrase holds and equals in count.

    What a longer phrase holds and equals, the phrase one word longer inside it equals too, so only
    the two phrases one word shorter need to be looked at.
    """
    longer = counts.filter("k >= 3").select("lang", "k", "n", F.split("phrase", " ").alias("w"))
    inner = F.explode(F.expr("array(array_join(slice(w, 1, k - 1), ' '), array_join(slice(w, 2, k - 1), ' '))"))
    return longer.select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counts, totals = mined(slim, min_count)
    kept = scored(counts, totals).join(maximal(counts), ["lang", "phrase"], "left").filter("longer is null or longer < a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of many parts of a language, then the first of those: no language is sorted in one task
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    parts = kept.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k))) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS p, array_to_string(list_slice(w, cut + 1, k), ' ') AS q FROM (
  SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2)),
scores AS (SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score, cut
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.p = l.phrase JOIN f r ON c.lang = r.lang AND c.q = r.phrase JOIN totals t ON c.lang = t.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, s AS phrase, max(a) AS m FROM (SELECT lang, a, unnest(list_transform(range(1, 3), lambda i: array_to_string(list_slice(string_split(phrase, ' '), i, i + k - 2), ' '))) AS s FROM f WHERE k >= 3) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM best b LEFT JOIN longer g ON b.lang = g.lang AND b.phrase = g.phrase WHERE m IS NULL OR m < a) WHERE rank <= 2000"""
