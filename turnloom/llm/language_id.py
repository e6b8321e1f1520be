"""Language ID by the nearest of several centroids per language.

A text becomes a vector over hashed letter n-grams: runs of letters are words with a blank at either
end, and every letter gives the n-grams of one, two and three places around it. Weights are
(1 + log tf) * idf, scaled to length 1; document frequencies are counted over all rows that may be
learnt from. Rows of a language are clustered by cosine into `CLUSTERS` centroids. A text gets the
language of the centroid with the largest cosine. It is rejected where its distance, 1 - cosine, is
above what learnt texts of its length keep: shorter texts lie further off, so the limit goes by
bands of letters, and pieces cut from the sampled texts fill the lower bands.

Learnt from: at most about `SAMPLE_ROWS` rows of each language, chosen by a hash of their ids, of
texts up to `SAMPLE_BYTES`; that bounds what a clustering task holds. The model holds
`CLUSTERS * DIMS` numbers for each language, so it grows with languages, not with rows.

Null texts and texts without a letter are `und` with score 0 and are never learnt from; so are rows
without a language or an id (a null id is not held out). Texts of any length are read whole. Without
any learnable row every text is `und`. Ties go to the language that sorts first. Repeated rows get
equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buffers as B

UNKNOWN = "und"
DIMS = 1 << 14
CLUSTERS = 4
ROUNDS = 12  # of clustering, at most
SAMPLE_ROWS = 600  # rows of each language that centroids are made of, at every size of input
SAMPLE_BYTES = 24_000
PIECES = (12, 40, 120, 400)  # characters of the pieces cut from a sampled text
BANDS = np.array([8, 16, 32, 64, 128, 256, 512, 1024])  # letters
REJECT_QUANTILE = 0.999
TEXT_BYTES = 1 << 20  # text handled at once in a task; a longer single text is handled alone


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 2 for letters, 1 for marks, which go with letters, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams, three for each letter of the texts in order, and where each text's letters begin."""
    parts = [(t or "").lower().encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"\0\0\0\0" + b"".join(p + b"\0\0\0\0" for p in parts), dtype="<u4")
    kinds = _kinds()[codes]
    inside = kinds > 0
    keep = inside.copy()
    keep[0] = True
    keep[1:] |= inside[:-1]  # one blank after each run
    starts = 1 + np.cumsum([0, *(len(p) // 4 + 1 for p in parts)])
    row_has = np.add.reduceat(np.append(kinds == 2, False).astype(np.int64), starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum(inside)])[np.minimum(starts, len(codes))]
    x = np.where(inside, codes, 0)[keep].astype(np.uint32)
    at = np.flatnonzero(x)
    made = []
    with np.errstate(over="ignore"):
        one, two, three = x[at] * np.uint32(0x9E3779B1), x[at - 1] * np.uint32(0x85EBCA77), x[at + 1] * np.uint32(0xC2B2AE3D)
        for k, h in enumerate((one, one + two, one + two + three)):
            h = h + np.uint32(0x27D4EB2F) * np.uint32(k + 1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            made.append(h >> np.uint32(32 - DIMS.bit_length() + 1))
    grams = np.column_stack(made).astype(np.int32)
    # texts of marks alone have no letter
    for k in np.flatnonzero(~row_has):
        if first[k] < first[k + 1]:
            grams[first[k] : first[k + 1]] = -1
    return grams, first


def vectors(texts: list[str | None], idf: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """For each text: its letters, the n-grams that occur, and their weights (none without `idf`). 0 letters: nothing to tell."""
    grams, first = buckets(texts)
    for a, b in zip(first, first[1:]):
        own = grams[a:b].ravel()
        if not len(own) or own[0] < 0:
            yield 0, own[:0], None
            continue
        counts = np.bincount(own, minlength=DIMS)
        at = np.flatnonzero(counts)
        if idf is None:
            yield int(b - a), at, None
            continue
        v = (1 + np.log(counts[at])) * idf[at]
        yield int(b - a), at, (v / np.sqrt(v @ v)).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # a row for each n-gram, a column for each centroid
    langs: list[str]  # of each centroid
    limits: np.ndarray  # largest distance kept in each band

    def predict(self, at: np.ndarray, v: np.ndarray) -> tuple[str, float]:
        cosines = v @ self.centroids[at]
        best = int(np.argmax(cosines))
        return self.langs[best], float(min(max(cosines[best], 0.0), 1.0))


def document_frequencies(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all the texts each n-gram occurs, and how many texts have a letter. One row per n-gram leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for piece in B.slices(batch, text, TEXT_BYTES):
                for size, at, _ in vectors(piece.column(text).to_pylist(), None):
                    total[at] += 1
                    total[DIMS] += size > 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["gram", "n"])

    found = rows.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMS + 1, np.int64)
    out[found["gram"]] = found["n"]
    return out[:DIMS], int(out[DIMS])


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit rows by cosine: starts are the first row and then each time the row furthest from all before."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)) and near.min() < 0.999:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    before = None
    for _ in range(ROUNDS):
        owner = np.argmax(x @ centres.T, axis=1)
        if before is not None and (owner == before).all():
            break
        before = owner
        sums = np.stack([x[owner == j].sum(axis=0) if (owner == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres.astype(np.float32)


def _sampled_vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch, "text", TEXT_BYTES):
                langs, orders, texts, whole = [], [], [], []
                for lang, order, text in zip(*(piece.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                    places = [text, *(text[p : p + n] for n in PIECES for p in [order % max(len(text) - n, 1)] if len(text) > n)]
                    langs += [lang] * len(places)
                    orders += [order] * len(places)
                    texts += places
                    whole += [True] + [False] * (len(places) - 1)
                found = [(lang, h, w, size, at, v) for lang, h, w, (size, at, v) in zip(langs, orders, whole, vectors(texts, idf)) if size]
                columns = list(zip(*found)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "h", "whole", "size", "at", "v"])

    return run


def _clustered(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one language: its centroids, and the distances of its texts and pieces by band."""
    rows = rows.sort_values(["h", "size"], kind="stable")
    whole = rows[rows["whole"]]
    x = np.zeros((len(whole), DIMS), np.float32)
    for k, (at, v) in enumerate(zip(whole["at"], whole["v"])):
        x[k, at] = v
    centres = clusters(x, CLUSTERS) if len(x) else x
    lang = rows["lang"].iloc[0]
    out = [(lang, -1, c) for c in centres]
    if len(centres):
        distance = np.array([1 - (centres[:, at] @ v).max() for at, v in zip(rows["at"], rows["v"])], np.float32)
        band = np.searchsorted(BANDS, rows["size"].to_numpy(), side="right")
        out += [(lang, int(b), distance[band == b]) for b in np.unique(band)]
    return pd.DataFrame(out, columns=["lang", "band", "numbers"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Document frequencies of all learnable rows, and centroids and limits of a bounded sample of them."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    frequency, n = document_frequencies(known)
    idf = np.log((n + 1) / (frequency + 1)) + 1
    short = known.filter(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = {r["lang"]: r["count"] for r in short.groupBy("lang").count().collect()}
    empty = Model(idf, np.zeros((DIMS, 0), np.float32), [], np.ones(len(BANDS) + 1))
    if not sizes:
        return empty
    share = F.element_at(F.create_map(*(F.lit(x) for name, size in sorted(sizes.items()) for x in (name, rows / size))), F.col("lang"))
    order = F.xxhash64("doc_id", F.lit(13)).bitwiseAND(F.lit((1 << 53) - 1))
    sample = short.withColumn("h", order).filter(F.col("h") < share * float(1 << 53))
    found = sample.select("lang", "h", "text").mapInArrow(_sampled_vectors(idf), "lang string, h long, whole boolean, size long, at array<int>, v array<float>")
    made = found.groupBy("lang").applyInPandas(_clustered, "lang string, band int, numbers array<float>").toPandas()
    centroids = made[made["band"] < 0].sort_values("lang", kind="stable")
    if centroids.empty:
        return empty
    limits = np.ones(len(BANDS) + 1)
    above = 0.0
    for b in reversed(range(len(BANDS) + 1)):  # a band with few texts takes at least the limit of the longer ones
        own = [x for numbers in made[made["band"] == b]["numbers"] for x in numbers]
        above = max(above, float(np.quantile(own, REJECT_QUANTILE)) if len(own) >= 20 else 0.0)
        limits[b] = above or 1.0
    return Model(idf, np.ascontiguousarray(np.stack(centroids["numbers"].to_list()).T, np.float32), centroids["lang"].to_list(), limits)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine), distance and rejected of every row. No shuffle."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    sent = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in B.slices(batch, "text", TEXT_BYTES):
                langs, scores, rejected = [], [], []
                for size, at, v in vectors(piece.column("text").to_pylist(), model.idf):
                    name, cosine = model.predict(at, v) if size and model.langs else (UNKNOWN, 0.0)
                    langs.append(name)
                    scores.append(cosine)
                    rejected.append(name == UNKNOWN or 1 - cosine > model.limits[np.searchsorted(BANDS, size, side="right")])
                made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *made], names=["doc_id", "lang_pred", "score", "rejected"])

    out = slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and predicts the language of every document; `rejected` rows are unlike all that was learnt."""
    return predict(docs, fit(docs))
