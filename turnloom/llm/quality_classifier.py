"""Quality classifier by compression: two zstandard dictionaries, from good and from bad labelled text.

A text is cut into chunks; each chunk is compressed with either dictionary. The difference of the
two total sizes, normalised by the text's own size, says which class the text resembles; over the
compressed sizes it would say too much of texts that repeat themselves and are small with either. A
constant added to the size draws very short texts, which tell little, towards 0. A logistic curve
over the difference, fitted on rows that neither dictionary has seen, turns it into a probability.

Null and empty texts have difference 0 and get the curve's value there. Texts of any length
are compressed whole, chunk after chunk. Without labelled rows of both classes every score is the
share of good rows (0.5 without any). Repeated rows get equal scores; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, logistic, sample, sigmoid

CHUNK_BYTES = 512
DICTIONARY_BYTES = 112 << 10
NORMAL_BYTES = 128  # added to a text's size
LEVEL = 3
THRESHOLD = 0.5


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self) -> tuple:
        kwargs = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **kwargs) if d else zstandard.ZstdCompressor(**kwargs) for d in (self.good, self.bad))

    def score(self, difference: float) -> float:
        return sigmoid(self.slope * difference + self.intercept)


def chunks(text: bytes) -> list[bytes]:
    return [text[k : k + CHUNK_BYTES] for k in range(0, len(text), CHUNK_BYTES)]


def difference(text: bytes, compressors: tuple) -> float:
    """100 * (size with the bad dictionary - size with the good one) / (size + NORMAL_BYTES)."""
    if not text:
        return 0.0
    parts = chunks(text)
    good, bad = (sum([len(c.compress(part)) for part in parts]) for c in compressors)
    return 100 * (bad - good) / (len(text) + NORMAL_BYTES)


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of DICTIONARY_BYTES at most from a class's texts; their own bytes where there are too few to train."""
    parts = [p for t in texts for p in chunks(t)]
    if not parts:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]  # raw content


def fit(rows: list[tuple[str, int]], sizes: dict[int, int]) -> Model:
    """Every other row of a class trains its dictionary; the rest set the curve."""
    by = {y: [t.encode("utf-8", "replace") for t, label in rows if label == y and t] for y in (0, 1)}
    total = sum(sizes.values())
    if not by[0] or not by[1]:
        share = min(max(sizes.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    model = Model(dictionary(by[1][::2]), dictionary(by[0][::2]), 0.0, 0.0)
    compressors = model.compressors()
    x, y, w = [], [], []
    for label in (0, 1):
        seen = by[label][1::2] or by[label]
        x += [difference(t, compressors) for t in seen]
        y += [label] * len(seen)
        w += [sizes[label] / len(seen)] * len(seen)
    weight = np.array(w) * len(w) / sum(w)
    return Model(model.good, model.bad, *logistic(np.array(x), np.array(y), weight, ridge=1e-2).tolist())


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the compression difference of every row. No shuffle."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    sent = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = sent.value.compressors()
        for batch in batches:
            found = [difference((t.as_py() or "").encode("utf-8", "replace"), compressors) for t in batch.column("text")]
            scores = [sent.value.score(d) for d in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.float64())], names=["doc_id", "score", "difference"])

    scored = slim.mapInArrow(run, f"doc_id {kind}, score double, difference double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out, and scores every document."""
    rows, sizes = sample(docs, labels, "quality")
    return score(docs, fit(rows, sizes))
