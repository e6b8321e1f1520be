"""Fill-in-middle transformation by displacement scatter.

A batch of texts is one array of bytes. A scan finds the ends of the units of every text and from
them the two cuts. Each of the three parts of a text moves by one shift, so a difference array holds
the change of shift at every part's first byte, its cumulative sum is the shift of every byte, and
one scatter writes all outputs; the markers go into the gaps. The way back finds the markers in the
outputs, sums the inverse differences, and gathers the bytes.

Units are words with the blanks before them, and blanks at the end of a text. Where a text is cut,
and whether it is, is told by a hash of its id. Texts that are empty or hold a marker stay plain, so
every output can be turned back.

Null texts count as empty and come back as empty. A null id counts as the id "null". Texts of any
length are cut whole; repeated rows give equal results; an empty table gives an empty result; only
the id and text columns are read, whatever the names of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B

# The markers, the seed, and the shares of hundred that are cut and that are suffix-first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
CUT_PERCENT = 50
SPM_PERCENT = 80
MARK = 3  # bytes of a marker
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
TEXT_BYTES = 2 << 20  # text moved at once in a task; a longer single text is moved alone


def numbers(ids: list, seed: int) -> np.ndarray:
    """Four unsigned numbers of 32 bits of each id: the first groups of a digest of seed and id."""
    found = [hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(found), dtype=">u4").reshape(-1, 4).astype(np.int64)


def markers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where markers begin, and in which row; none lies across rows."""
    at = np.flatnonzero(data[: max(len(data) - 2, 0)] == ord("<"))
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + MARK <= offsets[row + 1]
    return at[inside], row[inside]


def cuts(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of units of each row, and the bytes where its prefix and its middle end."""
    words = B.words(data, offsets, B.BLANK_WORDS)
    many, filled = np.diff(words.first), np.flatnonzero(np.diff(offsets))
    n = many.copy()
    n[filled] += ~B.BLANK_WORDS[data[offsets[filled + 1] - 1]]  # blanks at the end

    def place(units: np.ndarray) -> np.ndarray:
        out = np.where(units == 0, offsets[:-1], offsets[1:])
        inner = np.flatnonzero((units > 0) & (units <= many))
        out[inner] = words.end[words.first[inner] + units[inner] - 1]
        return out

    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def shifts(total: int, starts: list[np.ndarray], amounts: list[np.ndarray]) -> np.ndarray:
    """The shift of each of `total` bytes, given where parts start, in order, and the shift of each."""
    at, amount = np.column_stack(starts).ravel(), np.column_stack(amounts).ravel()
    difference = np.zeros(total + 1, np.int64)
    np.add.at(difference, at, np.diff(amount, prepend=0))
    return np.cumsum(difference[:total])


def displaced(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the outputs."""
    moved = form != PLAIN
    to = offsets + np.concatenate([[0], np.cumsum(3 * MARK * moved)])
    base = (to - offsets)[:-1]
    p, m, s = first - offsets[:-1], second - first, offsets[1:] - second
    spm = form == SPM
    prefix = base + np.where(spm, 2 * MARK + s, MARK)
    suffix = base + np.where(spm, MARK - p - m, 2 * MARK - m)
    amounts = [np.where(moved, x, base) for x in (prefix, base + 3 * MARK + s, suffix)]
    out = np.empty(int(to[-1]), np.uint8)
    out[np.arange(len(data)) + shifts(len(data), [offsets[:-1], first, second], amounts)] = data
    lead = MARK + np.where(spm, s, p)  # from the first marker to the second
    last = 2 * MARK + p + s
    for mark, at in ((PREFIX, np.where(spm, lead, 0)), (SUFFIX, np.where(spm, 0, lead)), (MIDDLE, last)):
        for k, byte in enumerate(mark):
            out[(to[:-1] + at + k)[moved]] = byte
    return out, to


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the texts that the outputs were made from."""
    moved = form != PLAIN
    at, row = markers(data, offsets)
    at = at[moved[row]]
    if len(at) != 3 * moved.sum():
        raise ValueError("an output does not hold its three markers once each")
    back = offsets - np.concatenate([[0], np.cumsum(3 * MARK * moved)])
    where = np.tile(offsets[:-1, None], (1, 3))
    where[moved] = at.reshape(-1, 3)
    one, two, three = where.T
    spm = form == SPM
    p = np.where(moved, np.where(spm, three - two, two - one) - MARK, 0)
    m = np.where(moved, offsets[1:] - three - MARK, 0)
    from_prefix, from_middle, from_suffix = np.where(spm, two, one) + MARK, three + MARK, np.where(spm, one, two) + MARK
    starts = [back[:-1], back[:-1] + p, back[:-1] + p + m]
    amounts = [np.where(moved, source - start, offsets[:-1] - back[:-1]) for source, start in zip((from_prefix, from_middle, from_suffix), starts)]
    total = int(back[-1])
    return data[np.arange(total) + shifts(total, starts, amounts)], back


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _code_points(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per document row: n units, form, prefix_chars and middle_chars (null where plain), and the output. No shuffle."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch, "text", TEXT_BYTES):
                data, offsets = B.texts(piece.column("text"))
                h = numbers(piece.column("doc_id").to_pylist(), seed)
                n, first, second = cuts(data, offsets, h)
                form = np.where(h[:, 2] % 100 >= cut_percent, PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
                form[markers(data, offsets)[1]] = PLAIN
                form[np.diff(offsets) == 0] = PLAIN
                points, plain = _code_points(data), form == PLAIN
                chars = [pa.array(points[b] - points[a], pa.int64(), mask=plain) for a, b in ((offsets[:-1], first), (first, second))]
                made = [pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), pa.string()), *chars, _strings(*displaced(data, offsets, first, second, form))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return slim.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """Adds restored: the text that each row's output was made from, told from output and form alone. No shuffle."""
    names = [f"_c{k}" for k in range(len(rows.columns))]
    plain = rows.toDF(*names)
    output, form = names[rows.columns.index("output")], names[rows.columns.index("form")]
    schema = plain.withColumn("_restored", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {f: k for k, f in enumerate(FORMS.tolist())}
        for batch in batches:
            for piece in B.slices(batch, output, TEXT_BYTES):
                data, offsets = B.texts(piece.column(output))
                forms = np.array([order[f] for f in piece.column(form).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns, _strings(*gathered(data, offsets, forms))], names=[*names, "_restored"])

    return plain.mapInArrow(run, schema).toDF(*rows.columns, "restored")


def report(docs: DataFrame) -> DataFrame:
    """Counts, form and digests of every document's output and of the text restored from it."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST(least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(list_slice(w, 1, a), '') AS p, array_to_string(list_slice(w, a + 1, b), '') AS m, array_to_string(list_slice(w, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
