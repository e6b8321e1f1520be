"""BPE encoding and decoding with a deterministic automaton over tokens.

The automaton is compiled by successive merge gadgets: it starts with one state in which every base
symbol loops; the gadget of merge `u v` gives `u` a target state of its own, takes the arc `v` out
of it, and adds the arc `uv` beside every arc `u`, leading where `v` leads. Afterwards a word has one
accepted path, and its arc labels are the word's tokens. All arcs with one label lead to one state,
so the transition table is a bit for each label and state (72 MB for 49,408 labels), and a second
table spells labels by characters. Words are walked through both tables many at a time, position by
position. Reading the labels along a path decodes.

Null and empty texts give no ids and decode to the empty text. Texts of any length are read whole.
Equal rows give equal results; an empty table gives an empty result; only the id and text columns
are read, whatever the names of the others.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .pieces import PieceEncoder, Vocabulary, byte_symbols

TEXT_BYTES = 1 << 20  # text encoded together in a task; a longer single text is encoded alone


class TokenAutomaton:
    """Transition table over labels, spelling table over bytes, and the walk of many words."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        size = max(vocabulary.values(), default=0) + 1
        made = {u + v for u, v in merges}
        order = [t for t in vocabulary if t not in made]
        row = {t: k for k, t in enumerate(order)}  # base labels, then merged ones in the order they are made
        for u, v in merges:
            row.setdefault(u + v, len(row))
        leads = dict.fromkeys(row, 0)  # where the arcs of a label lead
        users = [len(order)]  # of each state: the labels that lead to it
        gadgets = []
        seen = set(order)
        for u, v in merges:
            at, target = leads[u], leads[v]  # of u u, the second u leads where u led so far
            new = 0
            if at == 0 or users[at] > 1 or u == v:
                users[at] -= 1
                new = len(users)
                users.append(1)
                leads[u] = new
            if u + v not in seen:
                seen.add(u + v)
                leads[u + v] = target
                users[target] += 1
            gadgets.append((row[u], row[v], row[u + v], at, new))
        table = np.zeros((len(row), len(users) // 8 + 1), np.uint8)
        table[: len(order), 0] = 1
        for u, v, w, at, new in gadgets:
            if new:  # the new state has the arcs of the old one
                known = table[: max(w, len(order)), at >> 3] >> (at & 7) & 1
                table[: len(known), new >> 3] |= known << (new & 7)
                at = new
            table[v, at >> 3] &= ~np.uint8(1 << (at & 7))
            table[w] |= table[u]
        self.table = table
        self.row = np.zeros(size, np.int32)
        self.leads = np.zeros(size, np.int32)
        for t, k in row.items():
            if t in vocabulary:
                self.row[vocabulary[t]] = k
                self.leads[vocabulary[t]] = leads[t]
        self._spell(vocabulary, end)

    def _spell(self, vocabulary: dict[str, int], end: str) -> None:
        """Nodes of the spelling table; a node's label inside a word and at its end, -1 for none."""
        symbol = {s: b for b, s in enumerate(byte_symbols())}
        nodes: dict[bytes, int] = {b"": 0}
        inside, last = {}, {}
        for token, i in vocabulary.items():
            final = bool(end) and token.endswith(end) and token != end
            text = token[: -len(end)] if final else token
            if not all(c in symbol for c in text):
                continue
            spelled = bytes(symbol[c] for c in text)
            for k in range(1, len(spelled) + 1):
                nodes.setdefault(spelled[:k], len(nodes))
            if final or not end:
                last[nodes[spelled]] = i
            if not final:
                inside[nodes[spelled]] = i
        parents = {nodes[n[:-1]] for n in nodes if n}
        rank = {n: k for k, n in enumerate(sorted(parents))}
        self.node_row = np.full(len(nodes), -1, np.int32)
        for n, k in rank.items():
            self.node_row[n] = k
        self.next = np.full((len(rank), 256), -1, np.int32)
        for text, n in nodes.items():
            if text:
                self.next[rank[nodes[text[:-1]]], text[-1]] = n
        self.inside = np.full(len(nodes), -1, np.int32)
        self.last = np.full(len(nodes), -1, np.int32)
        self.inside[list(inside)] = list(inside.values())
        self.last[list(last)] = list(last.values())

    def walk(self, words: list[bytes]) -> list[bytes]:
        """The ids along each word's path, as little-endian numbers of 32 bits."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        bucket = np.ceil(np.log2(np.maximum(sizes, 4))).astype(int)
        for k in np.unique(bucket):
            which = np.flatnonzero((bucket == k) & (sizes > 0))
            for part in np.array_split(which, max(1, int(len(which) * (1 << k) // (1 << 21)))):
                if len(part):
                    for i, ids in zip(part, self._walk([words[i] for i in part], sizes[part]), strict=True):
                        out[i] = ids
        return out

    def _walk(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        n, width = len(words), int(sizes.max())
        symbols = np.zeros((width, n), np.uint8)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(n), sizes)
        symbols[np.arange(len(flat)) - begin[owner], owner] = flat
        reached = np.full((width + 1, n), -1, np.int32)  # the label that ends here on the accepted path of the prefix
        came = np.zeros((width + 1, n), np.int32)  # where that label begins
        word = np.zeros(0, np.int64)
        node, start, state = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        for at in range(width):
            fresh = np.flatnonzero((reached[at] >= 0) & (sizes > at)) if at else np.arange(n)
            word = np.concatenate([word, fresh])
            node = np.concatenate([node, np.zeros(len(fresh), np.int32)])
            start = np.concatenate([start, np.full(len(fresh), at, np.int32)])
            state = np.concatenate([state, self.leads[reached[at, fresh]] if at else np.zeros(len(fresh), np.int32)])
            node = self.next[self.node_row[node], symbols[at, word]]
            label = np.where(sizes[word] == at + 1, self.last[node], self.inside[node])
            found = np.flatnonzero((node >= 0) & (label >= 0))
            ends = found[self.table[self.row[label[found]], state[found] >> 3] >> (state[found] & 7) & 1 > 0]
            reached[at + 1, word[ends]] = label[ends]
            came[at + 1, word[ends]] = start[ends]
            on = (node >= 0) & (sizes[word] > at + 1)
            on &= self.node_row[node] >= 0
            word, node, start, state = word[on], node[on], start[on], state[on]
        ids, owners = [], []
        left, at = np.arange(n), sizes.copy()
        while len(left):
            label = reached[at, left]
            if (label < 0).any():
                raise ValueError(f"no path for {words[left[int(np.argmax(label < 0))]]!r}")
            ids.append(label)
            owners.append(left)
            at = came[at, left]
            left, at = left[at > 0], at[at > 0]
        ids, owners = np.concatenate(ids[::-1]), np.concatenate(owners[::-1])
        order = np.argsort(owners, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owners, minlength=n))).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class WordBpe:
    """The automaton of a vocabulary file, with its labels."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.automaton = TokenAutomaton(vocabulary.ids, vocabulary.merges, vocabulary.end)
        names = {i: t for t, i in (vocabulary.ids | vocabulary.added).items()}
        self.encoder = PieceEncoder(vocabulary, lambda words: self.automaton.walk([w.encode("utf-8", "replace") for w in words]))
        every = range(max(names, default=0) + 1)
        self.labels = pa.array([names.get(i) for i in every], pa.string())
        self.numbers = pa.array([str(i) for i in every], pa.string())

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        found = self.encoder.encode(texts)
        stops = np.cumsum([0, *(len(b) // 4 for b in found)], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))

    def spelled(self, ids: pa.ListArray, labels: pa.Array) -> pa.Array:
        """The labels of each text's ids with a space between them, as the vocabulary's library decodes."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, labels.take(ids.values)), " ")

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The labels of the arcs in order."""
        return self.spelled(ids, self.labels)


_LOADED: dict[str, WordBpe] = {}


def loaded(name: str) -> WordBpe:
    """The automaton of a vocabulary file that was sent to the executors; built once in a worker."""
    if name not in _LOADED:
        _LOADED[name] = WordBpe(SparkFiles.get(name))
    return _LOADED[name]


def send(df: DataFrame, path: str) -> str:
    """Hands a vocabulary file (a few MB, whatever the input) to every executor."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def _digests(texts: pa.Array) -> pa.Array:
    data, offsets = B.texts(texts)
    at = offsets.tolist()
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per document row: n_tokens, and either ids (array) with the decoded text or the digests of both. No shuffle."""
    name = send(docs, path)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    columns = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name)
        for batch in batches:
            for piece in B.slices(batch, "text", TEXT_BYTES):
                ids = bpe.encode(piece.column("text").to_pylist())
                decoded = bpe.decode(ids)
                made = [_digests(bpe.spelled(ids, bpe.numbers)), _digests(decoded)] if digests else [ids, decoded]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), *made], names=["doc_id", "n_tokens", *columns])

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, {columns[0]} {'string' if digests else 'array<int>'}, {columns[1]} string")
