"""Texts as pieces that a word-end vocabulary encodes one by one, and a bounded memory of them.

The vocabulary's pattern never joins characters across white space, nor letters or digits with other
signs, so a text is the sequence of its pieces between white space; a stop or comma that stands alone
is a piece of its own. Pieces are cut into words by the vocabulary's pattern, and words are what an
encoder gets. Few pieces are new, so the ids of each are remembered.

Python, its pattern module and the vocabulary's library each know another version of Unicode. Code
points whose kind and place among combining marks have been the same since Unicode 3.2 mean the same
to all of them; a piece that holds any other (or one that is not assigned) is normalised and cut into
words by the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache, cached_property

import regex

#: Python counts these as white space, the vocabulary's pattern does not
_ODD_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SIGNS_TOGETHER = re.compile(r"(?:[^\w\s]|_)(?:[^\w\s]|_)|[\u0300-\u036f]")
_ASCII_SIGNS_TOGETHER = re.compile(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]{2}")
ADDED = "<|"  # begins every added token; pieces that hold it stay as they are
REMEMBERED_BYTES = 24 << 20  # of pieces and ids, in each of two generations
ENTRY_BYTES = 200  # what a remembered piece takes beside its characters and ids
LONG_PIECE = 64  # longer pieces are not remembered


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is visible in Latin-1, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in visible else chr(256 + next(hidden)) for b in range(256)]


@cache
def _unsettled() -> re.Pattern:
    """Code points that versions of Unicode may take differently."""
    old, now = unicodedata.ucd_3_2_0, unicodedata
    group = lambda kind: kind[0] if kind[0] in "LNZ" else "other"  # noqa: E731  what the pattern tells apart

    def settled(c: str) -> bool:
        kind = old.category(c)
        return kind != "Cn" and group(kind) == group(now.category(c)) and old.combining(c) == now.combining(c) and all(old.category(x) != "Cn" for x in c.lower())

    starts, before = [], True
    for k in range(0x80, 0x110000):
        own = 0xD800 <= k < 0xE000 or settled(chr(k))
        if own != before:
            starts.append(k)
            before = own
    ends = [k - 1 for k in starts[1::2]] + [0x10FFFF] * (len(starts) % 2)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts[::2], ends, strict=True)) + "]")


def unsettled(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")  # all settled, and told faster than by a search
    except UnicodeEncodeError:
        return _unsettled().search(text) is not None
    return False


def normal(text: str) -> str:
    """Composed characters in lower case, one by one."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()  # the capital sigma has two small forms


def pieces(text: str | None) -> list[str]:
    """The pieces of a text, normalised but for those that may hold an added token or are the library's to normalise."""
    if not text:
        return []
    whole = any(c in text for c in _ODD_BLANKS)
    if ADDED in text or unsettled(text):
        return [c if ADDED in c or unsettled(c) else normal(c) for c in ([text] if whole else text.split())]
    text = normal(text)
    if whole:
        return [text]
    if not (_ASCII_SIGNS_TOGETHER if text.isascii() else _SIGNS_TOGETHER).search(text):
        text = text.replace(".", " .").replace(",", " ,")
    return text.split()


class Vocabulary:
    """A vocabulary file with word ends: names and ids, merges, the word pattern, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec.pop("model")
        self.merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {t: i for t, i in model["vocab"].items() if t not in self.added}
        self.end = model.get("end_of_word_suffix") or ""
        splits = [p["pattern"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["Regex"])
        self.path = path
        self.stop = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @cached_property
    def library(self) -> tuple:
        """The library's normaliser and word cutter, and the byte of each symbol in its words."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        return own.normalizer, own.pre_tokenizer, {s: b for b, s in enumerate(byte_symbols())}

    def _words(self, part: str) -> list[str]:
        """Words of a text that is not normalised yet and holds no added token."""
        if not unsettled(part):
            return self.pattern.findall(normal(part))
        normalizer, cutter, byte = self.library
        return [bytes(byte[c] for c in word).decode() for word, _ in cutter.pre_tokenize_str(normalizer.normalize_str(part))]

    def words(self, piece: str) -> list[str | int]:
        """A piece of text as words and ids of added tokens."""
        if self.stop and ADDED in piece:
            parts = [part for part in self.stop.split(piece) if part]
            return [w for part in parts for w in ([self.added[part]] if part in self.added else self._words(part))]
        if unsettled(piece):
            return self._words(piece)
        return [piece] if piece.isascii() and piece.isalpha() else self.pattern.findall(piece)


class PieceEncoder:
    """Texts to the bytes of their ids (little-endian, 32 bits), by an encoder of single words.

    Pieces are remembered in two generations: when the younger one is full it becomes the older one,
    and pieces that come again move to the younger, so frequent ones are never forgotten.
    """

    def __init__(self, vocabulary: Vocabulary, encode_words: Callable[[list[str]], list[bytes]]):
        self.words, self.encode_words = vocabulary.words, encode_words
        vocabulary.ids, vocabulary.merges = {}, []  # only needed to make an encoder
        self.added = {i: i.to_bytes(4, "little") for i in vocabulary.added.values()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def learn(self, found: set[str]) -> dict[str, bytes]:
        """The ids of new pieces."""
        split = {c: self.words(c) for c in found}
        new = list({w for words in split.values() for w in words if isinstance(w, str)})
        known: dict = self.added | dict(zip(new, self.encode_words(new), strict=True))
        return {c: known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for c, words in split.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        missing = {c for chunks in split for c in chunks if c not in self.young}
        passing: dict[str, bytes] = {}  # long pieces, for these texts only
        if missing:
            made = {c: self.old[c] for c in missing if c in self.old}
            made |= self.learn({c for c in missing if c not in made})
            passing = {c: ids for c, ids in made.items() if len(c) > LONG_PIECE}
            added = sum([ENTRY_BYTES + len(c) + len(ids) for c, ids in made.items() if c not in passing])
            if self.size + added > REMEMBERED_BYTES:
                made |= {c: self.young[c] for chunks in split for c in chunks if c in self.young}
                self.old, self.young, self.size = self.young, {}, 0
                added = sum([ENTRY_BYTES + len(c) + len(ids) for c, ids in made.items() if c not in passing])
            self.young.update(made)
            self.size += added
        get = self.young.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        for c in passing:
            del self.young[c]
        return out


class RememberedPieces(dict):
    """The ids of pieces, found when they are asked for, by an encoder of one word at a time; `old` is the generation before."""

    def __init__(self, vocabulary: Vocabulary, encode_word: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__()
        self.vocabulary, self.encode_word, self.old = vocabulary, encode_word, old
        self.size = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            words = self.vocabulary.words(piece)
            if words == [piece]:
                ids = self.encode_word(piece)
            else:
                of = self.encode_word if ADDED in piece or unsettled(piece) else self.__getitem__  # words are normal already, and must not become so twice
                ids = b"".join([of(w) if isinstance(w, str) else w.to_bytes(4, "little") for w in words])
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
            self.size += ENTRY_BYTES + len(piece) + len(ids)
        return ids
