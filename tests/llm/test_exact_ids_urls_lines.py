"""Ids on all kinds of code points, urls as they are, and lines of documents that share an id."""

import random
import struct
import unicodedata

import pytest

from turnloom.llm import bpe, line_dedup, tokens_file, warc
from turnloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_padding()
    library.no_truncation()
    return library, bpe.WordBpe(vocabulary()), tokens_file.Encoder(vocabulary())


def differing(encoders, texts):
    library, automaton, files = encoders
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = automaton.encode(texts).to_pylist()
    written = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in files.encode(texts)]
    return [ascii(t) for t, *three in zip(texts, want, ids, written, strict=True) if not three[0] == three[1] == three[2]]


def test_every_code_point_of_the_first_planes(encoders):
    """Letters, signs, marks, unassigned ones: Python, its pattern module and the library know different versions of Unicode."""
    assert differing(encoders, [f"a{chr(c)}b" for c in range(0x20000) if not 0xD800 <= c < 0xE000]) == []


def test_pairs_of_combining_marks(encoders):
    rng = random.Random(2)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    assert differing(encoders, ["a" + rng.choice(marks) + rng.choice(marks) + "b" for _ in range(8000)]) == []
    assert differing(encoders, ["ᢩ࣎", "ab౜cd ef"]) == []


def test_texts_over_all_planes(encoders):
    rng = random.Random(3)
    common = "abc ABC .,!?' éñßΣςİı日本 _-09\n\x1ć"

    def sign(high):
        c = rng.randrange(high)
        return rng.choice(common) if 0xD800 <= c < 0xE000 or rng.random() < 0.5 else chr(c)

    texts = ["".join(sign(high) for _ in range(rng.randint(1, 14))) + rng.choice(["", "<|endoftext|>", " <|x"]) for high in (0x300, 0x3000, 0x11000, 0x20000, 0x110000) for _ in range(4000)]
    assert differing(encoders, texts) == []


def test_urls_stand_in_headers_as_they_are(spark):
    urls = ["http://a/x%20y?q=a>b", "http://a/%0A%0d", "line\r\nbreak %3E", None, "", "http://ü/é"]
    rows = [(k, u, "<p>text</p>" * (k % 3 * 60)) for k, u in enumerate(urls)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r.page_id: (r.url, bytes(r.record)) for r in warc.records(archive).collect()}
    for k, url in enumerate(urls):
        assert found[k][0] == url
        lines = found[k][1].split(b"\r\n\r\n")[0].split(b"\r\n")
        held = [x.removeprefix(b"WARC-Target-URI: ").decode() for x in lines if x.startswith(b"WARC-Target-URI: ")]
        assert held == ([] if url is None else [url.replace("\r", "%0D").replace("\n", "%0A")])
        assert lines[0] == b"WARC/1.1" and all(b": " in x or x.endswith(b":") for x in lines[1:])
    assert sorted(r.page_id for r in warc.report(archive).collect()) == list(range(len(urls)))


def test_documents_that_share_an_id_lose_no_line_of_their_own(spark):
    rows = [(1, "shared alpha line here now"), (2, "shared alpha line here now\nxx yy"), (2, "a wholly unique sentence of mine\nzz ww"), (None, "shared alpha line here now"), (3, "first\nshared alpha line here now"), (3, "first\nother text stands on this line")]
    out = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(1, "shared alpha line here now", 0), (2, "xx yy", 1), (2, "a wholly unique sentence of mine\nzz ww", 0), (None, "shared alpha line here now", 0), (3, "first", 1), (3, "first\nother text stands on this line", 0)], key=str)
