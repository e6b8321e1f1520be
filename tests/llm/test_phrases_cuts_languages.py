"""Collocations, fill-in-middle and language ID against plain Python versions on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import collocations, fill_in_middle, language_id

UPPER = {c: c + 32 for c in range(65, 91)}


def awkward():
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "city", "it's", "über", "日本", "a", "b-c", "x1"]
    end = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! ", "\x0b", "? ", "; "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(end) for _ in range(n))
    out = [(i, text(rng.randint(1, 60)), rng.choice(["en", "de", None])) for i in range(120)]
    out += [(200 + i, "New York city is a big City, the city of New York", "en") for i in range(9)]
    out += [(300, None, "en"), (301, "", None), (302, " \t\n.,", "de"), (None, "no id the of", None), (303, "echo echo echo echo echo echo " * 40, "fr"), (5, out[5][1], out[5][2]), (304, "solo", "it")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, lang string, n int, phrase string").repartition(3)


def mined_by_hand(rows, least, top):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {key: a for key, a in f.items() if a >= least}
    found = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or any(b >= a and len(q) > len(p) and other == lang and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in often.items()):
            continue
        cuts = [((1000 * a * total[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    return sorted((lang, i, p.decode(), -a, x, r, n, -s) for lang, own in found.items() for i, (s, a, p, x, r, n) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("sample_of", [4, 10**9])
def test_collocations(spark, monkeypatch, sample_of):
    """Also with an empty sample, so that the border fails everywhere and is closed."""
    monkeypatch.setattr(collocations, "SAMPLE_OF", sample_of)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 900)
    got = sorted(map(tuple, collocations.collocations(frame(spark, awkward()), min_count=7, top=20).collect()))
    assert got == mined_by_hand(awkward(), 7, 20)
    assert max(Counter(r[0] for r in got).values()) == 20


def test_collocations_hands_counts_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TALLY", 8)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    assert sorted(map(tuple, collocations.collocations(frame(spark, awkward()), min_count=9).collect())) == mined_by_hand(awkward(), 9, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, awkward()).limit(0), min_count=2).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b", "en")])).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    rows = [("en", 1, "a", 3 * 10**14 + 7), ("en", 1, "b", 10**14 + 1), ("en", 2, "a b", 10**14 - 3)]
    n = 9 * 10**14 + 11
    out = collocations.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long"), spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert [r.score for r in out] == [Fraction(1000 * rows[2][3] * n, rows[0][3] * rows[1][3]).__floor__()]


def test_languages_are_counted_apart(spark):
    """A word and a language of the same name are no other language's word."""
    import pyarrow as pa

    one = collocations.Slice(pa.array(["en", "de"]), pa.array(["de", "en"]))
    assert len(set(one.phrases(1).tolist())) == 2


def cut_by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in awkward()] + [(400 + i, "<P P> <S\té <M \n>" * (i % 5) + "<P" * (i % 3)) for i in range(60)]
    rows += [(500, "a <P> b"), (501, "<M>"), (502, "x" * 9000 + " y" * 9000), (503, "  "), (504, "\n"), (-7, "minus seven it is"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, output string, form int").repartition(3)
    monkeypatch.setattr(fill_in_middle, "TEXT_BYTES", 700)
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out) == Counter((i, *cut_by_hand(i, t), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_in_middle.report(docs).collect()) == Counter((i, sha(cut_by_hand(i, t)[4]), sha(t or "")) for i, t in rows)
    assert fill_in_middle.report(docs.limit(0)).count() == 0


def test_fill_in_middle_shares(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('one two three four ', id) as text")
    every = fill_in_middle.fill_in_middle(docs, cut_percent=100, spm_percent=0)
    assert {r.form for r in every.collect()} == {"psm"}
    assert {r.form for r in fill_in_middle.fill_in_middle(docs, cut_percent=0).collect()} == {"plain"}
    assert fill_in_middle.fill_in_middle(docs, seed=7).exceptAll(fill_in_middle.fill_in_middle(docs)).count() > 0


def test_restore_refuses_an_output_without_its_markers(spark):
    broken = spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="three markers"):
        fill_in_middle.restore(broken).collect()


LANGS = {"aa": "kalo temi suna rovi pado", "bb": "schrum blenk tropft gwirz", "cc": "жило было море тайга"}


def sentences(seed):
    rng = random.Random(seed)
    out = []
    for i in range(150):
        lang = rng.choice(list(LANGS))
        words = LANGS[lang].split()
        out.append((i, " ".join(rng.choice(words)[:3] + rng.choice(words) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_language_id(spark):
    rows = sentences(3) + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "aa"), (903, "́̂", "aa"), (904, "kalo temi", None), (None, "schrum blenk", "bb"), (905, "日本語のテキストとそのほかの文字" * 4, None), (906, "kalo " * 4000, "aa"), (3, sentences(3)[3][1], sentences(3)[3][2])]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean").repartition(3)
    out = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert all(by[i].lang_pred == lang for i, text, lang in sentences(3))
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4
    assert [by[i].score for i in (900, 901, 902, 903)] == [0.0] * 4
    assert (by[904].lang_pred, by[None].lang_pred, by[906].lang_pred) == ("aa", "bb", "aa")
    assert by[905].rejected and not by[904].rejected and by[905].lang_pred in LANGS
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    assert sorted(map(str, out)) == sorted(map(str, language_id.identify(docs.repartition(2)).collect()))


def test_language_id_never_learns_from_held_out_rows(spark):
    rows = sentences(4)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wrong = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    assert sorted(map(str, language_id.identify(spark.createDataFrame(rows, schema)).collect())) == sorted(map(str, language_id.identify(spark.createDataFrame(wrong, schema)).collect()))


def test_language_id_without_rows_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(rows).collect()] == [("und", 0.0)]
    assert language_id.identify(rows.limit(0)).count() == 0


def test_language_vectors_are_tf_idf_of_letter_ngrams():
    """Weights and cosines recomputed from a dictionary of n-grams."""
    idf = np.random.default_rng(1).uniform(1, 5, language_id.DIMS)
    texts = ["Ab a", "a-b! ab", "ba"]
    seen = {}
    grams, first = language_id.buckets(texts)
    for text, a, b in zip(texts, first, first[1:]):
        padded = " " + " ".join(re.findall("[a-z]+", text.lower())) + " "
        named = [padded[i - k : i + 1 + (k and n)] if n < 2 else padded[i - 1 : i + 2] for i, c in enumerate(padded) if c != " " for k, n in ((0, 0), (1, 0), (1, 2))]
        for name, h in zip(named, grams[a:b].ravel().tolist()):
            assert seen.setdefault((len(name), name), h) == h
    for text, (size, at, v) in zip(texts, language_id.vectors(texts, idf)):
        grams, first = language_id.buckets([text])
        tf = Counter(grams.ravel().tolist())
        weights = {g: (1 + np.log(n)) * idf[g] for g, n in tf.items()}
        length = sum(w * w for w in weights.values()) ** 0.5
        assert size == sum(c.isalpha() for c in text)
        assert {int(g): round(float(w), 5) for g, w in zip(at, v)} == {g: round(w / length, 5) for g, w in weights.items()}


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert out.n > 20 and out.right > 0.97


def test_clusters_part_what_differs():
    rng = np.random.default_rng(0)
    base = np.eye(4, 64, dtype=np.float32)
    x = np.repeat(base, 20, axis=0) + rng.normal(0, 0.02, (80, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = language_id.clusters(x, 4)
    assert sorted(np.argmax(centres @ base.T, axis=1).tolist()) == [0, 1, 2, 3]
    assert len(language_id.clusters(x[:1], 4)) == 1
