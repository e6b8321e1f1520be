"""Every training-data operator against a brute-force version on a small, awkward table."""

import hashlib
import itertools
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnloom.llm import bpe, decontaminate, html_pages, html_text, line_dedup, ngram_join, pieces, quality_classifier, quality_rules, stages, storage, tokens_file, toxicity, warc
from turnloom.llm.components import components
from turnloom.llm.queries import vocabulary

UPPER = {c: c + 32 for c in range(65, 91)}
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "délta", "eps,ilon", "zeta.", "eta", "theta", "it's", "42"]
    long = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(30)]
    near = [" ".join(w if rng.random() > 0.01 else "edit" for w in long[0].split()) for _ in range(12)]
    lines = ["one line that many texts share here", "One line, that many texts share here!", "other line"]
    out = [None, "", "   \n ", "one", "one two three", "a b c d e", "A b  c d e", "x" * 3000, "<|endoftext|> a<|startoftext|>B", "日本語 テキスト ΑΣ Σ", *long, *near, long[1], long[1], "\n".join(lines), "\n".join(lines * 2), "\n".join([*lines, long[2]])]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in texts()] + [(5, texts()[5][1], "clash", 1), (None, "no id here", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [("b", texts()[12][1]), ("a", texts()[13][1]), ("c", "one two three"), ("d", None), ("e", "!!"), (None, "one"), ("f", texts()[10][1]), ("g", texts()[11][1])]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for item, text in items:
        found = word.findall((text or "").translate(UPPER))
        windows += [(item or "null", found[k : k + 10]) for k in range(max(len(found) - 9, 1))] if found else []
    once = decontaminate.contamination(docs, benchmark).collect()
    got = {(r.doc_id, r.n_words): r for r in once}
    for i, text in texts():
        found = word.findall((text or "").translate(UPPER))
        hit, names = set(), set()
        for item, w in windows:
            for k in range(len(found) - len(w) + 1):
                if found[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    names.add(item)
        r = got[(i, len(found))]
        assert (r.n_hit, r.n_items, r.contaminated) == (len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 60)  # several passes, and items cut into parts
    monkeypatch.setattr(decontaminate, "PART_WORDS", 3)
    assert len(decontaminate._passes(benchmark, "item_id", "text", 10)) > 3
    assert sorted(decontaminate.contamination(docs, benchmark).collect(), key=str) == sorted(once, key=str)


def test_line_dedup(docs, empty):
    out = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(docs).filter("doc_id is not null").collect()}
    normal = lambda s: " ".join(x for x in re.split(r"[^\w]+|_", s.lower()) if x)
    kept = set()
    for i, text in texts():
        own = (text or "").split("\n") if text is not None else []
        r = out[(i, len(own))]
        assert (r.text is None) == (text is None)
        left = (r.text or "").split("\n") if r.n_removed < len(own) else []
        assert len(own) - len(left) == r.n_removed or text in (None, "")
        for line in left:
            if normal(line):
                assert (i, normal(line)) not in kept
                kept.add((i, normal(line)))
    seen = Counter(line for _, line in kept)
    assert max(seen.values()) == 1
    assert {line for _, t in texts() for line in map(normal, (t or "").split("\n")) if line} >= set(seen)
    assert out[(10, 1)].n_removed == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_lines():
    """Lines, and each with a word replaced, taken out, added or moved, with several replaced, or with a letter replaced."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7)))
    out = ["internationally", "internationaly", "chapter twelve of it", "chapter twelbe of it", "not like any", "a line without its like"]
    for n in (5, 6, 8, 10, 13, 14, 20, 40, 100):
        for _ in range(3):
            line = [word() for _ in range(n)]
            k = rng.randrange(n)
            moved = line[:k] + line[k + 1 :]
            moved.insert(rng.randrange(n), line[k])
            several = [word() if i % 12 == 5 else w for i, w in enumerate(line)]
            out += [" ".join(x) for x in (line, [*line[:k], "on", *line[k + 1 :]], line[:k] + line[k + 1 :], [*line[:k], "on", *line[k:]], moved, several)]
    return out


def test_line_dedup_finds_all_lines_of_edit_similarity_four_fifths(spark):
    lines = near_lines()
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        longer = max(len(lines[a]), len(lines[b]))
        if 5 * abs(len(lines[a]) - len(lines[b])) <= longer and 5 * edit_distance(lines[a], lines[b]) <= longer:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    made = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in line_dedup.dedup_lines(made).filter("n_removed = 0").collect()}
    assert got == {root(i) for i in range(len(lines))}


def test_ngram_join(docs, empty):
    sets = {}
    for i, text in texts():
        w = BLANK.findall((text or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = ngram_join.jaccard_components(docs)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert rows == {i: (len(s), root(i)) for i, s in sets.items()} | {None: (1, None)}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_deals_long_lists_over_tasks(spark, monkeypatch):
    """Near copies of one text and a passage in many texts, with the sizes lowered at which lists are cut and shingles count as common."""
    monkeypatch.setattr(ngram_join, "SPLIT_CLASS", 3)
    monkeypatch.setattr(ngram_join, "LOCAL_MIN", 2)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    made = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = word()
        made.append(" ".join(words if k % 3 else [*[word() for _ in range(rng.randint(10, 60))], *passage]))
    rows = list(enumerate(made))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in (t.split(),)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: root(i) for i in sets}
    assert len({root(i) for i in sets}) > 5


def test_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 20, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        b = np.union1d(a[: size // 2], rng.integers(0, 1 << 60, size // 3 + 1).astype(np.uint64))
        bits = np.bitwise_count(ngram_join.parities(a) ^ ngram_join.parities(b)).sum()
        assert bits <= len(np.setxor1d(a, b))
        long = ngram_join.long_parities(a), ngram_join.long_parities(b)
        assert len(long[0]) * 64 >= 4 * len(a)
        linked = ngram_join.sets_allow(len(a), a, len(b), b)
        assert ngram_join.parities_allow(len(a), long[0], len(b), long[1]) or not linked
        near = np.union1d(a[: int(size * 0.9)], a[:1])
        assert ngram_join.parities_allow(len(a), long[0], len(near), ngram_join.long_parities(near)) or not ngram_join.sets_allow(len(a), a, len(near), near)


@pytest.mark.parametrize("n", range(1, 17))
def test_light_and_heavy_bounds(n):
    for m in ngram_join.partners(n):
        need = ngram_join.required(n, m)
        assert 100 * need >= 80 * (n + m - need) > 100 * (need - 1) - 80
        assert need >= n - ngram_join.prefix_size(n) + 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(30)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for v, c in got.items():
        seen, todo = {v}, [v]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert c == min(seen)


def test_bpe_and_token_files_equal_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode(docs, vocabulary()).collect()}
    for i, text in texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[(i, len(ids))]
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, vocabulary()).count() == 0
    rows = sorted(tokens_file.token_file_report(docs, vocabulary()).collect(), key=lambda r: r.start)
    assert rows[0].doc_id is None
    at = rows[0].n_tokens
    for r, (i, text) in zip(rows[1:], sorted([*texts(), texts()[5]], key=lambda x: x[0]), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert tokens_file.token_file_report(empty, vocabulary()).count() == 0


def test_pieces_of_sign_mixes_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    rng = random.Random(6)
    mixes = ["".join(rng.choices("ab1é _.,-'!$\u0301\u0903²½٣", k=rng.randint(1, 12))) for _ in range(3000)]
    for text in ["snake_, next", "foo_.bar", "__init__.py", "fill in ____.", "a ._b", "x,_ y", *mixes]:
        assert [i for p in pieces.pieces(text) for i in ids(p)] == ids(text), text


def test_both_encoders_equal_the_library_on_random_texts():
    """Signs, underscores, marks that compose or move, odd blanks, added tokens, letters with two small forms."""
    import numpy as np

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    automaton, encoder = bpe.WordBpe(vocabulary()), tokens_file.Encoder(vocabulary())
    marks = "\u0301 \u0345 \u0308 \u0903 \u0f71 \u0f72 \u0130 \u2126 \u212a \u0958 \u1fef \u226e \u037e \u2adc \u1100 \u1161 \u11a8 \uac00 \x1c \x1f \x85 \xa0 \u2028 \u200b \x00 \x7f \ufeff"
    alphabet = [*"aabcdeilnorstABÉéß_.,;:!?-'\"$%#*()[]<>|/ \n\t0159²½٣ΣςΩ日本😀ﬁǄ", *marks.split(" "), "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'re", "__init__", "..."]
    rng = random.Random(8)
    for _ in range(100):
        made = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(500)]
        want = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
        ids = automaton.encode(made)
        assert ids.to_pylist() == want
        assert automaton.decode(ids).to_pylist() == library.decode_batch(want, skip_special_tokens=False)
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(made)] == want


def test_remembered_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 3000)
    monkeypatch.setattr(tokens_file, "REMEMBERED_BYTES", 3000)
    encoder, automaton, fresh = tokens_file.Encoder(vocabulary()), bpe.WordBpe(vocabulary()), tokens_file.Encoder(vocabulary())
    rng = random.Random(4)
    for _ in range(60):
        made = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 4))) for _ in range(8)) + " " + "x" * 200]
        fresh.known = pieces.RememberedPieces(fresh.vocabulary, fresh.word, {})
        want = fresh.encode(made)
        assert encoder.encode(made) == want
        assert automaton.encoder.encode(made) == want
        for young, old in ((encoder.known, encoder.known.old), (automaton.encoder.young, automaton.encoder.old)):
            assert len(young) + len(old) < 60
            assert not any(len(p) > pieces.LONG_PIECE for p in young)


def test_elias_fano():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 100, 1000):
        values = np.sort(rng.integers(0, 50 * n + 1, n))
        values[: n // 3] = 0  # empty documents
        coded = tokens_file.EliasFano.of(values, 50 * n)
        back, _ = tokens_file.EliasFano.from_bytes(coded.to_bytes())
        assert back.select(np.arange(n)).tolist() == values.tolist()
        some = rng.integers(0, n, 5) if n else np.zeros(0, np.int64)
        assert back.select(some).tolist() == values[some].tolist()
        assert n < 100 or len(coded.to_bytes()) < n * 1.2 + 48


def test_toxicity(spark, empty):
    rng = random.Random(3)
    words = "the a of and this that with on in for to from".split()
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randint(0, 39)] = rng.choice(["idiot", "scum", "blorp", "blorpish"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    made = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(*made).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out} == set(held)
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.classify(empty, made[1]).count() == 0
    assert toxicity.classify(made[0], made[1].limit(0)).filter("score between 0 and 1").count() == 400


@pytest.mark.parametrize(
    ("text", "marks"),
    [
        ("You are an idiot.", {"insult", "aimed"}),
        ("Idiot, you!", {"insult", "aimed"}),
        ("A clown at the circus entertained people.", {"insult"}),
        ("not an idiot", {"insult", "denied"}),
        ("The paper said that scum was there", {"insult", "reported"}),
        ("He said you are scum", {"insult", "aimed", "reported"}),
        ("I will kill you", {"threat"}),
        ("you should kill yourself", {"threat"}),
        ("I will hurt them", {"weak_threat"}),
        ("You will die", {"weak_threat"}),
        ("They beat the egg. die der das", set()),
        ("He was going to hunt with them.", set()),
        ("People should die with dignity.", set()),
        ("Er will die U Bahn nehmen", set()),
        ("I will. Kill you", set()),
    ],
)
def test_toxic_clauses(text, marks):
    assert {m for events in toxicity.Grammar().events(text) for e in events for m in e} == marks


def test_toxic_composition_equals_the_transducers_run_apart():
    rng = random.Random(5)
    whole = toxicity.Composition()
    for _ in range(300):
        state, apart = 0, list(toxicity.START)
        for c in rng.choices(toxicity.CLASSES, k=rng.randint(1, 25)):
            state, marks = whole.step(state, c)
            moved = [move(s, c) for move, s in zip(toxicity.TRANSDUCERS, apart, strict=True)]
            apart = [s for s, _ in moved]
            out = {m for _, found in moved for m in found}
            assert set(marks) == (out if out & {"insult", "stem", "threat", "weak_threat"} else set())


def test_toxic_clauses_beat_isolated_words(spark):
    """Labels that only position, negation and report explain: the composition tells them, the words alone cannot."""
    rng = random.Random(6)
    forms = [("you are an {}", 1), ("you {} person", 1), ("he is not an {}", 0), ("the paper said {} was written there", 0)]
    rows = []
    for i in range(600):
        form, y = rng.choice(forms)
        rows.append((i, form.format(rng.choice("idiot moron loser scum".split())), y))
    made = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(*made).filter("held_out").collect()}
    toxic, clean = ([got[i] for i, _, y in rows if i in got and y == label] for label in (1, 0))
    assert sum(a > b for a in toxic for b in clean) > 0.99 * len(toxic) * len(clean) > 0


def test_classifiers_with_awkward_rows(spark, docs):
    """Nulls, empty and long texts, repeated rows, and columns named as the results are."""
    labels = spark.createDataFrame([(i, i % 2, i % 3 > 0, "x") for i in range(40)] + [(None, 1, True, "x")], "doc_id long, toxic int, quality boolean, score string").withColumn("quality", F.col("quality").cast("int"))
    more = docs.unionByName(spark.createDataFrame([(99, "plain words " * 40_000, "clash", 1)], docs.schema))
    for found in (toxicity.classify(more, labels), quality_classifier.classify(more, labels)):
        rows = found.collect()
        assert len(rows) == more.count()
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1  # null and empty
        assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert all(not r.held_out for r in rows if r.doc_id is None)


def test_quality_score_follows_the_compressed_sizes(spark):
    """The score is a rising function of the difference of the two sizes, which plain zstandard calls confirm."""
    import zstandard

    rng = random.Random(4)
    good = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(60)) for _ in range(60)]
    model = quality_classifier.fit([(t, 1) for t in good] + [(t.upper().replace(" ", "$ "), 0) for t in good], {0: 60, 1: 60})
    assert model.slope > 0
    for text in (good[0], good[1].upper(), "x" * 3000, "é"):
        sizes = []
        for dictionary in (model.good, model.bad):
            made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), level=quality_classifier.LEVEL, write_content_size=False, write_dict_id=False)
            data = text.encode()
            sizes.append(sum(len(made.compress(data[k : k + 512])) for k in range(0, len(data), 512)))
        assert quality_classifier.difference(text.encode(), model.compressors()) == 100 * (sizes[1] - sizes[0]) / (len(data) + 128)


def test_quality_classifier(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        good = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(80))
        rows.append((i, good if i % 3 else " ".join(f"{w}$$$" for w in good.upper().split())))
    made = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality_classifier.classify(*made).filter("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in got) >= 0.97 * len(got) > 0
    assert quality_classifier.classify(made[0], made[1].limit(0)).filter("score = 0.5").count() == 400
    assert quality_classifier.classify(empty, made[1]).count() == 0


def in_bands(data, chunk=4096):
    """Whether a text's ratio, and those of chunks holding half of it at least, lie in the bands of their lengths."""
    import zstandard

    def inside(part):
        low, high = next((low, high) for end, low, high in quality_rules.BANDS if len(part) < end)
        return low <= len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part) <= high

    parts = [data[k : k + chunk] for k in range(0, len(data), chunk)]
    return bool(data) and inside(data) and (len(parts) == 1 or 2 * sum(len(p) for p in parts if not inside(p)) <= len(data))


def test_quality_rules_of_long_texts(spark):
    rng = random.Random(11)
    word = lambda k=6: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, k)))
    plain = " ".join(word() for _ in range(4000))
    noise = " ".join("".join(chr(rng.randint(33, 1000)) for _ in range(9)) for _ in range(1500))
    made = [plain, plain[:6000] + " " + noise, plain + " " + noise[:3000], ("a b c d e f g h " * 3000), plain[:9000] + " same again" * 500]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    for i, text in enumerate(made):
        assert got[i].kept == (not got[i].base_failed and in_bands(text.encode())), i
    assert {r.kept for r in got.values()} == {True, False}


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.word_chars): r for r in quality_rules.quality_rules(docs).collect()}
    for i, text in texts():
        w = BLANK.findall(text or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
        r = got[(i, sum(map(len, w)))]
        assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert r.kept == (not r.base_failed and in_bands((text or "").encode()))
    assert stages.good_only(docs).columns == docs.columns
    assert quality_rules.quality_rules(empty).count() == 0


PAGE = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{}<footer>&copy; site</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        (PAGE.format("<article><h1>A &amp; B</h1><p>First  one.</p><p>Be.</p></article>"), "A & B\nFirst one.\nBe."),
        (PAGE.format("<article><h1>T</h1><p><b>Bold title.<br><p>Next.</article>"), "T\nBold title.\nNext."),
        (PAGE.format("<div class=ad>Buy now today.</div><article><p>Text here.</p></article><aside><p>See also this.</p></aside>"), "Text here."),
        (PAGE.format("<main><p>Text here stands.</p></main><section id=comments><p>I agree with it.</p></section><form><p>Mail us</p></form>"), "Text here stands."),
        ("<body><article><p>Stops in the mid", "Stops in the mid"),
        ("<script>var t='</p>';</script><article><p>x &lt; y</p></article>", "x < y"),
    ],
)
def test_html_text(html, text):
    assert html_text.model().main_text(html) == text


ARTICLE = "<article><h1>Head line</h1><p>First text stands here.</p>{}<p>Last text stands here.</p></article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>x</title><body>" + ARTICLE.format(""), "Head line\nFirst text stands here.\nLast text stands here."),
        ("<html><head><meta charset=utf-8><title>x</title>" + ARTICLE.format(""), "Head line\nFirst text stands here.\nLast text stands here."),
        *((PAGE.format(ARTICLE.format(x)), "Head line\nFirst text stands here.\nLast text stands here.") for x in ("<svg width=1 />", "<math/>", "<button>", "<object data=a>", "<select>", "<svg><path d='M0'/></svg>", "<canvas>", "<iframe src=a>")),
        (PAGE.format(ARTICLE.format("<button>") + "<button>Send</button>"), "Head line\nFirst text stands here.\nLast text stands here."),
        (PAGE.format(ARTICLE.format("<button>Share</button><select><option>One<option>Two</select>")), "Head line\nFirst text stands here.\nLast text stands here."),
        (PAGE.format(ARTICLE.format("<object data=a><p>Text of the object here.</p></object>")), "Head line\nFirst text stands here.\nText of the object here.\nLast text stands here."),
        (PAGE.format(ARTICLE.format("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here.</p>")), "Head line\nFirst text stands here.\nSo x=2 holds here.\nLast text stands here."),
    ],
)
def test_html_text_loses_nothing_to_missing_end_tags(html, text):
    assert html_text.model().main_text(html) == text


def test_page_scanner_is_linear():
    n = 100_000
    pages = ["<a " + '"' * n, "<div " * n, "<b>" * n + "</div>" * n, "<i>" * n + "<b>" * n + "</i>" * n, "<a '\"" * n, '<a "<a \'' * n + ">", "<!-" * n, "<script " * n, "</x" * n, "<p>" * n + "</p>" * n]
    pages += ["<div>" * n + "</span>" * n + "</p>" * n, "<svg>" * n, "<button>" * n + "</button>" * n, '<p class="' * n, "<li>" * n, "<textarea>" * n, "<a href='" * n + ">", "<div>x" * n + "</section>" * n]
    for page in pages:
        began = time.time()
        html_text.parse(page)
        assert time.time() - began < 20, page[:20]


def test_marginals_equal_all_labellings():
    """Sum-product on a small page against the sum over all labels of its nodes."""
    import math

    model = html_text.model()
    page = html_text.parse("<nav><a href=/>Home</a></nav><main><h1>Head</h1><p>One text stands here.</p><div id=comments>Said.</div></main>")
    elements, blocks = model.unary(page)
    parents = page.parent[1:] + page.owner
    odds = elements + blocks
    odds[0] += model.root
    pairs = [model.pairs[html_text.kind(page.tag[p], page.marks[p])] for p in parents]
    total, on = 0.0, [0.0] * len(blocks)
    for labels in itertools.product((0, 1), repeat=len(odds)):
        weight = math.exp(sum(o for o, y in zip(odds, labels, strict=True) if y))
        for child, parent in enumerate(parents, 1):
            weight *= pairs[child - 1][labels[parent]][labels[child]]
        total += weight
        for k in range(len(blocks)):
            on[k] += weight * labels[len(elements) + k]
    assert model.marginals(page) == pytest.approx([v / total for v in on], abs=1e-9)


def test_pages_of_held_out_layouts():
    """Trained on five sixths of the layouts, the model reads pages of the others; the messages help."""
    import numpy as np

    right = alone = total = 0
    for k in range(6):
        part = lambda held, k=k: {n: [x for i, x in enumerate(v) if (i % 6 == k) == held] for n, v in (("main", html_pages.MAIN), ("before", html_pages.BEFORE), ("after", html_pages.AFTER))}
        model = html_text.train(html_pages.labelled_pages(400, **part(False)))
        without = html_text.TreeModel(model.weights, np.ones((2, 2)), 0.0)
        for text in html_pages.labelled_pages(100, seed=5, **part(True)):
            page = html_text.parse(text)
            marked = [False] * len(page.tag)
            for e in range(1, len(page.tag)):
                marked[e] = marked[page.parent[e]] or "data-main" in page.marks[e]
            page.marks = [m - {"data-main"} for m in page.marks]
            for at, p, q in zip(page.owner, model.marginals(page), without.marginals(page), strict=True):
                right, alone, total = right + (marked[at] == (p >= 0.5)), alone + (marked[at] == (q >= 0.5)), total + 1
    assert right / total > 0.96
    assert right > alone


def test_extract_with_awkward_rows(spark):
    page = PAGE.format("<article><h1>A</h1><p>Text stands here.</p></article>")
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (2, None, None, None, None), (None, "v", "", "x", 1), (3, "w", "<p>" * 50_000 + page, "x", 2)]
    made = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(made).collect()), key=str)
    body = "A\nText stands here."
    assert got == sorted([(1, "u", body, len(body))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", body, len(body))], key=str)
    assert html_text.extract(made.limit(0)).count() == 0


def test_warc_with_awkward_rows(spark):
    big = "é" * 600
    rows = [("a>\r\nWARC-Type: revisit", "u", big, "x"), (None, None, big, "x"), ("%0A", "u\r\n\r\nx", "\r\nWARC-Refers-To: <urn:page:9>\r\n\r\n", "x"), ("b", "u", "", None), ("b", "u", "", None)]
    made = spark.createDataFrame(rows, "page_id string, url string, html string, record_type string")
    archive = warc.write_archive(made)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(archive).collect()), key=str)
    first = rows[0][0]
    assert got == sorted([(first, 1200, "response", None), (None, 1200, "revisit", first), ("%0A", len(rows[2][2]), "response", None), ("b", 0, "response", None), ("b", 0, "response", None)], key=str)
    assert sorted(str((r.page_id, r.url)) for r in warc.records(archive).collect()) == sorted(str(r[:2]) for r in rows)
    assert warc.report(warc.write_archive(made.limit(0))).count() == 0


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/%0A\n", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (3, "u", big)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(archive).collect())
    assert got == sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, _, h in rows)
    back = sorted(((r.page_id, r.url, bytes(r.payload).decode()) for r in warc.records(archive).collect()), key=str)
    assert back == sorted(((i, u, h or "") for i, u, h in rows), key=str)
    assert archive.payloads.count() == 3
    for r in warc.records(archive).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4


def pipeline_texts():
    """Good documents, copies and near copies of one, lines that several share, a benchmark passage, and bad ones."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    own = lambda n=5: "\n".join(line(15) for _ in range(n))
    shared, passage, base = line(12), line(14), [word() for _ in range(90)]
    near = [*base[:40], "other", *base[41:]]
    changed = shared.split()
    changed[5] = "zz"
    return passage, [own(), own(), " ".join(base), " ".join(base), " ".join(near), own(4) + "\n" + shared, shared + "\n" + own(4), own(3) + "\n" + " ".join(changed) + "\n" + own(2), own(4) + " " + passage, "same words again " * 60, "short text", "", None, own(6)]


def test_pipeline_equals_a_brute_force_version(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    passage, made = pipeline_texts()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(made)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def good(text):
        w = BLANK.findall(text or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w) and in_bands(text.encode())

    left = {i: t for i, t in enumerate(made) if good(t)}
    places = [(i, k, x) for i, t in left.items() for k, x in enumerate(t.split("\n"))]
    parent = list(range(len(places)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(places)), 2):
        x, y = places[a][2], places[b][2]
        if 5 * edit_distance(x, y) <= max(len(x), len(y)):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    left = {i: "\n".join(x for at, (j, _, x) in enumerate(places) if j == i and root(at) == at) for i in left}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, t in left.items() for w in (BLANK.findall(t),)}
    group = {i: min([j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], default=i) for i in sets}
    left = {i: t for i, t in left.items() if group[i] == i}
    windows = [" ".join(passage.split()[k : k + 10]) for k in range(5)]
    left = {i: t for i, t in left.items() if not any(w in " ".join(t.split()) for w in windows)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left) and 4 < len(left) < 10
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids, i
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_pipeline_stages_with_awkward_rows(spark, tmp_path):
    """Null ids, repeated rows, extra columns with clashing names, and an empty table."""
    import corpus_pipeline

    text = pipeline_texts()[1][0]
    rows = [(1, text, 5, "x", "y", "z"), (1, text, 5, "x", "y", "z"), (None, text + "\nlast words of it", 5, None, None, None), (None, None, None, None, None, None), (4, "", None, "x", "y", "z")]
    made = spark.createDataFrame(rows, "doc_id long, text string, n_words int, hits string, n_removed string, _perhaps string")
    spark.createDataFrame([("q", None), (None, "one two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (made, made.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, stage(spark, now, str(tmp_path)).checkpoint()
            assert now.dtypes == start.dtypes
            assert now.count() <= before.count()
            assert {tuple(r)[2:] for r in now.collect()} <= {tuple(r)[2:] for r in start.collect()}
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert tokens.count() == now.count()
        assert (now.count() > 0) == (start is made)


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    storage.shared_dir(spark)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, d).checkpoint()
        assert now.columns == docs.columns
        assert 0 < now.count() <= before.count()
    left = now.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert left.filter("quality = 1").count() > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, d)
    assert tokens.count() == now.count()
    assert tokens.filter("size(ids) <> n_tokens").count() == 0
