"""Folder listings, line positions, turn order over files, exact samples, early stops, common keys, one move of texts, vector scores."""

import gzip
import json
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.operators import choice, compare, excerpts, media, mix, skew, turns
from turnloom.sources import files, folders, lines
from turnloom.streaming.turns import stream_turns


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def settle(path):
    """Sets the times of change of all folders back, as if nothing had changed for long."""
    for folder, _, _ in os.walk(path):
        os.utime(folder, (1_000_000_000, 1_000_000_000))


# ---- folders ------------------------------------------------------------------------------------
def tree(tmp_path, names):
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))


def test_listing_equals_the_reader_of_binary_files(spark, tmp_path):
    tree(tmp_path, ["a.png", "b/c/d e.jpg", "b/c/é.png", "b/x.txt", "_hidden/e.png", ".f.png", "b/_tmp.png", "k=1/_v=2/g.png", "deep/" * 6 + "h.jpg", "b/%41.png"])
    (tmp_path / "empty").mkdir()
    got = files.image_inventory(spark, str(tmp_path), "s")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg}").load(str(tmp_path)).select("path", "length")
    assert sorted((r.path, r.size) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert {r.filename for r in got.collect()} == {"a.png", "d e.jpg", "é.png", "g.png", "h.jpg", "%41.png"}


def test_only_changed_folders_are_listed_again(spark, tmp_path, monkeypatch):
    tree(tmp_path, [f"f{k}/i{j}.png" for k in range(5) for j in range(3)] + ["f1/sub/x.png", "f2/sub/y.png"])
    settle(tmp_path)
    before = folders.folder_listing(spark, str(tmp_path)).checkpoint()
    tree(tmp_path, ["f1/new.png", "f6/first.png"])
    (tmp_path / "f3" / "i0.png").unlink()
    # a file that changes without its folder is not seen again: proof that its folder was not listed
    (tmp_path / "f4" / "i0.png").write_bytes(b"x" * 99)
    after = folders.folder_listing(spark, str(tmp_path), before)
    sizes = {r.path.removeprefix(f"file:{tmp_path}/"): r.size for r in folders.files_of(after).collect()}
    assert set(sizes) == {f"f{k}/i{j}.png" for k in range(5) for j in range(3)} - {"f3/i0.png"} | {"f1/sub/x.png", "f2/sub/y.png", "f1/new.png", "f6/first.png"}
    assert sizes["f4/i0.png"] == len("f4/i0.png")
    known = {r.folder: r.changed for r in after.filter("kind = 'self'").collect()}
    # folders that have just changed may change again: their times are not kept, so they are listed next time
    assert known[f"file:{tmp_path}/f1"] is None and known[f"file:{tmp_path}/f0"] == 1_000_000_000_000_000
    again = folders.folder_listing(spark, str(tmp_path), after)
    assert sorted(map(str, again.drop("changed").collect())) == sorted(map(str, after.drop("changed").collect()))


def test_listing_of_nothing(spark, tmp_path):
    assert folders.folder_listing(spark, str(tmp_path / "lost")).count() == 0
    assert [r.kind for r in folders.folder_listing(spark, str(tmp_path)).collect()] == ["self"]


@pytest.mark.parametrize(("names", "yes", "no"), [("*.{png,jpg}", "a.b.png", "a.gif"), ("x?.t", "xy.t", "xyz.t"), ("[!a]*", "bc", "ab"), ("a+b", "a+b", "aab")])
def test_glob_patterns(names, yes, no):
    assert re.match(folders.glob_pattern(names), yes) and not re.match(folders.glob_pattern(names), no)


# ---- lines --------------------------------------------------------------------------------------
def texts_of_files(rng):
    odd = ["", "x", "é" * 5, "long " * 30, "{broken", '{"a": 1}', "cr\r"]
    out = {}
    for name in ("a.txt", "b/c.txt", "b/d.txt", "e.txt", "f.txt.gz", "g.txt"):
        out[name] = [rng.choice(odd) for _ in range(rng.randint(0, 40))]
    return out


@pytest.mark.parametrize(("range_bytes", "last"), [(3, "\n"), (40, ""), (1 << 20, "")])
def test_positions_of_lines(spark, tmp_path, range_bytes, last):
    rng = random.Random(range_bytes)
    content = texts_of_files(rng)
    expected = []
    for name, own in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        data = ("\n".join(own) + (last if own else "")).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        expected += [line.removesuffix("\r") for line in (data.decode().removesuffix("\n").split("\n") if data else [])]
    index = lines.line_index(folders.files_of(folders.folder_listing(spark, str(tmp_path))), range_bytes).checkpoint()
    assert index.agg(F.sum("lines")).first()[0] == len(expected)
    for start, count in ((0, len(expected)), (len(expected) // 2, 10), (len(expected) + 5, 3)):
        got = sorted(map(tuple, lines.read_lines(index, start, count).collect()))
        assert got == list(enumerate(expected))[start : start + count]


def test_a_slice_opens_only_its_ranges(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"id": 100 * k + j}) + "\n" if j % 10 else "{cut\n" for j in range(100)))
    index = lines.line_index(folders.files_of(folders.folder_listing(spark, str(tmp_path))), 500).checkpoint()
    used = lines.ranges_of(index, 250, 20)
    assert {r.path.rpartition("/")[2] for r in used.collect()} == {"2.jsonl"} and used.count() <= 2 < index.count() / 6
    for k in (0, 1, 3, 4, 5):
        (tmp_path / f"{k}.jsonl").unlink()  # other ranges are not opened, so their files may be gone
    got = lines.parsed_lines(lines.read_lines(index, 250, 20), "id long").orderBy("position").collect()
    assert [(r.position, r.id, r.broken) for r in got] == [(p, None if p % 10 == 0 else p, p % 10 == 0) for p in range(250, 270)]


# ---- turn order ---------------------------------------------------------------------------------
def test_turns_keep_the_order_of_their_files(spark, tmp_path):
    """Three files of different sizes, each over several parts: Spark's tasks take the largest parts first."""
    rng = random.Random(1)
    said = []
    for name, count in (("a.jsonl", 5), ("b.jsonl", 400), ("c.jsonl", 90)):
        with (tmp_path / name).open("w") as file:
            for _ in range(count):
                text = f"turn number {len(said)} " + "word " * rng.randint(0, 30)
                said.append((rng.choice(["x", "y", "z"]), text.strip()))
                file.write(json.dumps({"mp3url": "u", "speaker": [said[-1][0]], "turnText": said[-1][1]}) + "\nbroken\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = files.read_turns(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 3
        found = turns.assemble_transcripts(turns.clean_turns(read), most_chars=10**7).first()
        labelled = turns.relabel_speakers(read).select("turn_idx", "speaker_no", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    number = {s: k for k, s in enumerate(dict.fromkeys(s for s, _ in said), 1)}
    assert found.transcript.split("\n\n") == [f"Speaker {number[s]}: {t}" for s, t in said]
    assert [(r.speaker_no, r.text) for r in sorted(labelled, key=lambda r: r.turn_idx)] == [(number[s], t) for s, t in said]


def test_streamed_turns_equal_the_batch(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("".join(json.dumps({"mp3url": f"u{k}", "speaker": ["s"], "turnText": t}) + "\n" for t in ("[Music] la la la la", " hello there you all ", "short", f"number {k} is here now")) + "broken\n")
    rows = stream_turns(spark, str(tmp_path / "in"), files_per_trigger=1)
    write = lambda: rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    write()
    got = lambda: sorted((r.episode_url, r.text) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())
    assert got() == sorted((f"u{k}", t) for k in range(3) for t in ("hello there you all", f"number {k} is here now"))
    (tmp_path / "in" / "3.jsonl").write_text(json.dumps({"mp3url": "u3", "speaker": ["s"], "turnText": "one more turn comes"}) + "\n")
    write()  # only the new file
    assert len(got()) == 7 and got()[-1] == ("u3", "one more turn comes")


# ---- samples and early stops ---------------------------------------------------------------------
@pytest.mark.parametrize(("percent", "edge"), [(0, 1), (0.05, 1), (29.0, 10_000), (50, 1), (99.99, 10_000)])
def test_exact_sample_is_the_first_by_hash(spark, monkeypatch, percent, edge):
    monkeypatch.setattr(mix, "EDGE_ROWS", edge)
    monkeypatch.setattr(mix, "PREFIX_DIGITS", 2)
    df = spark.range(3000).withColumn("wide", F.lit("w"))
    out = mix.exact_sample(df, percent, 7, "id")
    first = df.select("id", mix.seeded(7, "id").alias("h")).orderBy("h").limit(int(3000 * percent / 100.0))
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in first.collect())
    assert "Exchange" not in plan(out)[1] and "Sort" not in plan(out)[1]


def test_exact_sample_where_rows_share_a_key(spark):
    df = spark.range(900).selectExpr("if(id < 600, 5, id) as id", "id as row")
    for percent in (10, 40, 75):
        out = mix.exact_sample(df, percent, 3, "id").collect()
        assert len(out) == len({r.row for r in out}) == int(900 * percent / 100.0)
    assert mix.exact_sample(df.limit(0), 10, 3, "id").count() == 0
    assert mix.exact_sample(spark.createDataFrame([(None,)] * 4, "id long"), 50, 3, "id").count() == 2


@pytest.mark.parametrize(("target", "existing"), [(0, 0), (1, 0), (40, 35), (150, 0), (10**6, 35)])
def test_take_until_target(spark, target, existing):
    rng = random.Random(2)
    rows = [(7 + 3 * k, rng.choice([0, 0, 1, 3])) for k in range(200)]
    status = spark.createDataFrame([*rows, (None, 4)], "episode_idx long, num_excerpts long").repartition(3)
    total, expected = existing, []
    for index, n in rows:
        if total >= target:
            break
        total += n
        expected.append((index, n, total - existing))
    got = excerpts.take_until_target(status, target, existing, first_range=16).select("episode_idx", "num_excerpts", "running")
    assert sorted(map(tuple, got.collect())) == expected
    assert excerpts.take_until_target(status.limit(0), target).count() == 0


def test_take_until_target_reads_no_further(spark, tmp_path):
    spark.range(0, 100_000, 1, 20).selectExpr("id as episode_idx", "1L as num_excerpts").write.parquet(str(tmp_path / "s"))
    status = spark.read.parquet(str(tmp_path / "s"))
    seen = status.select("*", F.input_file_name().alias("file"))
    got = excerpts.take_until_target(seen, 50, first_range=64)
    assert got.count() == 50
    filtered = status.filter("episode_idx >= 0 and episode_idx < 64")
    assert "LessThan(episode_idx,64)" in plan(filtered)[1]
    opened = {r.file for r in got.collect()}
    assert len(opened) == 1


# ---- common keys --------------------------------------------------------------------------------
@pytest.mark.parametrize("heavy", [3, 100_000])
def test_missing_media_with_one_path_in_all_records(spark, heavy):
    rng = random.Random(3)
    rows = [(k, ["lost.jpg", *rng.choices([f"i{j}.jpg" for j in range(30)], k=3)], ["v.mp4"] * (k % 3)) for k in range(200)] + [(900, [], []), (901, [None, "lost.jpg"], [])]
    there = [f"i{j}.jpg" for j in range(0, 30, 2)]
    got = media.missing_media(spark.createDataFrame(rows, "record_id long, image array<string>, video array<string>"), spark.createDataFrame([(p,) for p in there * 2], "path string"), heavy)
    want = {k: sorted(p for p in i + v if p and p not in there) for k, i, v in rows}
    assert {r.record_id: r.missing for r in got.collect()} == {k: m for k, m in want.items() if m}


def test_a_common_key_is_dealt_over_parts(spark):
    many = spark.range(1000).selectExpr("if(id < 900, 'hot', concat('k', id)) as key", "id")
    few = spark.createDataFrame([("hot", 1), ("k950", 2), ("unasked", 3)], "key string, v int")
    counts = many.groupBy("key").agg(F.count("*").alias("n"))
    summary = skew.key_summary(counts, "key", heavy=100)
    assert skew.asked_for(many.filter("key = 'hot'"), "key", summary).select("_parts").distinct().collect()[0][0] == 9
    assert summary.count() <= skew.WORDS
    assert skew.asked_for(few, "key", summary).filter("key = 'unasked'").count() == 0
    got = skew.salted_join(many, few, "key", counts, "id", "left", heavy=100)
    assert sorted(map(str, got.select("key", "id", "v").collect())) == sorted(map(str, many.join(few, "key", "left").select("key", "id", "v").collect()))


@pytest.mark.parametrize("heavy", [2, 100_000])
def test_image_references_by_many_rows(spark, heavy):
    image = {k: f"image {k} " * 20 for k in range(20)}
    rows = [(k, image[k], "clash") for k in image] + [(100 + k, "3", "clash") for k in range(150)] + [(300 + k, str(k % 25), None) for k in range(60)] + [(500, None, None), (501, "100", None)]
    items = spark.createDataFrame(rows, "index long, image string, n string")
    got = {r["index"]: (r.resolved, r.problem) for r in choice.resolve_image_refs(items, heavy).collect()}
    for index, value, _ in rows:
        if value is None:
            assert got[index] == (None, None)
        elif len(value) > 64:
            assert got[index] == (value, None)
        else:
            held = image.get(int(value))
            assert got[index] == (held, None if held else "unresolved_image")
    assert len(got) == len(rows)


def test_only_images_that_are_referred_to_are_moved(spark):
    """Of 2,000 images ten are asked for; a few more pass the summary by chance."""
    holders = spark.range(2000).selectExpr("cast(id as string) as _ref", "repeat('x', 100) as resolved")
    asked = spark.range(10).selectExpr("cast(id * 7 as string) as _ref", "1L as n")
    assert 10 <= skew.asked_for(holders, "_ref", skew.key_summary(asked, "_ref")).count() <= 12


# ---- one move of texts --------------------------------------------------------------------------
def test_transcripts_move_texts_once(spark):
    """Of the plan's exchanges one holds the texts; the others hold speakers and lengths."""
    rows = [(f"e{k % 7}", k, [f"s{k % 3}"], f"text of turn {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "episode_url string, turn_idx long, speaker array<string>, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = turns.assemble_transcripts(df)
        tree = out._jdf.queryExecution().executedPlan().initialPlan()
        found = []

        def walk(node):
            if node.nodeName() == "Exchange":
                found.append(node.output().mkString(","))
            children = node.children()
            for k in range(children.size()):
                walk(children.apply(k))

        walk(tree)
        assert len(found) >= 2
        assert sum(bool(re.search(r"\b(text|transcript|lines?)#", x)) for x in found) == 1
        got = {r.episode_url: (r.transcript, r.n_speakers, r.n_chars) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for episode in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == episode]
        number = {s: k for k, s in enumerate(dict.fromkeys(r[2][0] for r in own), 1)}
        text = "\n\n".join(f"Speaker {number[r[2][0]]}: {r[3]}" for r in own)
        assert got[episode] == (text, len(number), len(text))


def test_turns_with_ties_nulls_and_long_episodes(spark):
    rows = [("a", 1, ["x"], "one"), ("a", 1, ["y"], "two"), ("a", 2, None, "three"), ("a", 3, [], None), (None, 1, ["x"], "lost"), ("long", 1, ["x"], "t" * 60_000)]
    df = spark.createDataFrame(rows, "episode_url string, turn_idx long, speaker array<string>, text string")
    got = {r.episode_url: r for r in turns.assemble_transcripts(df).collect()}
    assert set(got) == {"a", "long"} and got["long"].transcript is None and got["long"].n_chars == 60_011
    assert got["a"].transcript == "Speaker 1: one\n\nSpeaker 1: two\n\nSpeaker 2: three" and got["a"].n_chars == len(got["a"].transcript)
    assert sorted((r.turn_idx, r.speaker_no) for r in turns.relabel_speakers(df).filter("episode_url = 'a'").collect()) == [(1, 1), (1, 1), (2, 2), (3, 2)]


# ---- vectors ------------------------------------------------------------------------------------
def test_cosines_against_one_pair_at_a_time():
    rng = np.random.default_rng(4)
    vectors = [None, [], [0.0, 0.0], [1.0, None], *(rng.normal(size=d).tolist() for d in (2, 2, 3, 3, 1))]
    pairs = [(a, b) for a in vectors for b in vectors]

    def one(a, b):
        if a is None or b is None or len(a) != len(b) or not a or None in a or None in b:
            return None
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norm if norm else None

    for skip in (0, 5):
        kind = pa.list_(pa.float32() if skip else pa.float64())
        left, right = (pa.array([p[k] for p in pairs], kind).slice(skip) for k in (0, 1))
        for got, (a, b) in zip(compare.cosines(left, right).to_pylist(), pairs[skip:], strict=True):
            assert got == (None if one(a, b) is None else pytest.approx(one(a, b), abs=1e-6))


def test_alignment_takes_the_first_five_images(spark):
    t = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)]
    i = [(1, k, [1.0, float(k)]) for k in range(9)] + [(2, 0, [0.0, -1.0]), (4, 0, [1.0, 1.0]), (5, 0, [1.0, 1.0])]
    got = {r.sample_id: (r.score, r.n_images) for r in compare.alignment_score(spark.createDataFrame(t, "sample_id long, vector array<float>"), spark.createDataFrame(i, "sample_id long, image_no int, vector array<float>")).collect()}
    assert got[1] == (pytest.approx(sum(100 / (1 + k * k) ** 0.5 for k in range(5)) / 5, abs=1e-6), 5)
    assert got[2] == (0.0, 1) and got[3] == got[4] == got[5] == (None, 0)
