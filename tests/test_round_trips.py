"""Results written as files and read back: every text and null returns, and files by the thousand are few folders."""

import os

from pyspark.sql import functions as F

import __spark_entry__
from turnloom.plans import adapters
from turnloom.sources import files


def test_csv_tells_null_from_the_empty_text_and_keeps_every_sign(spark, tmp_path):
    texts = [None, "", r"\N", "\\", "\\\\N", '"', '""', "\0", '"\0"', "a\0,\nb", "\r", "a\r\nb", " ", "\t x "]
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    got = __spark_entry__.queries()["s8_csv_round_trip"](spark, str(tmp_path / "in"))
    assert {r.doc_id: (r.text, r.lang) for r in got.collect()} == {k: (t, t) for k, t in enumerate(texts)}
    # the plain form keeps U+0000 in quoted texts as well
    files.write_csv(rows.filter("text <> ''"), str(tmp_path / "plain"))
    assert {r.doc_id: r.text for r in files.read_csv(spark, str(tmp_path / "plain"), rows.schema).collect()} == {k: t for k, t in enumerate(texts) if t}


def documents(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    return str(tmp_path / "in")


def folders_below(path):
    return [d for d, _, names in os.walk(path) if names]


def test_transcripts_are_files_by_the_thousand_in_a_folder(spark, tmp_path, monkeypatch):
    texts = {k: f"line {k}\n\tÄ  'q'\n" for k in range(2500)} | {7: None, 8: "", 9: " \r\n ", 2004: "x" * 3_000_000}
    source = documents(spark, tmp_path, [(k, t, "en", "s", 1) for k, t in texts.items()])
    monkeypatch.setattr(adapters, "scratch", lambda spark, what: str(tmp_path / what))
    got = {(r["sample"], r.model): (r.content, r.stated) for r in __spark_entry__.queries()["s4_load_transcripts"](spark, source).collect()}
    want = {(r["sample"], r.model): r.content for r in adapters.transcripts(spark, source).collect()}
    assert {k: c for k, (c, _) in got.items()} == want and len(got) == 2500
    assert got[3, "b"] == (None, None) and {s for k, (_, s) in got.items() if k != (3, "b")} == {k % 1000 for k in texts}
    assert len(folders_below(tmp_path / "transcripts")) == 3


def test_files_at_a_folder_a_file_and_a_pattern(spark, tmp_path):
    names = ["s 1/transcript_a.txt", "s 1/transcript_b.txt", "s2/x/transcript_a.txt", "s2/notes.txt", "t/transcript_c.txt"]
    rows = spark.createDataFrame([(n, f"Word count: {k}\n===\nHost: é{k}") for k, n in enumerate(names)], "name string, value string")
    assert files.write_each(rows.repartition(3), str(tmp_path / "d")) == 5
    found = lambda path: {r.path.removeprefix(f"file:{tmp_path}/d/") for r in files.files_at(spark, path).collect()}
    assert found(f"{tmp_path}/d") == set(names)
    assert found(f"{tmp_path}/d/s 1/transcript_a.txt") == {names[0]}
    assert found(f"{tmp_path}/d/s*") == set(names[:4])
    assert found(f"{tmp_path}/d/*/*.txt") == {names[0], names[1], names[3], names[4]}
    assert found(f"{tmp_path}/d/{{s2,t}}/transcript_?.txt") == {names[4]}
    assert found(f"{tmp_path}/lost") == set()
    got = {tuple(r) for r in files.load_transcripts(spark, f"{tmp_path}/d").collect()}
    assert got == {("s 1", "a", "Host: é0", 0), ("s 1", "b", "Host: é1", 1), ("x", "a", "Host: é2", 2), ("t", "c", "Host: é4", 4)}


def test_image_files_of_odd_sources_are_few_folders(spark, tmp_path, monkeypatch):
    sources = ["a/b c", "", ".", "100%=é*", None]
    source = documents(spark, tmp_path, [(k, "some words here", "en", sources[k % 5], 1) for k in range(3000)])
    monkeypatch.setattr(adapters, "scratch", lambda spark, what: str(tmp_path / what))
    got = {r.source: (r.files, r.bytes) for r in __spark_entry__.queries()["s7_image_inventory"](spark, source).collect()}
    rows = adapters.inventory(spark, source).withColumn("episode", F.split("filename", "_")[0]).groupBy("source").agg(F.countDistinct("episode").alias("files"), F.sum("size").alias("bytes"))
    want = {r.source: (r.files, r.bytes) for r in rows.collect() if r.source is not None}
    assert got == want and set(got) == set(sources) - {None}
    assert len(folders_below(tmp_path / "images")) == 4
