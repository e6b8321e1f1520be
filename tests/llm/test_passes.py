"""Decontamination in many passes: what is stored between them, and results on awkward rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.llm import decontaminate

WORDS = [f"w{k}" for k in range(60)]


def test_passes_store_hits_and_no_texts(spark, monkeypatch):
    items = [(f"i{k}", " ".join(WORDS[k : k + 12])) for k in range(0, 48, 6)] + [("short", "alpha beta"), (None, "gamma"), ("empty", "")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    hit = " ".join(WORDS[3:40]) + " alpha beta"
    rows = [(1, hit, 5), (1, "gamma", 6), (2, hit, 7), (2, hit, 7), (None, hit, 8), (3, None, 9), (4, "", 10), (5, "nothing of it " * 50, 11), (6, "Gamma, ALPHA; beta!", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans_digest long").repartition(3)
    once = sorted(decontaminate.contamination(docs, benchmark).collect(), key=str)
    assert sum(r.contaminated for r in once) == 6 and len(once) == len(rows)

    kept = []
    write = decontaminate.stored

    def watched(df, what):
        kept.append((what, df.columns))
        return write(df, what)

    monkeypatch.setattr(decontaminate, "stored", watched)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 4)
    assert sorted(decontaminate.contamination(docs, benchmark).collect(), key=str) == once
    assert len(kept) > 3 and not any("text" in columns for _, columns in kept)
    assert all(columns == ["digest", "spans", "items"] for what, columns in kept if what == "pass-hits")
    found = decontaminate.find_windows(docs.select("text", F.col("spans_digest").alias("own")), benchmark, into="hits")
    assert sorted(r.own for r in found.filter(F.size("hits") == 0).collect()) == [9, 10, 11]
