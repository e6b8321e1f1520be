"""The operators as filtering stages over a table of documents: columns in, the same columns out.

Columns that an operator does not read have neutral names while it runs, so theirs never clash with its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from .storage import with_perhaps


def plain(docs: DataFrame, *read: str) -> DataFrame:
    """The documents with all columns but those of the given names renamed by their place."""
    return docs.toDF(*(c if c in read else f"_c{k}" for k, c in enumerate(docs.columns)))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in `ids`. Only documents that a bounded bitmap cannot clear are shuffled."""
    named = plain(docs, "doc_id")
    marked = with_perhaps(named, "doc_id", ids, "_perhaps")
    kept = marked.filter("not _perhaps").unionByName(marked.filter("_perhaps").join(ids, "doc_id", "left_anti"))
    return kept.select(*named.columns).toDF(*docs.columns)


def good_only(docs: DataFrame) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def lines_once(docs: DataFrame) -> DataFrame:
    """Documents without lines that are kept elsewhere; `n_chars` follows the text. No document goes."""
    named = plain(docs, "doc_id", "text", "n_chars")
    out = line_dedup.dedup_lines(named)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*named.columns).toDF(*docs.columns)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicate documents, the one with the smallest doc_id."""
    found = ngram_join.jaccard_components(docs)
    return without(docs, found.filter("component_id <> doc_id").select("doc_id").distinct())


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    named = plain(docs, "text")
    found = decontaminate.find_windows(named, benchmark, into="hits")
    return found.filter(F.size("hits") == 0).select(*named.columns).toDF(*docs.columns)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    return bpe.encode(docs, path)
