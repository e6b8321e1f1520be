"""Measures of a text that need a set of its n-grams or a walk over its lines.

Spark's higher-order functions are interpreted element by element; these take Arrow batches of texts and
let Python's own string methods do the work, some ten times as fast. A row is measured by itself, so
nothing is shuffled. White space is what Python strips and splits at. Null texts measure as empty ones.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# What a speaker label looks like, and the ASCII punctuation characters.
LABEL = r"^(?:\[?)(Speaker\s*\d+|Host|Guest|Co-host|[A-Z][a-z]+)(?:\]?):\s*"
PUNCTUATION = r"[!-/:-@\[-`{-~]"

_LABEL = re.compile(LABEL, re.ASCII)
_PUNCTUATION = re.compile(PUNCTUATION + "+")


def normal_words(text: str | None) -> list[str]:
    """Words of a text in lower case and without punctuation."""
    return _PUNCTUATION.sub("", (text or "").lower()).split()


def grams(words: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[k:] for k in range(n))))


def distinct_share(words: list[str], n: int) -> float:
    """Different n-grams over all n-grams; 0.0 with fewer than n words."""
    found = grams(words, n)
    return len(set(found)) / len(found) if found else 0.0


def turns_of(text: str | None) -> tuple[int, int]:
    """Turns of a labelled transcript and the words in them.

    A line without a label continues the turn before it; lines before the first label count for
    nothing, nor do labels without a word.
    """
    turns = words = 0
    labelled = filled = False
    for line in (text or "").split("\n"):
        line = line.strip()
        if label := _LABEL.match(line):
            labelled, filled, line = True, False, line[label.end() :]
        n = len(line.split())
        if labelled and n:
            turns += not filled
            words += n
            filled = True
    return turns, words


def distinct_n(text: Column, n: int = 2) -> Column:
    """distinct_share of the normal words of a text."""

    @F.pandas_udf(DoubleType())
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: distinct_share(normal_words(t), n)).astype("float64")

    return measured(text)


def max_ngram_repeat(text: Column, n: int) -> Column:
    """How often the commonest n-gram of a text's words occurs, 0 where there is none."""

    @F.pandas_udf(LongType())
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(Counter(grams((t or "").split(), n)).values(), default=0)).astype("int64")

    return measured(text)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("turns", "words")]))
def turn_counts(texts: pd.Series) -> pd.DataFrame:
    """turns_of each text."""
    return pd.DataFrame([turns_of(t) for t in texts], columns=["turns", "words"], dtype="int64")


@F.pandas_udf(StructType([StructField(c, DoubleType() if c == "distinct2" else LongType()) for c in ("words", "distinct2", "turns", "turn_words")]))
def transcript_measures(texts: pd.Series) -> pd.DataFrame:
    """Words, distinct pairs of normal words, turns and the words in them: a text goes to Python once."""
    rows = [(len((t or "").split()), distinct_share(normal_words(t), 2), *turns_of(t)) for t in texts]
    return pd.DataFrame(rows, columns=["words", "distinct2", "turns", "turn_words"]).astype({"words": "int64", "distinct2": "float64", "turns": "int64", "turn_words": "int64"})
