"""Joins in which one side's keys may be very common and the other side's mostly unasked for.

Both are told by one summary of the keys that are asked for: a table of at most `WORDS` rows, broadcast
at this size whatever the input. It holds 64 bits of membership a row, so rows whose key is not
asked for stay where they are (but for a few), and how many parts the commonest key of the row is to be
joined in, so that no task gets more than about `HEAVY` rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16
HEAVY = 100_000  # rows of a key that are joined in one task


def _word(key: str) -> str:
    return f"xxhash64(`{key}`) & {WORDS - 1}"


def _bit(key: str) -> str:
    return f"cast(shiftrightunsigned(xxhash64(`{key}`), 32) & 63 as int)"


def key_summary(counts: DataFrame, key: str, n: str = "n", heavy: int = HEAVY) -> DataFrame:
    """(_word, _bits, _parts) of a table of keys and how often each occurs."""
    return counts.groupBy(F.expr(_word(key)).alias("_word")).agg(
        F.expr(f"bit_or(shiftleft(1L, {_bit(key)}))").alias("_bits"),
        F.greatest(F.ceil(F.max(n) / heavy), F.lit(1)).cast("int").alias("_parts"),
    )


def asked_for(df: DataFrame, key: str, summary: DataFrame) -> DataFrame:
    """Rows whose key may be in the summary, with `_parts`: all whose key is, and a few others."""
    held = df.join(F.broadcast(summary), F.expr(f"({_word(key)}) = _word"))
    return held.filter(F.expr(f"shiftrightunsigned(_bits, {_bit(key)}) & 1L = 1L")).drop("_word", "_bits")


def salted_join(many: DataFrame, few: DataFrame, key: str, counts: DataFrame, by: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """Joins `many` with `few`, which has a key once, on `key`.

    `counts` (key, n) has every key that is asked for; rows of `many` whose key it lacks need not come
    back. Rows of a heavy key are dealt over its parts by the column `by`, and its row of `few` is copied to each.
    """
    summary = key_summary(counts, key, heavy=heavy)
    left = asked_for(many, key, summary).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_parts")
    right = asked_for(few, key, summary).withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1L)"))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
