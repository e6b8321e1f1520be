"""Putting datasets together: unions, exact samples, and tables of prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: of a hash's hexadecimal digits, those that a histogram tells apart at once, and the rows that are small enough to be chosen from one by one
PREFIX_DIGITS = 4
HASH_DIGITS = 32
EDGE_ROWS = 10_000


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """The sources' rows with their name in `source`."""
    return reduce(DataFrame.unionByName, (df.withColumn("source", F.lit(name)) for name, df in sources.items()))


def parse_spec(spec: str) -> list[tuple[str, float]]:
    """Names and percentages of a list such as `a%29,b`; 100 where none is given."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, share = part.partition("%")
        out.append((name, float(share) if share else 100.0))
    return out


def seeded(seed: int, *key: str) -> Column:
    """A reproducible shuffle key: md5 of the seed and the key columns."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def _edge(order: DataFrame, percent: float) -> tuple[str, int, int] | None:
    """The largest hash (column h) that is kept, how many rows with it are, and how many there are; None if no row is kept.

    A histogram of the first digits tells in which bucket the edge lies; histograms of further digits
    go into it until its rows are few. A histogram has at most 16 ** PREFIX_DIGITS rows.
    """
    prefix, wanted = "", None
    while True:
        inside = order.filter(F.startswith("h", F.lit(prefix)))
        counts = inside.groupBy(F.substring("h", 1, len(prefix) + PREFIX_DIGITS).alias("p")).count().collect()
        if wanted is None:
            wanted = int(sum(r["count"] for r in counts) * percent / 100.0)
            if wanted <= 0:
                return None
        for r in sorted(counts, key=lambda r: r["p"]):
            if wanted <= r["count"]:
                break
            wanted -= r["count"]
        prefix = r["p"]
        if len(prefix) >= HASH_DIGITS:
            return prefix, wanted, r["count"]
        if r["count"] <= EDGE_ROWS:
            rows = sorted(x["h"] for x in order.filter(F.startswith("h", F.lit(prefix))).collect())
            last = rows[wanted - 1]
            return last, wanted - sum(x < last for x in rows), rows.count(last)


def exact_sample(df: DataFrame, percent: float, seed: int, key: str) -> DataFrame:
    """Exactly int(n * percent / 100) rows without replacement, the first in the order of a seeded hash. The product is a float and is cut, as the training code does.

    The hash at the edge is found from histograms, and then rows are filtered: none is sorted or moved.
    Only where rows share the key at the edge, and not all of them are kept, are those limited.
    """
    if percent >= 100:
        return df
    own = seeded(seed, key)
    edge = _edge(df.select(own.alias("h")), percent)
    if edge is None:
        return df.filter(F.lit(False))
    last, kept, there = edge
    if kept == there:
        return df.filter(own <= last)
    return df.filter(own < last).unionByName(df.filter(own == last).limit(kept))


def mix_datasets(spec: str, registry: dict[str, DataFrame], seed: int, key: str) -> DataFrame:
    """Samples and joins the datasets of a spec and shuffles them by a seeded hash in `shuffle`. An unknown name is an error."""
    parts = {}
    for name, percent in parse_spec(spec):
        if name not in registry:
            raise ValueError(f"unknown dataset {name}")
        parts[name] = exact_sample(registry[name], percent, seed, key)
    return union_sources(parts).withColumn("shuffle", seeded(seed, "source", key))


def generate_prompts(ids: DataFrame, seed: int, styles: list[str], tones: list[str], templates: list[str], sentence: str) -> DataFrame:
    """A prompt for each id (column `id`) with a style, a tone (either may be empty) and a template picked by seeded hash.

    A template holds {style} and {tone}; the short prompt is the filled template, the full one adds the fixed sentence.
    """

    def pick(values: list[str], salt: str) -> Column:
        number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-{salt}-"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
        return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))

    rows = ids.select("id", pick([*styles, ""], "style").alias("style"), pick([*tones, ""], "tone").alias("tone"), pick(templates, "template").alias("template"))
    filled = F.replace(F.replace(F.col("template"), F.lit("{style}"), F.col("style")), F.lit("{tone}"), F.col("tone"))
    short = F.trim(F.regexp_replace(filled, " +", " "))
    return rows.withColumn("short_prompt", short).withColumn("full_prompt", F.concat("short_prompt", F.lit(" " + sentence)))


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """Totals of a prompt table: rows, rows with a style and with a tone, and different styles, tones and templates."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return prompts.agg(
        F.count("*").alias("total"),
        F.count(some("style")).alias("with_style"),
        F.count(some("tone")).alias("with_tone"),
        F.count_distinct(some("style")).alias("styles"),
        F.count_distinct(some("tone")).alias("tones"),
        F.count_distinct("template").alias("templates"),
    )
