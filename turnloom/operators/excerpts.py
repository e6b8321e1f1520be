"""From episodes to validated excerpts and scenes: gates, prompts, replies, rows, checks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.measures import max_ngram_repeat
from .index import dense_index, running_total
from .turns import TRANSCRIPT_MAX_CHARS

# Limits of transcripts and excerpts.
TRANSCRIPT_CHARS = (2000, TRANSCRIPT_MAX_CHARS)
EXCERPT_WORDS = (400, 900)
TRIGRAM = 3
MAX_TRIGRAM = 5
MAX_MARKERS = 2
TRIGRAM_MIN_WORDS = 50
SCENES = 5
SCENE_FILE = "ep%d_ex%d_scene%d.png"
FIRST_RANGE = 4096  # indexes looked at first for a target
REPLY = "visualizable boolean, reason string, excerpts array<struct<excerpt:string,word_count:bigint,scenes:array<string>>>, _corrupt_record string"


def slice_by_position(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    """Rows at positions [start, start + count) of the given order; every row has a position."""
    return dense_index(df, order, "position").filter((F.col("position") >= start) & (F.col("position") < start + count))


def load_excerpts(episodes: DataFrame) -> DataFrame:
    """Nested per-episode metadata as one row per excerpt, with its source."""
    flat = episodes.select("source", "episode_idx", F.explode("excerpts").alias("e"))
    return flat.select("source", "episode_idx", "e.excerpt_idx", "e.excerpt", F.length("e.excerpt").cast("bigint").alias("excerpt_length"), "e.word_count", "e.scenes")


def gate_by_length(df: DataFrame, column: str = "transcript", low: int = TRANSCRIPT_CHARS[0], high: int = TRANSCRIPT_CHARS[1], size_column: str | None = None) -> DataFrame:
    """Adds status and reason: too short or too long transcripts are skipped. `size_column` holds their length where it is known."""
    size = F.coalesce(F.col(size_column) if size_column else F.length(column), F.lit(0))
    reason = F.when(size < low, "too_short").when(size > high, "too_long")
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("skipped"))


def fill_prompt(df: DataFrame, template: str, column: str = "transcript") -> DataFrame:
    """Adds prompt: the template with the transcript in place of `{transcript}`."""
    return df.withColumn("prompt", F.replace(F.lit(template), F.lit("{transcript}"), F.col(column)))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Adds parsed: the reply's JSON without its code fence; `_corrupt_record` holds what cannot be read."""
    return replies.withColumn("parsed", F.from_json(T.strip_code_fence(F.col("reply")), REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def validate_excerpts(excerpts: DataFrame) -> DataFrame:
    """Adds valid and reason; the first reason found hides the others.

    Trigrams are counted in the row, and only of excerpts of a length that passes. No shuffle.
    """
    within = F.col("word_count").between(*EXCERPT_WORDS)
    counted = excerpts.withColumns({"_repeat": max_trigram_repeat(F.when(within, F.col("excerpt"))), "_markers": F.when(within, T.marker_count(F.col("excerpt")))})
    reason = (
        F.when(F.col("word_count") > EXCERPT_WORDS[1], "too_long")
        .when(F.col("word_count") < EXCERPT_WORDS[0], "too_short")
        .when(F.coalesce("_repeat", F.lit(0)) > MAX_TRIGRAM, F.concat(F.lit("repetition_"), F.col("_repeat").cast("string"), F.lit("x")))
        .when(F.col("_markers") > MAX_MARKERS, "too_many_markers")
    )
    return counted.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_repeat", "_markers")


def max_trigram_repeat(text: Column) -> Column:
    """How often the commonest trigram of raw tokens occurs; null in texts of fewer than TRIGRAM_MIN_WORDS words."""
    return F.when(T.word_count(text) >= TRIGRAM_MIN_WORDS, max_ngram_repeat(text, TRIGRAM))


def explode_excerpts(parsed: DataFrame) -> DataFrame:
    """One row per excerpt of a parsed reply: its place in the original list, length, and stated or counted words."""
    flat = parsed.select("episode_idx", F.posexplode("parsed.excerpts").alias("excerpt_idx", "e"))
    text = F.col("e.excerpt")
    return flat.select("episode_idx", F.col("excerpt_idx").cast("bigint").alias("excerpt_idx"), text.alias("excerpt"), F.length(text).cast("bigint").alias("excerpt_length"), F.coalesce("e.word_count", T.word_count(text)).alias("word_count"), F.col("e.scenes").alias("scenes"))


def explode_scenes(excerpts: DataFrame, exact: bool = False) -> DataFrame:
    """One row per scene of excerpts with SCENES scenes at least (or exactly): the first SCENES, numbered from 1, and their file."""
    enough = F.size("scenes") == SCENES if exact else F.size("scenes") >= SCENES
    others = [c for c in excerpts.columns if c != "scenes"]
    flat = excerpts.filter(enough).select(*others, F.posexplode(F.slice("scenes", 1, SCENES)).alias("at", "prompt"))
    return flat.withColumn("scene_idx", (F.col("at") + 1).cast("bigint")).withColumn("filename", F.format_string(SCENE_FILE, "episode_idx", "excerpt_idx", "scene_idx")).drop("at")


def classify_replies(replies: DataFrame) -> DataFrame:
    """(episode_idx, status, reason, num_excerpts) of each reply (episode_idx, reply). A reply is parsed once."""
    p = F.col("parsed")
    facts = parse_replies(replies).select(
        "episode_idx",
        F.col("reply").isNull().alias("silent"),
        (p.isNull() | p["_corrupt_record"].isNotNull()).alias("broken"),
        (~F.coalesce(p["visualizable"], F.lit(False))).alias("unseen"),
        F.coalesce(p["reason"], F.lit("unknown")).alias("why"),
        (F.coalesce(F.size(p["excerpts"]), F.lit(0)) <= 0).alias("empty"),
        F.explode_outer(p["excerpts"]).alias("e"),
    )
    text = F.col("e.excerpt")
    flat = facts.withColumns({"excerpt": text, "word_count": F.coalesce("e.word_count", T.word_count(text)), "enough": F.coalesce(F.size("e.scenes") >= SCENES, F.lit(False))})
    first = [F.first(c).alias(c) for c in ("silent", "broken", "unseen", "why", "empty")]
    found = validate_excerpts(flat.drop("e")).groupBy("episode_idx").agg(*first, F.count_if(F.col("enough") & F.col("valid") & F.col("word_count").isNotNull()).alias("n"))
    failed = F.col("silent") | F.col("broken")
    none = F.col("n") == 0
    status = F.when(failed, "failed").when(F.col("unseen") | F.col("empty"), "not_visualizable").when(none, "failed").otherwise("success")
    reason = F.when(F.col("silent"), "api_error").when(F.col("broken"), "json_parse_error").when(F.col("unseen"), F.col("why")).when(F.col("empty"), "no_excerpts").when(none, "no_valid_excerpts")
    return found.select("episode_idx", status.alias("status"), reason.alias("reason"), F.col("n").cast("bigint").alias("num_excerpts"))


def extraction_summary(status: DataFrame, rejected: DataFrame) -> DataFrame:
    """Counts by status, excerpts, scenes, rejected excerpts, and rates; one row."""
    counts = status.agg(
        F.count("*").alias("episodes"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "not_visualizable", "failed")),
        F.coalesce(F.sum("num_excerpts"), F.lit(0)).alias("excerpts"),
    )
    both = counts.crossJoin(F.broadcast(rejected.agg(F.count("*").alias("rejected"))))  # one row each
    seen = F.col("success") + F.col("not_visualizable")
    return both.withColumns({"scenes": F.col("excerpts") * SCENES, "visual_rate": F.when(seen > 0, F.col("success") / seen), "excerpts_per_episode": F.when(F.col("success") > 0, F.col("excerpts") / F.col("success"))})


def take_until_target(status: DataFrame, target: int, existing: int = 0, first_range: int = FIRST_RANGE) -> DataFrame:
    """Episodes in index order up to the one whose excerpts reach the target, `existing` ones counted first.

    Ranges of indexes, each twice as long as the one before, are summed until the target is met, and
    later rows are not read: each range is a filter that the source may push down. Rows without an index go.
    """
    index = F.col("episode_idx")
    span = status.agg(F.min(index), F.max(index)).first()
    begin, end, size, total = span[0] or 0, span[1], first_range, existing
    upto = begin
    while total < target and end is not None and upto <= end:
        total += status.filter((index >= upto) & (index < upto + size)).agg(F.sum("num_excerpts")).first()[0] or 0
        upto, size = upto + size, 2 * size
    summed = running_total(status.filter((index >= begin) & (index < upto)), ["episode_idx"], "num_excerpts")
    return summed.filter(F.lit(existing) + F.col("running") - F.col("num_excerpts") < target)


def batches(df: DataFrame, size: int, start: int = 0, index: str = "episode_idx") -> DataFrame:
    """Adds batch: consecutive runs of `size` indexes from `start` on."""
    return df.filter(F.col(index) >= start).withColumn("batch", F.floor((F.col(index) - start) / size).cast("bigint"))
