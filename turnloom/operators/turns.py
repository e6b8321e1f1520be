"""Speaker turns: cleaning, episodes, relabelling, transcripts, and parsing transcripts back into turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.measures import LABEL, turn_counts
from .index import dense_index

# What a turn and an episode must have.
LOADED_MIN_CHARS = 10
TURN_MIN_CHARS = 10
MUSIC = "[Music]"
MIN_TURNS = 5
TRANSCRIPT_MAX_CHARS = 50_000


def loaded_turns(turns: DataFrame) -> DataFrame:
    """Turns with a URL and more than LOADED_MIN_CHARS characters."""
    return turns.filter((F.col("episode_url") != "") & (F.length(T.strip(F.col("text"))) > LOADED_MIN_CHARS))


def clean_turns(turns: DataFrame) -> DataFrame:
    """Stripped turns; music and turns under TURN_MIN_CHARS characters go."""
    kept = turns.withColumn("text", T.strip(F.col("text")))
    return kept.filter(~F.startswith("text", F.lit(MUSIC)) & (F.length("text") >= TURN_MIN_CHARS))


def episodes(turns: DataFrame, min_turns: int = MIN_TURNS) -> DataFrame:
    """Episodes of at least `min_turns` loaded turns, numbered from 0 in the order of their URLs."""
    counted = loaded_turns(turns).groupBy("episode_url").agg(F.count("*").alias("n_turns")).filter(F.col("n_turns") >= min_turns)
    return dense_index(counted, ["episode_url"], "episode_idx")


def _speaking(turns: DataFrame) -> DataFrame:
    """Turns of an episode, with the name of their first speaker."""
    return turns.filter("episode_url is not null").withColumn("_speaker", F.coalesce(F.get("speaker", F.lit(0)), F.lit("")))


def _numbered(named: DataFrame, *measures: Column) -> DataFrame:
    """A row per episode and speaker: the measures, and speaker_no by first appearance. First appearances merge before they are moved, and no text is."""
    first = named.groupBy("episode_url", "_speaker").agg(F.min("turn_idx").alias("_first"), *measures)
    number = F.dense_rank().over(Window.partitionBy("episode_url").orderBy("_first"))
    return first.withColumn("speaker_no", number.cast("bigint")).drop("_first")


def relabel_speakers(turns: DataFrame) -> DataFrame:
    """Adds speaker_no: speakers numbered by their first appearance among the given turns. Turns without an episode go."""
    named = _speaking(turns)
    return named.join(_numbered(named), ["episode_url", "_speaker"]).select(*turns.columns, "speaker_no")


def assemble_transcripts(turns: DataFrame, most_chars: int = TRANSCRIPT_MAX_CHARS) -> DataFrame:
    """One row per episode: transcript, n_speakers, n_chars.

    Lengths and speakers are summed without the texts, which are moved once, to their episode, where
    their speakers' numbers are. Episodes of more than `most_chars` characters get a null transcript and
    no list of speakers, so no row grows without bound. Turns without an episode go.
    """
    named = _speaking(turns)
    speakers = _numbered(named, F.sum(F.length("text")).alias("_chars"), F.count("text").alias("_turns"))
    own = F.col("_chars") + F.col("_turns") * (F.length(F.col("speaker_no").cast("string")) + 12)
    sized = speakers.withColumn("n_chars", (F.sum(own).over(Window.partitionBy("episode_url")) - 2).cast("bigint"))
    names = F.collect_list(F.when(F.col("n_chars") <= most_chars, F.struct("_speaker", "speaker_no")))
    episodes = sized.groupBy("episode_url").agg(F.max("n_chars").alias("n_chars"), F.max("speaker_no").alias("n_speakers"), F.map_from_entries(names).alias("_numbers"))
    told = named.select("episode_url", "turn_idx", "_speaker", "text").join(episodes, "episode_url")
    number = F.element_at("_numbers", F.col("_speaker")).cast("string")
    line = F.when((F.col("n_chars") <= most_chars) & F.col("text").isNotNull(), F.struct("turn_idx", F.concat(F.lit("Speaker "), number, F.lit(": "), F.col("text")).alias("line")))
    gathered = told.groupBy("episode_url").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.first("n_speakers").alias("n_speakers"), F.first("n_chars").alias("n_chars"))
    text = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda s: s["line"]), "\n\n"))
    return gathered.select("episode_url", text.alias("transcript"), "n_speakers", "n_chars")


def unprocessed(episodes: DataFrame, done: DataFrame, key: str = "episode_idx") -> DataFrame:
    """Episodes that have no output yet."""
    return episodes.join(done.select(key).distinct(), key, "left_anti")


def parse_turns(transcripts: DataFrame) -> DataFrame:
    """(sample, model, turn_no, speaker, text) of labelled transcripts (sample, model, content).

    Lines are stripped and blank ones dropped; a line without a label continues the turn before it,
    joined by a space; lines before the first label are ignored; labels without text make no turn.
    """
    keyed = transcripts.select("sample", "model", "content").repartition("sample", "model")
    lines = keyed.select("sample", "model", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).withColumn("line", T.strip(F.col("raw"))).filter("line <> ''")
    speaker = F.regexp_extract("line", LABEL, 1)
    marked = lines.withColumn("speaker", F.when(speaker != "", speaker))
    number = F.sum(F.when(F.col("speaker").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("sample", "model").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    body = F.when(F.col("speaker").isNull(), F.col("line")).otherwise(F.regexp_replace("line", LABEL, ""))
    numbered = marked.withColumn("label_no", number).filter("label_no > 0").withColumn("body", T.strip(body))
    parts = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("pos", "body"))))
    turns = numbered.groupBy("sample", "model", "label_no").agg(F.max("speaker").alias("speaker"), parts.alias("parts")).filter("size(parts) > 0")
    order = F.row_number().over(Window.partitionBy("sample", "model").orderBy("label_no"))
    return turns.select("sample", "model", order.cast("bigint").alias("turn_no"), "speaker", F.array_join(F.transform("parts", lambda s: s["body"]), " ").alias("text"))


def turn_measures(turns: Column, words: Column) -> list[Column]:
    """n_turns, average words of a turn and speaker switches per 1000 words; zeros where no turn is found."""
    average = F.when(turns > 0, words / turns).otherwise(0.0)
    switches = F.when(words > 0, (turns - 1) / words * 1000).otherwise(0.0)
    return [F.coalesce(turns, F.lit(0)).cast("bigint").alias("n_turns"), average.alias("avg_turn_length"), switches.alias("switch_rate")]


def dialogue_stats(transcripts: DataFrame) -> DataFrame:
    """Per transcript: n_turns, avg_turn_length, switch_rate. Row by row: no text is shuffled."""
    counted = transcripts.select("sample", "model", turn_counts(F.col("content")).alias("_turns"))
    return counted.select("sample", "model", *turn_measures(F.col("_turns.turns"), F.col("_turns.words")))
