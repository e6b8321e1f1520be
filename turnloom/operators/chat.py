"""Chat training records: building, rewriting, segmenting, checking and measuring them.

A record is (record_id, image array<string>, video array<string>, conversations array<struct<from,value>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

IMAGE, VIDEO = "<image>", "<video>"
IMAGE_LENGTH = 128
TOKENS_BASE = 21


def tag_count(text: Column, tag: str) -> Column:
    return F.regexp_count(text, F.lit(tag)).cast("bigint")


def to_chat_records(excerpts: DataFrame, template: str) -> DataFrame:
    """Records of excerpts with images: a tag per image and the prompt (with the word range in place of `{range}`), answered by the excerpt."""
    prompt = F.concat(F.expr(f"repeat('{IMAGE}', cast(n_images as int))"), F.lit("\n"), F.replace(F.lit(template), F.lit("{range}"), T.word_range(F.col("word_count"))))
    turns = F.array(F.struct(F.lit("human").alias("from"), prompt.alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("excerpt").alias("value")))
    return excerpts.select("record_id", F.col("images").alias("image"), F.array().cast("array<string>").alias("video"), turns.alias("conversations"))


def rewrite_prompt(records: DataFrame, template: str) -> DataFrame:
    """Gives every human turn the new prompt with as many tags as the record has images; answers stay."""
    prompt = F.concat(F.expr(f"repeat('{IMAGE}', size(image))"), F.lit("\n" + template))
    return records.withColumn("conversations", F.transform("conversations", lambda t: F.when(t["from"] == "human", F.struct(t["from"].alias("from"), prompt.alias("value"))).otherwise(t)))


def segment_messages(records: DataFrame) -> DataFrame:
    """One row per segment (record_id, turn_no, segment_no, kind, value, problem).

    Human text is cut at its tags; the k-th tag of a kind over the record takes the k-th media item,
    blank text goes and other text is stripped. Answers are one text segment. Too many tags or media
    that no tag takes are the record's problem.
    """
    turns = records.select("record_id", "image", "video", F.posexplode("conversations").alias("turn_no", "t"))
    mark = "\u0001"
    cut = F.when(F.col("t.from") == "human", F.split(F.regexp_replace(F.col("t.value"), f"({IMAGE}|{VIDEO})", f"{mark}$1{mark}"), mark)).otherwise(F.array("t.value"))
    parts = turns.select("record_id", "image", "video", "turn_no", F.col("t.from").alias("side"), F.posexplode(cut).alias("pos", "part"))
    tag = (F.col("side") == "human") & F.col("part").isin(IMAGE, VIDEO)
    kind = F.when(tag & (F.col("part") == IMAGE), "image").when(tag, "video").otherwise("text")
    before = Window.partitionBy("record_id", "kind").orderBy("turn_no", "pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("record_id")
    numbered = parts.withColumn("kind", kind).withColumn("k", F.count("*").over(before))
    used = lambda name: F.count_if(F.col("kind") == name).over(whole)
    problem = F.when((used("image") > F.size("image")) | (used("video") > F.size("video")), "too_many_tags").when((used("image") < F.size("image")) | (used("video") < F.size("video")), "unused_media")
    text = F.when(F.col("side") == "human", T.strip(F.col("part"))).otherwise(F.col("part"))
    value = F.when(F.col("kind") == "image", F.get("image", (F.col("k") - 1).cast("int"))).when(F.col("kind") == "video", F.get("video", (F.col("k") - 1).cast("int"))).otherwise(text)
    found = numbered.withColumn("problem", problem).withColumn("value", value).filter("kind <> 'text' or value <> ''")
    number = F.row_number().over(Window.partitionBy("record_id", "turn_no").orderBy("pos"))
    return found.select("record_id", F.col("turn_no").cast("bigint").alias("turn_no"), number.cast("bigint").alias("segment_no"), "kind", "value", "problem")


def media_class(image: Column, video: Column) -> Column:
    return F.when((F.size(image) > 0) & (F.size(video) > 0), "mixed").when(F.size(image) > 0, "image").when(F.size(video) > 0, "video").otherwise("none")


def media_elements(records: DataFrame) -> DataFrame:
    """Media of message content (record_id, messages array<array<struct<type,value>>>) in order: element number, type and value."""
    flat = records.select("record_id", F.posexplode("messages").alias("m", "content")).select("record_id", "m", F.posexplode("content").alias("p", "e")).filter(F.col("e.type").isin("image", "image_url", "video"))
    number = F.row_number().over(Window.partitionBy("record_id").orderBy("m", "p")).cast("bigint")
    return flat.select("record_id", number.alias("element_no"), F.col("e.type").alias("type"), F.col("e.value").alias("value"))


def sample_lengths(records: DataFrame) -> DataFrame:
    """Words of all turns with IMAGE_LENGTH more for media, and the same signed: negative for text alone."""
    count = F.aggregate(F.transform("conversations", lambda t: F.size(T.words(t["value"]))), F.lit(0), lambda s, v: s + v)
    media = (F.size("image") > 0) | (F.size("video") > 0)
    out = records.select("record_id", count.cast("bigint").alias("words"), media.alias("media"))
    return out.select("record_id", (F.col("words") + F.when(F.col("media"), IMAGE_LENGTH).otherwise(0)).alias("length"), F.when(F.col("media"), F.col("words")).otherwise(-F.col("words")).alias("modality_length"))


def validate_records(records: DataFrame, missing: DataFrame) -> DataFrame:
    """Adds problems: missing files; the first kind of media whose tags do not match (images first); tags inside answers."""
    human = F.filter("conversations", lambda t: t["from"] == "human")
    answers = F.filter("conversations", lambda t: t["from"] == "gpt")
    tags = lambda turns, tag: F.aggregate(F.transform(turns, lambda t: F.regexp_count(t["value"], F.lit(tag))), F.lit(0), lambda s, v: s + v)
    problem = lambda kind, media, expected, actual: F.struct(F.lit(kind).alias("type"), F.lit(media).alias("media_type"), expected.cast("bigint").alias("expected"), actual.cast("bigint").alias("actual"))
    images, videos = F.size("image"), F.size("video")
    found = F.array_compact(
        F.array(
            F.when(F.size("missing") > 0, problem("missing_files", "any", F.lit(0), F.size("missing"))),
            F.when(tags(human, IMAGE) != images, problem("tag_mismatch", "image", images, tags(human, IMAGE))).when(tags(human, VIDEO) != videos, problem("tag_mismatch", "video", videos, tags(human, VIDEO))),
            F.when(tags(answers, IMAGE) + tags(answers, VIDEO) > 0, problem("tag_in_answer", "any", F.lit(0), tags(answers, IMAGE) + tags(answers, VIDEO))),
        )
    )
    joined = records.join(missing, "record_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return joined.withColumn("problems", found).drop("missing")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without problems, and those with."""
    return checked.filter(F.size("problems") == 0), checked.filter(F.size("problems") > 0)


def validation_summary(checked: DataFrame) -> DataFrame:
    """Totals of a checked dataset in one row."""
    has = lambda kind: F.count_if(F.exists("problems", lambda p: p["type"] == kind))
    kind = media_class(F.col("image"), F.col("video"))
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("problems") == 0).alias("valid"),
        has("missing_files").alias("missing_files"),
        has("tag_mismatch").alias("tag_mismatch"),
        has("tag_in_answer").alias("tag_in_answer"),
        *(F.count_if(kind == k).alias(f"{k}_records") for k in ("image", "video", "mixed", "none")),
    )


def dataset_size(records: DataFrame) -> DataFrame:
    """Records and images by dataset."""
    return records.groupBy("dataset").agg(F.count("*").alias("records"), F.sum(F.size("image")).cast("bigint").alias("images"))


def record_tokens(records: DataFrame) -> DataFrame:
    """Tokens of a record: TOKENS_BASE, the estimate of every turn, and the visual tokens of its images, else of its videos."""
    turns = F.aggregate(F.transform("conversations", lambda t: T.token_estimate(F.size(T.words(t["value"])))), F.lit(0).cast("bigint"), lambda s, v: s + v)
    visual = F.when(F.size("image") > 0, F.col("image_tokens")).when(F.size("video") > 0, F.col("video_tokens")).otherwise(0)
    return records.withColumn("num_tokens", (F.lit(TOKENS_BASE) + turns + visual).cast("bigint"))
