"""Text measures and rewrites as columns. White space is Unicode white space, as Python strips it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: stage-direction markers, header fields, photo prompt prefix.
MARKERS = ["[inaudible]", "[sigh]", "[music]", "[laughter]"]
HEADER_FIELDS = ["Sample:", "Word count:", "Generation time:", "==="]
PHOTO_STYLE = "Photorealistic photograph, high quality, realistic lighting, no cartoon, no illustration: "
TOKENS_PER_WORD = 1.3
IMAGE_TOKENS = 1792

_EDGES = r"(?U)^\s+|\s+$"
_MARKER_PATTERN = r"\[(?:inaudible|sigh|music|laughter)\]"
_HEADER_PATTERN = r"^(?:Sample:|Word count:|Generation time:|===)"  # with (?dm): at the start of any line


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, _EDGES, "")


def words(text: Column) -> Column:
    """Tokens between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


def normalize_text(text: Column) -> Column:
    """Lower case without the 32 ASCII punctuation characters; curly quotes and long dashes stay."""
    return F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")


def marker_count(text: Column) -> Column:
    """Stage-direction markers in any case."""
    return F.regexp_count(F.lower(text), F.lit(_MARKER_PATTERN)).cast("bigint")


def word_range(count: Column) -> Column:
    """The bucket of 100 words that a count lies in, as "lower-upper"."""
    low = (F.floor(count / 100) * 100).cast("bigint")
    return F.concat_ws("-", low.cast("string"), (low + 100).cast("string"))


def clean_scene_prompt(prompt: Column, style: str = PHOTO_STYLE) -> Column:
    """Up to two "Scene N:" prefixes off, stripped, with the photo style in front."""
    prefix = r"^Scene \d+:\s*"
    return F.concat(F.lit(style), strip(F.regexp_replace(F.regexp_replace(prompt, prefix, ""), prefix, "")))


def strip_code_fence(reply: Column) -> Column:
    """First and last line off where the stripped reply starts with three backticks."""
    text = strip(reply)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def strip_header(content: Column) -> Column:
    """The dialogue of a generated transcript.

    Header lines are dropped wherever they stand, and so are lines before the first of them. Where
    that leaves nothing, the whole content stays.
    """
    begun = F.regexp_replace(content, rf"(?dms)\A.*?(?={_HEADER_PATTERN})", "")
    body = strip(F.regexp_replace(begun, rf"(?dm){_HEADER_PATTERN}[^\n]*\n?", ""))
    return F.when(content.rlike(f"(?dm){_HEADER_PATTERN}") & (body != ""), body).otherwise(strip(content))


def header_value(content: Column, field: str) -> Column:
    """The value of a header line such as `Word count: 12`, null where there is none."""
    found = F.regexp_extract(content, rf"(?m)^{field}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def sample_number(key: Column) -> Column:
    """NN of `sample_NN_story_ID`, null for other keys."""
    parts = F.split(key, "_")
    return F.when((F.size(parts) >= 4) & (parts[0] == "sample") & (parts[2] == "story"), parts[1].try_cast("int"))


def story_id(key: Column) -> Column:
    """ID of `sample_NN_story_ID`, null for other keys."""
    parts = F.split(key, "_")
    return F.when((F.size(parts) >= 4) & (parts[0] == "sample") & (parts[2] == "story"), parts[3])


def image_id(name: Column) -> Column:
    """ID of `image_J_ID.jpg`, null for other names."""
    parts = F.split(F.regexp_replace(name, r"\.jpg$", ""), "_")
    return F.when((F.size(parts) >= 3) & (parts[0] == "image"), parts[2])


def token_estimate(count: Column) -> Column:
    """Tokens of so many words: the product with TOKENS_PER_WORD, truncated."""
    return (count * F.lit(TOKENS_PER_WORD)).cast("bigint")


def to_list(value: Column) -> Column:
    """A `[a, b]` literal or a plain string as a list. Nothing is evaluated."""
    text = strip(value)
    parts = F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda p: F.regexp_replace(strip(p), r"^['\"]|['\"]$", ""))
    return F.when(value.isNull(), F.array().cast("array<string>")).when(text.rlike(r"(?s)^\[.*\]$"), F.filter(parts, lambda p: p != "")).otherwise(F.array(value))
