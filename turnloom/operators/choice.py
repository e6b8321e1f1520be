"""Multiple-choice items and predictions: prompts, answers by rule, keys, and accuracy.

Items hold their options as a map from letter to text (`choices`, null options left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import HEAVY, salted_join

LETTERS = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
# Texts that answers and prompts are matched with or built from.
API_FAILURE = "Failed to obtain answer via API"
REFUSALS = [
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
]
SIGNS = ".()[],:;!*#{}"
OTHER_ANSWERS = "Other Answers"
SELECT_OPTION = "Please select the correct answer from the options above."
SELECT_OPTION_CHINESE = "请直接回答选项字母。"
YES_NO = " Please answer yes or no."
SHORT_ANSWER = "\nPlease try to answer the question with short words or phrases if possible."


def choices(columns: list[str]) -> Column:
    """A map of the options that are not null, from one column per letter."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in columns))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def reformulate_open(items: DataFrame) -> DataFrame:
    """Open questions (no option A) get their answer as A and OTHER_ANSWERS as B; `was_open` marks them."""
    open_ = F.col("A").isNull()
    return items.withColumns({"was_open": open_, "A": F.when(open_, F.col("answer")).otherwise(F.col("A")), "B": F.when(open_, F.lit(OTHER_ANSWERS)).otherwise(F.col("B"))})


def infer_option(answer: Column, options: Column) -> Column:
    """The one option letter among the answer's tokens; Z for a refusal; null where the rule cannot tell.

    `A` among more than three tokens may be an article, and then nothing is told.
    """
    tokens = F.array_distinct(T.words(F.translate(answer, SIGNS, " " * len(SIGNS))))
    found = F.array_intersect(tokens, F.map_keys(options))
    refused = F.lit(False)
    for text in REFUSALS:
        refused = refused | F.contains(answer, F.lit(text))
    many = F.size(T.words(F.translate(answer, SIGNS, " " * len(SIGNS)))) > 3
    return (
        F.when(F.contains(answer, F.lit(API_FAILURE)), None)
        .when(refused, "Z")
        .when(F.size(found) == 1, F.when(~(F.array_contains(tokens, "A") & many), found[0]))
        .when((F.size(found) == 0) & F.array_contains(tokens, "Z"), "Z")
    )


def infer_text(answer: Column, options: Column) -> Column:
    """The one option whose text is inside the answer, in any case."""
    found = F.map_keys(F.map_filter(options, lambda k, v: F.contains(F.lower(answer), F.lower(v))))
    return F.when(F.size(found) == 1, found[0])


def extract_answers(predictions: DataFrame, judge: DataFrame) -> DataFrame:
    """Adds extracted, method, success and hit to predictions (index, prediction, choices, gt).

    The option rule, then the text rule, then a judge's reply (index, reply) under both rules, whose Z
    counts as no answer; what stays open is unresolved and no hit.
    """
    joined = predictions.join(judge.select("index", "reply"), "index", "left")
    answer = F.coalesce(F.col("prediction").cast("string"), F.lit(""))
    by_option, by_text = infer_option(answer, F.col("choices")), infer_text(answer, F.col("choices"))
    judged = F.coalesce(infer_option(F.col("reply"), F.col("choices")), infer_text(F.col("reply"), F.col("choices")))
    ruled = joined.withColumns({"_option": by_option, "_text": by_text, "_judge": F.when(judged != "Z", judged)})
    method = F.when(F.col("_option").isNotNull(), "option").when(F.col("_text").isNotNull(), "text").when(F.col("_judge").isNotNull(), "judge").otherwise("unresolved")
    out = ruled.withColumns({"extracted": F.coalesce("_option", "_text", "_judge"), "method": method, "success": method != "unresolved"})
    return out.withColumn("hit", F.coalesce(F.col("extracted") == F.col("gt"), F.lit(False)).cast("bigint")).drop("_option", "_text", "_judge", "reply")


def attach_ground_truth(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions with gt: the item's answer where it is one capital letter, else A. Predictions without an item are an error.

    Columns get lower-case names but for the option letters.
    """
    named = predictions.select(*(F.col(c).alias(c if c in LETTERS else c.lower()) for c in predictions.columns))
    key = items.select("index", F.when(F.col("answer").rlike("^[A-Z]$"), F.col("answer")).otherwise("A").alias("gt"), F.lit(True).alias("_known"))
    joined = named.join(key, "index", "left")
    unknown = F.raise_error(F.concat(F.lit("no item for prediction "), F.col("index").cast("string"))).cast("string")
    return joined.withColumn("gt", F.when(F.col("_known"), F.col("gt")).otherwise(unknown)).drop("_known")


def resolve_image_refs(items: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Adds resolved and problem: an image value of 64 characters or fewer is the index of the row that holds the image, which must be longer.

    Only references are joined; rows that hold their image stay where they are, and of the images only
    those that some row refers to are moved. References to one row by very many are dealt over several tasks.
    """
    refers = F.coalesce(F.length("image") <= 64, F.lit(False))
    references = items.filter(refers).withColumn("_ref", F.col("image"))
    holders = items.filter(F.length("image") > 64).select(F.col("index").cast("string").alias("_ref"), F.col("image").alias("resolved"))
    counts = references.groupBy("_ref").agg(F.count("*").alias("n"))
    found = salted_join(references, holders, "_ref", counts, "index", "left", heavy).drop("_ref")
    found = found.withColumn("problem", F.when(F.col("resolved").isNull(), "unresolved_image"))
    own = items.filter(~refers).withColumns({"resolved": F.col("image"), "problem": F.lit(None).cast("string")})
    return found.unionByName(own)


def _option_lines(options: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n"))), "")


def build_mcq_prompt(items: DataFrame, kind: str = "choice") -> DataFrame:
    """Adds prompt. Kinds: `choice` (a Chinese closing line where the prompt has Chinese characters), `yes_no`, `short`."""
    if kind == "yes_no":
        return items.withColumn("prompt", F.concat("question", F.lit(YES_NO)))
    if kind == "short":
        return items.withColumn("prompt", F.concat("question", F.lit(SHORT_ANSWER)))
    head = F.concat(F.coalesce(F.concat(F.lit("Hint: "), F.col("hint"), F.lit("\n")), F.lit("")), F.lit("Question: "), F.col("question"), F.lit("\n"))
    with_options = F.concat(head, F.lit("Options:\n"), _option_lines(F.col("choices")))
    closing = F.when(with_options.rlike("[一-鿿]"), SELECT_OPTION_CHINESE).otherwise(SELECT_OPTION)
    text = F.when(F.size("choices") > 0, F.concat(with_options, closing)).otherwise(head)
    return items.withColumn("prompt", F.regexp_replace(text, r"(?U)\s+$", ""))


def build_judge_prompt(predictions: DataFrame, template: str) -> DataFrame:
    """Adds judge_prompt: the template with {question}, {options} and {answer} filled in."""
    options = F.concat(F.lit("There are several options: \n"), _option_lines(F.col("choices")))
    out = F.replace(F.replace(F.lit(template), F.lit("{question}"), F.col("question")), F.lit("{options}"), options)
    return predictions.withColumn("judge_prompt", F.replace(out, F.lit("{answer}"), F.col("prediction")))


def split_image_refs(items: DataFrame) -> DataFrame:
    """(index, segment_no, kind, value): a prompt cut at its `<image N>` references; N is the place in `images`, from 1."""
    mark = "\u0001"
    cut = F.split(F.regexp_replace("prompt", r"<image (\d)>", f"{mark}<image $1>{mark}"), mark)
    flat = items.select("index", "images", F.posexplode(cut).alias("at", "part")).filter("part <> '' or at = 0")
    number = F.regexp_extract("part", r"^<image (\d)>$", 1)
    is_image = number != ""
    value = F.when(is_image, F.get("images", (number.try_cast("int") - 1))).otherwise(F.col("part"))
    return flat.select("index", (F.col("at") + 1).cast("bigint").alias("segment_no"), F.when(is_image, "image").otherwise("text").alias("kind"), value.alias("value"))


def accuracy(results: DataFrame) -> DataFrame:
    """Hits, totals and their ratio by split, and over all in the row with a null split."""
    return results.rollup("split").agg(F.sum("hit").cast("bigint").alias("hits"), F.count("*").alias("total"), F.avg("hit").alias("accuracy"))
