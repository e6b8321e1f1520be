"""Comparing the transcripts of two models, and scores over embeddings and timings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import transcript_measures
from .turns import turn_measures

METRICS = ["words", "distinct2", "avg_turn_length", "switch_rate", "num_turns"]
#: how each metric's average is shown
FORMATS = {"words": "%.1f", "distinct2": "%.4f", "avg_turn_length": "%.1f", "switch_rate": "%.1f", "num_turns": "%.1f"}
MAX_IMAGES = 5


def transcript_metrics(transcripts: DataFrame) -> DataFrame:
    """(sample, model, the five metrics) of transcripts whose header is stripped already; a missing one has a null distinct2. No shuffle."""
    text, m = F.col("content"), F.col("_m")
    measured = transcripts.select("sample", "model", (text.isNotNull() & (text != "")).alias("_some"), transcript_measures(text).alias("_m"))
    shown = measured.select("sample", "model", m["words"].alias("words"), F.when(F.col("_some"), m["distinct2"]).alias("distinct2"), *turn_measures(m["turns"], m["turn_words"]))
    return shown.withColumnRenamed("n_turns", "num_turns").select("sample", "model", *METRICS)


def compare_models(long: DataFrame, models: list[str]) -> DataFrame:
    """One row per sample with each metric of each model beside the other's."""
    wide = long.groupBy("sample").pivot("model", models).agg(*(F.first(m, ignorenulls=True).alias(m) for m in METRICS))
    return wide.select("sample", *(F.col(f"{model}_{m}").alias(f"{m}_{model}") for m in METRICS for model in models))


def comparison_summary(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Average of each metric for both models without nulls, signed difference, all formatted, and a verdict on style.

    A metric without a value on one side is left out.
    """
    means = wide.agg(*(F.avg(f"{m}_{x}").alias(f"{m}_{x}") for m in METRICS for x in (a, b)), *(F.count_if(F.col(f"num_turns_{x}") == 0).alias(f"unparsed_{x}") for x in (a, b)))
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}_{a}").alias("x"), F.col(f"{m}_{b}").alias("y")) for m in METRICS]
    long = means.select(F.explode(F.array(*rows)).alias("r"), f"unparsed_{a}", f"unparsed_{b}").select("r.*", F.col(f"unparsed_{a}").alias("unparsed_a"), F.col(f"unparsed_{b}").alias("unparsed_b")).filter("x is not null and y is not null")

    def shown(value: Column, sign: str = "") -> Column:
        out = F.lit(None).cast("string")
        for m, f in FORMATS.items():
            out = F.when(F.col("metric") == m, F.format_string("%" + sign + f[1:], value)).otherwise(out)
        return out

    verdict = F.when(F.col("metric") == "avg_turn_length", F.when(F.col("x") > F.col("y"), "longer turns").otherwise("shorter turns")).when(F.col("metric") == "switch_rate", F.when(F.col("x") < F.col("y"), "fewer switches").otherwise("more switches"))
    return long.select("metric", shown(F.col("x")).alias("mean_a"), shown(F.col("y")).alias("mean_b"), shown(F.col("x") - F.col("y"), "+").alias("difference"), verdict.alias("verdict"), "unparsed_a", "unparsed_b")


def cosines(t: pa.ListArray, i: pa.ListArray) -> pa.Array:
    """Cosine of each pair of vectors; null where one is missing, empty, of length 0, of another size, or holds a null.

    Pairs of one size are two matrices, whose dots and norms are taken at once.
    """
    size = [pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (t, i)]
    flat, begin, whole = [], [], (size[0] == size[1]) & (size[0] > 0)
    for x in (t, i):
        offsets = x.offsets.to_numpy().astype(np.int64)
        values = x.values
        lost = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        whole &= lost[offsets[1:]] == lost[offsets[:-1]]
        flat.append(pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float64))
        begin.append(offsets[:-1])
    out = np.full(len(size[0]), np.nan)
    known = np.zeros(len(out), bool)
    for d in np.unique(size[0][whole]):
        rows = np.flatnonzero(whole & (size[0] == d))
        a, b = (v[at[rows][:, None] + np.arange(d)] for v, at in zip(flat, begin))
        norm = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        fine = norm != 0
        out[rows[fine]] = np.einsum("ij,ij->i", a[fine], b[fine]) / norm[fine]
        known[rows[fine]] = True
    return pa.array(out, pa.float64(), mask=~known, from_pandas=False)


def alignment_score(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Mean of 100 * cosine, 0 at least, of a sample's text and its first five images; null without either.

    `texts` (sample_id, vector), `images` (sample_id, image_no, vector). A sample's images beyond the
    first five end in the tasks that read them.
    """
    first = images.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("image_no"))).filter(F.col("_n") <= MAX_IMAGES)
    both = texts.select("sample_id", F.col("vector").alias("t")).join(first.select("sample_id", F.col("vector").alias("i")), "sample_id", "full")
    kind = both.schema["sample_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.max_element_wise(pc.multiply(cosines(batch.column("t"), batch.column("i")), 100.0), 0.0, skip_nulls=False)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), found], names=["sample_id", "score"])

    return both.mapInArrow(scored, f"sample_id {kind}, score double").groupBy("sample_id").agg(F.avg("score").alias("score"), F.count("score").alias("n_images"))


def timing_stats(results: DataFrame) -> DataFrame:
    """Averages and totals of generation results (words, seconds, tokens), rates with a guard against zero."""
    total = results.agg(F.count("*").alias("n"), F.avg("words").alias("avg_words"), F.avg("seconds").alias("avg_seconds"), F.sum("seconds").alias("total_seconds"), F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    rate = F.when(F.col("total_seconds") > 0, F.col("tokens") / F.col("total_seconds"))
    return total.select("n", "avg_words", "avg_seconds", "total_seconds", rate.alias("tokens_per_second"), F.when(F.col("words") > 0, F.col("tokens") / F.col("words")).alias("tokens_per_word"))


def attach_embeddings(annotations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Annotations with the embedding of their sample; `status` says which have none and why."""
    joined = annotations.join(embeddings.withColumn("_found", F.lit(True)), "sample_id", "left")
    status = F.when(F.col("n_images") == 0, "text_only").when(F.col("_found").isNull(), "missing").otherwise("attached")
    return joined.withColumn("status", status).drop("_found")
