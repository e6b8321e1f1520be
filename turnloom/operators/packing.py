"""Training layout: packing records by tokens, answer masks, concatenation, padding."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as T
from .index import dense_index

# Sizes of packs, and the token ids that begin and end an answer.
CAPACITY = 4096
PACK_BATCH = 256
IGNORE = -100
ASSISTANT = 77091
TURN_END = 151645


def token_breakdown(df: DataFrame) -> DataFrame:
    """Text and image tokens of a long and a short prompt (id, long_words, short_words, images): totals, image shares, saving in percent."""
    image = F.col("images") * F.lit(T.IMAGE_TOKENS)
    out = df.withColumns({"long_text": T.token_estimate(F.col("long_words")), "short_text": T.token_estimate(F.col("short_words")), "image_tokens": image.cast("bigint")})
    out = out.withColumns({"long_total": F.col("long_text") + F.col("image_tokens"), "short_total": F.col("short_text") + F.col("image_tokens")})
    share = F.when(F.col("long_total") > 0, F.col("image_tokens") / F.col("long_total") * 100)
    return out.withColumns({"image_share": share, "saving": F.when(F.col("long_total") > 0, (F.col("long_total") - F.col("short_total")) / F.col("long_total") * 100)})


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size: heaviest first (ties by place), each into the fullest bin that still takes it; bins are numbered as they open."""
    room: list[tuple[int, int]] = []  # (room left, bin)
    out = [0] * len(sizes)
    bins = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[k], -1))
        if at < len(room):
            left, which = room.pop(at)
        else:
            left, which, bins = max(capacity, sizes[k]), bins, bins + 1
        out[k] = which
        insort(room, (left - sizes[k], which))
    return out


def pack_records(df: DataFrame, order: list[str], capacity: int = CAPACITY, batch: int = PACK_BATCH) -> DataFrame:
    """Adds batch, pack (within the batch) and pack_tokens to records with num_tokens.

    Batches are `batch` consecutive records of the order; an oversized record has a pack of its own.
    Packing is sequential, so it runs per batch, which is bounded.
    """
    numbered = dense_index(df, order, "position").withColumn("batch", F.floor(F.col("position") / batch).cast("bigint"))
    slim = numbered.select("batch", "position", "num_tokens")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        rows["pack"] = best_fit(rows["num_tokens"].tolist(), capacity)
        rows["pack_tokens"] = rows.groupby("pack")["num_tokens"].transform("sum")
        return rows[["position", "pack", "pack_tokens"]]

    packs = slim.groupBy("batch").applyInPandas(pack, "position long, pack long, pack_tokens long")
    return numbered.join(packs, "position").drop("position")


@F.pandas_udf(ArrayType(IntegerType()))
def mask_labels(ids: pd.Series) -> pd.Series:
    """Labels of token ids: IGNORE, but for each ASSISTANT at p the ids from p + 2 to the next TURN_END and one more.

    An answer without an end stays masked.
    """

    def one(tokens) -> list[int]:
        tokens = np.asarray(tokens if tokens is not None else [], dtype=np.int64)
        out = np.full(len(tokens), IGNORE, np.int64)
        ends = np.flatnonzero(tokens == TURN_END)
        free = 0
        for p in np.flatnonzero(tokens == ASSISTANT):
            if p < free:
                continue
            k = np.searchsorted(ends, p + 2)
            if k < len(ends):
                stop = ends[k] + 2
                out[p + 2 : stop] = tokens[p + 2 : stop]
                free = ends[k]
        return out.tolist()

    return ids.map(one)


def concat_pack(df: DataFrame) -> DataFrame:
    """One row per pack (pack_id): ids and labels of its records joined in order, and their lengths."""
    gathered = df.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("position", "ids", "labels"))).alias("r"))
    joined = lambda name: F.flatten(F.transform("r", lambda s: s[name]))
    return gathered.select("pack_id", joined("ids").alias("ids"), joined("labels").alias("labels"), F.transform("r", lambda s: F.size(s["ids"])).alias("lengths"))


def cu_seqlens(lengths: Column) -> Column:
    """0 and the running sums of the lengths."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(lengths, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v.cast("bigint"))))


def pad_batches(df: DataFrame, most: int, pad: int) -> DataFrame:
    """Pads ids with `pad` and labels with IGNORE to the longest of their batch, cuts at `most`, and adds the attention mask."""
    width = F.least(F.max(F.size("ids")).over(Window.partitionBy("batch")), F.lit(most))
    sized = df.withColumn("width", width)
    filled = lambda name, value: F.slice(F.concat(name, F.array_repeat(F.lit(value), F.greatest(F.col("width") - F.size(name), F.lit(0)).cast("int"))), F.lit(1), F.col("width"))
    out = sized.withColumns({"ids": filled("ids", pad), "labels": filled("labels", IGNORE)})
    return out.withColumn("attention", F.transform("ids", lambda i: i != pad)).drop("width")
