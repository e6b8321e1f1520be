"""Scenes and the images that exist for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import HEAVY, salted_join

HISTOGRAM_TOP = 6


def attach_images(scenes: DataFrame, inventory: DataFrame, exact: int | None = None) -> DataFrame:
    """Excerpts with their existing images in scene order; those without any go, or without exactly `exact`.

    Filenames repeat across sources, so the source is part of the key.
    """
    met = scenes.join(inventory.select("source", "filename"), ["source", "filename"])
    found = met.groupBy("source", "episode_idx", "excerpt_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("scene_idx", "filename"))), lambda s: s["filename"]).alias("images"))
    found = found.withColumn("n_images", F.size("images").cast("bigint"))
    return found if exact is None else found.filter(F.col("n_images") == exact)


def pending_scenes(scenes: DataFrame, inventory: DataFrame, max_images: int | None = None) -> DataFrame:
    """Every scene with status `skipped` (its image exists) or `pending`; `max_images` caps the pending ones in order of excerpt and scene."""
    joined = scenes.join(inventory.select("source", "filename").withColumn("_there", F.lit(True)), ["source", "filename"], "left")
    marked = joined.withColumn("status", F.when(F.col("_there"), "skipped").otherwise("pending")).drop("_there")
    if max_images is None:
        return marked
    order = ["source", "episode_idx", "excerpt_idx", "scene_idx"]
    chosen = marked.filter("status = 'pending'").orderBy(*order).limit(max_images)
    return marked.filter("status = 'skipped'").unionByName(chosen)


def image_histogram(excerpts: DataFrame) -> DataFrame:
    """Number of excerpts by source (null: all) and number of images, HISTOGRAM_TOP and more in one bucket."""
    return excerpts.withColumn("bucket", F.least("n_images", F.lit(HISTOGRAM_TOP)).cast("bigint")).cube("source", "bucket").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g in (0, 2)").drop("g")


def generation_summary(results: DataFrame) -> DataFrame:
    """By status: number, megabytes, average kilobytes of successes."""
    return results.groupBy("status").agg(
        F.count("*").alias("n"),
        (F.coalesce(F.sum("size"), F.lit(0)) / (1024.0 * 1024.0)).alias("megabytes"),
        F.avg(F.when(F.col("status") == "success", F.col("size") / 1024.0)).alias("avg_kilobytes"),
    )


def failed_files(results: DataFrame) -> DataFrame:
    """The files of failed results, a row each."""
    return results.filter("status = 'failed'").select("filename")


def missing_media(records: DataFrame, inventory: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(record_id, missing): paths of a record's media that are not in the inventory.

    Paths are counted before they are looked up. Only uses of absent paths are moved to their
    records' lists, and those of a path that very many records use are dealt over several tasks.
    """
    used = records.select("record_id", F.explode(F.concat("image", "video")).alias("path"))
    absent = used.filter("path is not null").groupBy("path").agg(F.count("*").alias("n")).join(inventory.select("path").distinct(), "path", "left_anti")
    lost = salted_join(used, absent.select("path"), "path", absent, "record_id", heavy=heavy)
    return lost.groupBy("record_id").agg(F.array_sort(F.collect_list("path")).alias("missing"))


def resolve_paths(rows: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Adds resolved: an absolute path as it is, else the first root's path that the listing holds, else the path as it is."""
    absolute = F.startswith("path", F.lit("/"))
    tries = F.array(*(F.struct(F.lit(k).alias("rank"), F.concat(F.lit(r + "/"), F.col("path")).alias("candidate")) for k, r in enumerate(roots)))
    asked = rows.filter(~absolute).select("path").distinct().select("path", F.explode(tries).alias("t")).select("path", "t.rank", "t.candidate")
    best = asked.join(listing.select(F.col("path").alias("candidate")), "candidate").groupBy("path").agg(F.min(F.struct("rank", "candidate")).alias("best"))
    return rows.join(best, "path", "left").withColumn("resolved", F.when(absolute, F.col("path")).otherwise(F.coalesce("best.candidate", "path"))).drop("best")
