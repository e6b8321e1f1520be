"""Photo stories: valid ones, their text, names, workers, and choosing some without shared photos.

Photos are rows (story_id, photo_id, photo_order, text); photo_order with photo_id tells them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import dense_index, shared_folder

PHOTOS = 5


def complete_stories(photos: DataFrame, count: int = PHOTOS) -> DataFrame:
    """Stories of exactly `count` photos, with photos and sentences in arranged order."""
    own = photos.groupBy("story_id").agg(F.count("*").alias("n")).filter(F.col("n") == count).select("story_id")
    gathered = photos.join(own, "story_id").groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("photo_order", "photo_id", "text"))).alias("p"))
    return gathered.select("story_id", F.transform("p", lambda s: s["photo_id"]).alias("photos"), F.transform("p", lambda s: s["text"]).alias("sentences"))


def story_text(stories: DataFrame) -> DataFrame:
    """(story_id, text): the sentences joined by a space."""
    return stories.select("story_id", F.array_join("sentences", " ").alias("text"))


def first_k(stories: DataFrame, positions: DataFrame, k: int) -> DataFrame:
    """The k stories that come first; `positions` (story_id, position) holds every photo's place in its file."""
    order = positions.groupBy("story_id").agg(F.min("position").alias("position"))
    return stories.join(order, "story_id").orderBy("position", "story_id").limit(k)


def assign_workers(samples: DataFrame, workers: int, done: DataFrame) -> DataFrame:
    """Samples dealt round robin in order of their names; done ones keep their number and go."""
    numbered = dense_index(samples.select("sample"), ["sample"], "number").withColumn("worker", F.col("number") % workers)
    return numbered.join(done.select("sample").distinct(), "sample", "left_anti")


def seeded_order(stories: DataFrame, seed: int) -> DataFrame:
    """Adds priority: the stories in an order drawn by hash of seed and id."""
    return stories.withColumn("priority", F.concat(F.md5(F.concat(F.lit(f"{seed}-"), F.col("story_id").cast("string"))), F.lit("-"), F.lpad(F.col("story_id").cast("string"), 20, "0")))


def _loop_choice(entries: DataFrame) -> DataFrame | None:
    """(story_id, priority) that a loop over the order would choose from the entries (story_id, priority, photo_id)."""
    left, chosen = entries.checkpoint(), None
    while not left.isEmpty():
        first = left.groupBy("photo_id").agg(F.min("priority").alias("first"))
        won = left.join(first, "photo_id").groupBy("story_id", "priority").agg(F.every(F.col("priority") == F.col("first")).alias("won")).filter("won").select("story_id", "priority").checkpoint()
        chosen = won if chosen is None else chosen.unionByName(won)
        taken = left.join(won.select("story_id"), "story_id", "left_semi").select("photo_id").distinct()
        gone = left.join(taken, "photo_id", "left_semi").select("story_id").distinct()
        left = left.join(gone, "story_id", "left_anti").checkpoint()
    return chosen


def select_disjoint(stories: DataFrame, used: DataFrame, count: int, seed: int, fill: bool = False) -> DataFrame:
    """Up to `count` stories in seeded order, none sharing a photo with a used story or one chosen before it.

    `stories` (story_id, photos), `used` (photo_id). The choice is the one a loop over the order
    would make. A story's fate depends only on those before it, so the order is worked through in
    growing pieces (its keys are hashes, so a piece is a range of them) until `count` are found. In a
    piece, rounds each take every remaining story that is first on all its photos, and stories that
    share a photo with one taken go; their number is logarithmic for a random order. `fill` tops up
    with the next stories, allowing shared photos.
    """
    shared_folder(stories.sparkSession)
    keyed = seeded_order(stories.select("story_id", "photos"), seed).checkpoint()
    entries = keyed.select("story_id", "priority", F.explode(F.array_distinct("photos")).alias("photo_id"))
    blocked = used.select("photo_id").distinct()
    total, chosen, low, share = keyed.count(), None, 0.0, 4.0 * count
    while low < 1.0 and total:
        high = min(low + share / total, 1.0)
        piece = entries.filter(F.col("priority") >= _hash_at(low))
        piece = piece if high >= 1.0 else piece.filter(F.col("priority") < _hash_at(high))
        if chosen is not None:
            taken = entries.join(chosen.select("story_id"), "story_id", "left_semi").select("photo_id")
            blocked = used.select("photo_id").unionByName(taken).distinct()
        gone = piece.join(blocked, "photo_id", "left_semi").select("story_id").distinct()
        found = _loop_choice(piece.join(gone, "story_id", "left_anti"))
        if found is not None:
            chosen = found if chosen is None else chosen.unionByName(found)
            if chosen.count() >= count:
                break
        low, share = high, share * 4
    picked = (chosen if chosen is not None else keyed.select("story_id", "priority").limit(0)).orderBy("priority").limit(count).withColumn("overlaps", F.lit(False))
    if fill:
        rest = keyed.join(picked.select("story_id"), "story_id", "left_anti").select("story_id", "priority").withColumn("overlaps", F.lit(True))
        picked = picked.unionByName(rest).orderBy("overlaps", "priority").limit(count)
    return picked


def _hash_at(share: float) -> str:
    """The md5 in hexadecimal below which this share of all lies."""
    return f"{int(share * (1 << 64)):016x}"


def name_samples(selected: DataFrame, start: int) -> DataFrame:
    """(sample, story_id, image_no, image, photo_id) of selected stories (story_id, priority, overlaps, photos), numbered from `start` in selection order."""
    numbered = dense_index(selected, ["overlaps", "priority"], "at")
    flat = numbered.select(F.format_string("sample_%02d_story_%s", F.col("at") + start, F.col("story_id").cast("string")).alias("sample"), "story_id", F.posexplode("photos").alias("p", "photo_id"))
    return flat.select("sample", "story_id", (F.col("p") + 1).cast("bigint").alias("image_no"), F.format_string("image_%d_%s.jpg", F.col("p") + 1, F.col("photo_id").cast("string")).alias("image"), "photo_id")


def pair_by_rank(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], skip: list[int] = ()) -> DataFrame:
    """The i-th left row beside the i-th right row; positions in `skip` and rows without a partner say so in status."""
    a, b = dense_index(left, left_order, "rank"), dense_index(right, right_order, "rank")
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "rank", "full")
    status = F.when(F.col("rank").isin(list(skip)), "skipped").when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").otherwise("paired")
    return both.withColumn("status", status).drop("_a", "_b")
