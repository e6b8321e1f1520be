"""Sizes of images, frames and boxes as columns. Rounding is half-even, as in the training code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RATIO = 200
FRAME_FACTOR = 2


def _least_multiple(value: Column, factor: Column) -> Column:
    return (F.ceil(value / factor) * factor).cast("bigint")


def smart_resize(height: Column, width: Column, factor: int, min_pixels: Column, max_pixels: Column, floor_sides: bool = True) -> dict[str, Column]:
    """Height and width as multiples of `factor` whose area lies inside the limits, and what is wrong.

    `floor_sides`: sides come out at `factor` at least; without it, sides under `factor` are an error.
    """
    f = F.lit(float(factor))
    h, w = height.cast("double"), width.cast("double")
    rounded_h, rounded_w = F.bround(h / f) * f, F.bround(w / f) * f
    if floor_sides:
        rounded_h, rounded_w = F.greatest(rounded_h, f), F.greatest(rounded_w, f)
    area = rounded_h * rounded_w
    shrink, grow = F.sqrt(h * w / max_pixels), F.sqrt(F.lit(1.0) * min_pixels / (h * w))
    small_h, small_w = F.floor(h / shrink / f) * f, F.floor(w / shrink / f) * f
    if floor_sides:
        small_h, small_w = F.greatest(small_h, f), F.greatest(small_w, f)
    problem = F.when(F.greatest(h, w) / F.least(h, w) > MAX_RATIO, "ratio")
    if not floor_sides:
        problem = F.when((h < f) | (w < f), "too_small").otherwise(problem)
    pick = lambda s, g, r: F.when(problem.isNotNull(), None).when(area > max_pixels, s).when(area < min_pixels, g).otherwise(r).cast("bigint")
    return {"height": pick(small_h, F.ceil(h * grow / f) * f, rounded_h), "width": pick(small_w, F.ceil(w * grow / f) * f, rounded_w), "problem": problem}


def visual_tokens(frames: Column, height: Column, width: Column, patch: int) -> Column:
    """Tokens of a grid of frames and patches: a quarter of their number."""
    return (frames * F.floor(height / patch) * F.floor(width / patch) / 4).cast("bigint")


def frame_count(total: Column, video_fps: Column, nframes: Column, fps: float, least: int, most: int) -> dict[str, Column]:
    """Frames to take of a video: as asked, or by rate inside the limits; always even. A count outside [2, total] is a problem."""
    two = F.lit(FRAME_FACTOR)
    low = F.ceil(F.lit(least) / two) * two
    high = F.floor(F.least(F.lit(most), total) / two) * two
    by_rate = F.least(F.least(F.greatest(total / video_fps * F.lit(float(fps)), low), high), total)
    count = F.when(nframes.isNotNull(), F.bround(nframes / two) * two).otherwise(F.floor(by_rate / two) * two).cast("bigint")
    wrong = (count < FRAME_FACTOR) | (count > total)
    return {"nframes": F.when(~wrong, count), "problem": F.when(wrong, "out_of_range")}


def frame_range(total: Column, fps: Column, start: Column, end: Column) -> dict[str, Column]:
    """First and last frame of a window of seconds, and their number. A window without frames is a problem."""
    length = total / fps
    first = F.when(start.isNull(), F.lit(0)).otherwise(F.ceil(F.greatest(F.lit(0.0), F.least(start, length)) * fps)).cast("bigint")
    last = F.when(end.isNull(), total - 1).otherwise(F.least(F.floor(F.greatest(F.lit(0.0), F.least(end, length)) * fps), total - 1)).cast("bigint")
    wrong = first >= last
    return {"first_frame": F.when(~wrong, first), "last_frame": F.when(~wrong, last), "frames": F.when(~wrong, last - first + 1), "problem": F.when(wrong, "empty_window")}


def frame_indices(first: Column, last: Column, count: Column) -> Column:
    """`count` evenly spaced frames from first to last, rounded."""
    step = F.when(count > 1, (last - first) / (count - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint")), lambda i: F.bround(first + i * step).cast("bigint"))


def frame_plan(total: Column, fps: Column, interval: float, least: int = 4, most: int = 8) -> Column:
    """Different frames of an evenly spaced, truncated choice of one per `interval` seconds, between the limits."""
    count = F.greatest(F.least(F.bround(total / fps / F.lit(float(interval))), F.lit(float(most))), F.lit(float(least))).cast("bigint")
    step = (total - 1) / (count - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.floor(i * step).cast("bigint")))


def bbox_relative(box: list[Column], height: Column, width: Column) -> list[Column]:
    """A pixel box on a scale from 0 to 1000."""
    sides = [width, height, width, height]
    return [F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(v.cast("double") / s * 1000))).cast("bigint") for v, s in zip(box, sides, strict=True)]


def bbox_resized(box: list[Column], height: Column, width: Column, new_height: Column, new_width: Column) -> list[Column]:
    """A pixel box in a resized image, inside its edges."""
    out = []
    for k, v in enumerate(box):
        new, old = (new_width, width) if k % 2 == 0 else (new_height, height)
        out.append(F.greatest(F.lit(0), F.least(F.bround(v.cast("double") * (new.cast("double") / old)), new - 1)).cast("bigint"))
    return out


def frame_budget(nframes: Column, own: Column, min_pixels: int, frame_most: int, total_pixels: int) -> Column:
    """Largest pixels of a frame: the video's share, 5 % over the least at least, and no more than the video's own limit."""
    share = F.greatest(F.least(F.lit(float(frame_most)), F.lit(float(total_pixels)) / nframes * FRAME_FACTOR), F.lit(float(int(min_pixels * 1.05))))
    return F.least(F.coalesce(own.cast("double"), share), share)
