"""Operators across frames: differences, skipping, scene cuts, state carried forward."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import frames as R


def of_pixel() -> WindowSpec:
    return Window.partitionBy("video", "idx").orderBy("frame")


def changes(ix: DataFrame) -> DataFrame:
    """Pixels that differ from the frame before; a first frame differs everywhere (prev is -1)."""
    prev = F.coalesce(F.lag("color").over(of_pixel()), F.lit(-1))
    return ix.withColumn("prev", prev).where(F.col("color") != F.col("prev"))


def frame_rows(ix: DataFrame) -> DataFrame:
    """One row a frame: video, frame, px array<int> in pixel order."""
    return ix.groupBy("video", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "color"))), lambda s: s["color"]).alias("px"))


def is_keyframe(frame: Column, interval: int) -> Column:
    return frame % interval == 0 if interval > 0 else frame == 0


def emitted(ix: DataFrame, interval: int = 30, threshold: float = 0.015) -> DataFrame:
    """video, frame, kind: K keyframe, P sent, S skipped since too little differs from the last frame sent.

    The comparison is with the last frame that was sent, which makes it a fold; it begins anew at each keyframe, so a fold
    holds one interval of frames. With interval 0 it holds a video.
    """
    part = F.floor(F.col("frame") / interval) if interval > 0 else F.lit(0).cast("long")
    spans = frame_rows(ix).withColumn("part", part).groupBy("video", "part").agg(F.array_sort(F.collect_list(F.struct("frame", "px"))).alias("frames"))
    start = F.struct(F.array().cast("array<int>").alias("last"), F.array().cast("array<struct<frame:int,kind:string>>").alias("out"))

    def step(state: Column, f: Column) -> Column:
        differ = F.size(F.filter(F.zip_with(state["last"], f["px"], lambda a, b: a != b), lambda x: x))
        kind = F.when(is_keyframe(f["frame"], interval), "K").when(differ / F.size(f["px"]) < threshold, "S").otherwise("P")
        return F.struct(F.when(kind == "S", state["last"]).otherwise(f["px"]).alias("last"), F.concat(state["out"], F.array(F.struct(f["frame"].alias("frame"), kind.alias("kind")))).alias("out"))

    return spans.select("video", F.inline(F.aggregate("frames", start, step, lambda s: s["out"])))


def deltas(ix: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pixels that each sent frame writes: all of a keyframe, else those that differ from the last sent one. Adds kind."""
    sent = ix.join(kinds.where("kind <> 'S'"), ["video", "frame"])
    prev = F.lag("color").over(of_pixel())
    return sent.withColumn("prev", prev).where((F.col("kind") == "K") | F.col("prev").isNull() | (F.col("color") != F.col("prev"))).drop("prev")


def reconstructed(written: DataFrame, frames: DataFrame, n_pixels: int) -> DataFrame:
    """The screen at every frame: each pixel's last write. frames: video, frame."""
    grid = frames.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n_pixels - 1))))
    seen = grid.join(written.select("video", "frame", "idx", "color"), ["video", "frame", "idx"], "left")
    last = F.last("color", ignorenulls=True).over(of_pixel().rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("color", last).where("color is not null")


def seek(written: DataFrame, target: int) -> DataFrame:
    """The screen at a frame: last writes since the keyframe at or before it. The target is kept within the video."""
    ends = written.groupBy("video").agg(F.max("frame").alias("end"))
    aim = F.greatest(F.lit(0), F.least(F.lit(target), F.col("end")))
    key = written.join(ends, "video").where((F.col("kind") == "K") & (F.col("frame") <= aim)).groupBy("video").agg(F.max("frame").alias("key"), F.max(aim).alias("aim"))
    span = written.join(key, "video").where((F.col("frame") >= F.col("key")) & (F.col("frame") <= F.col("aim")))
    return span.groupBy("video", "idx").agg(F.max_by("color", "frame").alias("color"))


def with_previous(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_before: the pixel one frame earlier; first frames go."""
    out = df.withColumns({f"{c}_before": F.lag(c).over(of_pixel()) for c in columns})
    return out.where(F.col(f"{columns[0]}_before").isNotNull())


def _gradient(gray: np.ndarray) -> np.ndarray:
    """The length of the gradient of (n, h, w) images: central inside, one-sided at borders, none along a side of one pixel."""
    slopes = [np.gradient(gray, axis=axis) if gray.shape[axis] > 1 else np.zeros_like(gray) for axis in (1, 2)]
    return np.sqrt(slopes[0] ** 2 + slopes[1] ** 2)


def _apart(part: str, now: np.ndarray, before: np.ndarray, bins: int = 32) -> np.ndarray:
    """A measure of how much images (n, h, w, 3) differ from those before, one number each."""
    n, size = len(now), now[0].size
    if part == "sad":
        return np.abs(now.astype(np.int32) - before).reshape(n, -1).sum(axis=1) / size
    if part == "hist":
        place = np.arange(n)[:, None] * bins
        counts = [np.bincount((place + x.reshape(n, -1).astype(np.int64) * bins // 256).ravel(), minlength=n * bins).reshape(n, bins) for x in (now, before)]
        return np.abs(counts[0] - counts[1]).sum(axis=1) / size * 255.0
    gray = [x.sum(axis=3, dtype=np.int64) / 3.0 for x in (now, before)]
    return np.abs(_gradient(gray[0]) - _gradient(gray[1])).reshape(n, -1).mean(axis=1)


def frame_differences(px: DataFrame, *parts: str) -> DataFrame:
    """video, frame and a column for each part - sad, hist, edge - of frames that have one before, in one pass."""

    def kernel(videos: list[str], numbers: np.ndarray, now: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = [pa.array(_apart(x, now, before)) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array(videos, pa.string()), pa.array(numbers.astype(np.int32)), *values], ["video", "frame", *parts])

    return R.map_pairs(px, kernel, ", ".join(["video string, frame int", *(f"{x} double" for x in parts)]))


def sad(px: DataFrame) -> DataFrame:
    """video, frame, sad: mean absolute difference of channels from the frame before."""
    return frame_differences(px, "sad")


def histogram(px: DataFrame, bins: int = 32) -> DataFrame:
    """video, frame, bin, n over 0..255, channels together; empty bins are rows too."""
    values = px.select("video", "frame", F.explode(F.array("r", "g", "b")).alias("v"))
    counts = values.groupBy("video", "frame", F.floor(F.col("v") * bins / 256).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    filled = counts.groupBy("video", "frame").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    spots = filled.select("video", "frame", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spots.select("video", "frame", "bin", F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).alias("n"))


def histogram_diff(px: DataFrame, bins: int = 32) -> DataFrame:
    """video, frame, hist: sum of count differences from the frame before, as a share of all channels, times 255."""
    own = histogram(px, bins)
    before = F.lag("n").over(Window.partitionBy("video", "bin").orderBy("frame"))
    own = own.withColumn("before", before).where("before is not null")
    return own.groupBy("video", "frame").agg((F.sum(F.abs(F.col("n") - F.col("before"))) / F.sum("n") * 255.0).alias("hist"))


def edge_diff(px: DataFrame) -> DataFrame:
    """video, frame, edge: mean difference of the gradients of mean grey."""
    return frame_differences(px, "edge")


def scene_score(px: DataFrame) -> DataFrame:
    return frame_differences(px, "sad", "hist", "edge").withColumn("score", 0.5 * F.col("sad") + 0.3 * F.col("hist") + 0.2 * F.col("edge"))


def boundaries(scores: DataFrame, threshold: float = 30.0, least: int = 20, most: int = 300) -> DataFrame:
    """video, gop_id, start_frame, end_frame: a cut where the score is high enough and the last cut far enough, or too far.

    The gap counts from the last cut, hence a fold over the video's scores in order, eight bytes a frame.
    """
    spans = scores.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", "score"))).alias("s"), F.max("frame").alias("end"))

    def step(cuts: Column, s: Column) -> Column:
        gap = s["frame"] - F.element_at(cuts, -1)
        cut = ((s["score"] > threshold) & (gap >= least)) | (gap >= most)
        return F.when(cut, F.concat(cuts, F.array(s["frame"]))).otherwise(cuts)

    cuts = spans.select("video", F.aggregate("s", F.array(F.lit(0)), step).alias("cuts"), (F.col("end") + 1).alias("n"))
    each = cuts.select("video", "n", "cuts", F.posexplode("cuts").alias("gop_id", "start_frame"))
    return each.select("video", "gop_id", "start_frame", F.coalesce(F.try_element_at("cuts", F.col("gop_id") + 2), F.col("n")).alias("end_frame"))


def assign_gops(frames: DataFrame, gops: DataFrame) -> DataFrame:
    """frames with gop_id, by range. Cuts of one video are few; the join is on video with the range as a filter."""
    f, g = frames.alias("f"), gops.alias("g")
    return f.join(g, (F.col("f.video") == F.col("g.video")) & (F.col("f.frame") >= F.col("g.start_frame")) & (F.col("f.frame") < F.col("g.end_frame"))).select("f.*", "g.gop_id")
