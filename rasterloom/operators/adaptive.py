"""A palette for each group of frames, made of what the group shows, and matching, encoding and decoding with it.

Entries are known by their number in the whole palette, so that frames on both sides of a change of palettes can be compared;
a pixel's number within its group's palette is what is written. Groups whose first frames look alike, by a hash of a
thumbnail, share the palette of the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.palette import palette_rows
from . import frames as R
from . import temporal as T


def thumbnails(frames: DataFrame, gops: DataFrame, step: int = 8) -> DataFrame:
    """video, gop_id, digest: of each step-th pixel of each step-th row of a group's first frame. frames: packed."""

    def kernel(block: R.Block) -> Iterator[pa.RecordBatch]:
        videos, numbers, images = block
        yield R.packed_of(videos, numbers, images[:, ::step, ::step], "thumb")

    firsts = frames.join(gops.select("video", F.col("start_frame").alias("frame"), "gop_id"), ["video", "frame"])
    small = R.map_packed(firsts, lambda: kernel, "video string, frame int, width int, height int, thumb binary")
    known = small.select("video", "frame", F.md5(F.concat(F.concat_ws("x", "width", "height").cast("binary"), "thumb")).alias("digest"))
    return known.join(gops.select("video", F.col("start_frame").alias("frame"), "gop_id"), ["video", "frame"]).select("video", "gop_id", "digest")


def samples(frames: DataFrame, gops: DataFrame, every: int = 10, most_frames: int = 30) -> DataFrame:
    """video, gop_id, r, g, b, n: distinct colours of each every-th frame of a group, the first most_frames of those: the limit
    is the method's own. frames: packed, with gop_id and start_frame."""
    place = F.col("frame") - F.col("start_frame")
    taken = frames.join(gops.select("video", "gop_id", "start_frame"), ["video", "gop_id"]).where((place % every == 0) & (place < every * most_frames))

    def colours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, gop, rgb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, n = np.unique(np.frombuffer(rgb, np.uint8).reshape(-1, 3), axis=0, return_counts=True)
                cols = [pa.array([video] * len(n)), pa.array([gop] * len(n), pa.int64()), *(pa.array(seen[:, i].astype(np.int32)) for i in range(3)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["video", "gop_id", "r", "g", "b", "n"])

    rows = taken.select("video", F.col("gop_id").cast("long").alias("gop_id"), "rgb").mapInArrow(colours, "video string, gop_id long, r int, g int, b int, n long")
    return rows.groupBy("video", "gop_id", "r", "g", "b").agg(F.sum("n").alias("n"))


def centres(points: np.ndarray, counts: np.ndarray, k: int, rounds: int = 10, close: float = 1e-2) -> np.ndarray:
    """Lloyd's rounds over distinct colours in order, weighted by their counts, from the k first; an empty cluster keeps its place."""
    now = points[:k].astype(float)
    for _ in range(rounds):
        far = sum((points[:, i, None] - now[:, i]) ** 2 for i in range(3))
        own = np.floor(far * 1e9 + 0.5).argmin(axis=1)
        weight = np.bincount(own, counts, len(now))
        sums = np.stack([np.bincount(own, counts * points[:, i], len(now)) for i in range(3)], axis=1)
        after = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], now)
        done = bool((np.abs(after - now) <= close).all())
        now = after
        if done:
            break
    return now


def chosen(middle: np.ndarray, inks: np.ndarray, size: int) -> list[int]:
    """Entries nearest to the centres, each once, in the centres' order, filled up with the others in theirs."""
    near = [int((((ink := inks - c) * ink).sum(axis=1)).round(6).argmin()) for c in middle]
    return list(dict.fromkeys([*near, *range(len(inks))]))[:size]


def palettes(frames: DataFrame, gops: DataFrame, name: str = "all", size: int = 64) -> DataFrame:
    """video, gop_id, digest, inks (array<int>: numbers of the named palette's entries, in the group's order).

    A k-means is one group's colours in one task: of 30 frames at most, so its size is bounded by theirs.
    """
    inks = np.array([row[3:] for row in palette_rows(name)], float)
    digests = thumbnails(frames, gops)
    firsts = digests.groupBy("video", "digest").agg(F.min("gop_id").alias("gop_id"))
    with_gops = T.assign_gops(frames, gops.withColumn("gop_id", F.col("gop_id").cast("long"))).join(firsts.select("video", F.col("gop_id").cast("long").alias("gop_id")), ["video", "gop_id"])
    points = samples(with_gops, gops.withColumn("gop_id", F.col("gop_id").cast("long")))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["r", "g", "b"])
        middle = centres(group[["r", "g", "b"]].to_numpy(float), group["n"].to_numpy(float), min(size, len(inks)))
        return pd.DataFrame({"video": group["video"].iloc[:1], "gop_id": group["gop_id"].iloc[:1], "inks": [chosen(middle, inks, size)]})

    made = points.groupBy("video", "gop_id").applyInPandas(fit, "video string, gop_id long, inks array<int>")
    by_digest = firsts.join(made, ["video", "gop_id"]).select("video", "digest", "inks")
    return digests.join(by_digest, ["video", "digest"]).select("video", "gop_id", "digest", "inks")


def matched(frames: DataFrame, gops: DataFrame, made: DataFrame, name: str = "all") -> DataFrame:
    """video, frame, idx, x, y, gop_id, color, local: the nearest entry of the group's palette, by its number in the whole
    palette and in the group's, the first of equals."""
    inks = np.array([row[3:] for row in palette_rows(name)], np.int64)
    own = T.assign_gops(frames, gops).join(made.select("video", "gop_id", "inks"), ["video", "gop_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, frame, gop, w, h, rgb, own_inks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                px = np.frombuffer(rgb, np.uint8).reshape(-1, 3).astype(np.int64)
                own_inks = np.array(own_inks)
                local = sum((px[:, i, None] - inks[own_inks, i]) ** 2 for i in range(3)).argmin(axis=1).astype(np.int32)
                place, n = np.arange(w * h, dtype=np.int32), w * h
                values = {"x": place % w, "y": place // w, "gop_id": np.full(n, gop, np.int64), "color": own_inks[local].astype(np.int32), "local": local}
                yield R.rows_of([video], np.array([frame]), h, w, **values)

    cols = own.select("video", "frame", F.col("gop_id").cast("long").alias("gop_id"), "width", "height", "rgb", "inks")
    return cols.mapInArrow(run, "video string, frame int, idx int, x int, y int, gop_id long, color int, local int")


def localised(runs: DataFrame, gops: DataFrame, made: DataFrame) -> DataFrame:
    """Runs of whole-palette numbers as runs of their group's."""
    own = T.assign_gops(runs, gops).join(made.select("video", "gop_id", "inks"), ["video", "gop_id"])
    return own.withColumn("color", (F.array_position("inks", F.col("color")) - 1).cast("int")).drop("inks", "gop_id")


def level_lists(made: DataFrame, name: str = "all") -> DataFrame:
    """One row a video: levels, a list of entries for each group."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("block"), F.array(*map(F.lit, rgb)).alias("rgb")) for _, n, b, *rgb in palette_rows(name)])
    listed = made.select("video", "gop_id", F.transform("inks", lambda i: F.element_at(entries, i + 1)).alias("level"))
    return listed.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("gop_id", "level"))), lambda s: s["level"]).alias("levels"))


def with_levels(containers: DataFrame, levels: DataFrame) -> DataFrame:
    """Containers of one palette as containers of a palette a group: (video, container)."""
    head = F.regexp_replace("container", r'"adaptive_palette":false', '"adaptive_palette":true')
    whole = F.concat(F.regexp_extract(head, r'(?s)^(.*?"level_blocks":)\[.*?\]\}\],"index"', 1), F.to_json("levels"), F.lit(',"index"'), F.regexp_extract(head, r'(?s)^.*?"level_blocks":\[.*?\]\}\],"index"(.*)$', 1))
    return containers.join(levels, "video").select("video", whole.alias("container"))


def decoded(containers: DataFrame, writes: DataFrame) -> DataFrame:
    """video, frame, idx, block, r, g, b of writes (video, frame, idx, color): a number means what the frame's group's palette
    says."""
    cuts = "gop_boundaries array<int>, level_blocks array<array<struct<name:string,block:string,rgb:array<int>>>>"
    own = containers.select("video", F.from_json("container", cuts).alias("c"))
    groups = own.select("video", F.posexplode("c.level_blocks").alias("gop_id", "level"), "c.gop_boundaries")
    groups = groups.select("video", "gop_id", "level", F.element_at("gop_boundaries", F.col("gop_id") + 1).alias("start_frame"), F.element_at("gop_boundaries", F.col("gop_id") + 2).alias("end_frame"))
    found = T.assign_gops(writes, groups.drop("level")).join(groups.select("video", "gop_id", F.posexplode("level").alias("color", "ink")), ["video", "gop_id", "color"])
    return found.select("video", "frame", "idx", "ink.block", *[F.element_at("ink.rgb", i + 1).alias(c) for i, c in enumerate("rgb")])


def packed_deltas(matched_px: DataFrame, kinds: DataFrame) -> DataFrame:
    """What is written: pixels whose entry, by its number in the whole palette, isn't the one shown."""
    return T.deltas(matched_px.select("video", "frame", "idx", "x", "y", "color"), kinds)


