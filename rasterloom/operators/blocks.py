"""Tile dictionaries and block motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames as R


def tiles(ix: DataFrame, size: int) -> DataFrame:
    """video, frame, tx, ty, digest, px: each tile's colours in order."""
    spot = (F.col("y") % size) * size + F.col("x") % size
    own = ix.select("video", "frame", F.floor(F.col("x") / size).cast("int").alias("tx"), F.floor(F.col("y") / size).cast("int").alias("ty"), spot.alias("spot"), "color")
    listed = own.groupBy("video", "frame", "tx", "ty").agg(F.transform(F.array_sort(F.collect_list(F.struct("spot", "color"))), lambda s: s["color"]).alias("px"))
    return listed.withColumn("digest", F.md5(F.array_join(F.transform("px", lambda c: c.cast("string")), ",")))


def dictionary(found: DataFrame) -> DataFrame:
    """video, digest, tile_id, first_frame, px: distinct tiles, numbered as they first appear (frame, ty, tx)."""
    first = found.groupBy("video", "digest").agg(F.min(F.struct("frame", "ty", "tx")).alias("at"), F.first("px").alias("px"))
    rank = F.row_number().over(Window.partitionBy("video").orderBy("at"))
    return first.select("video", "digest", (rank - 1).alias("tile_id"), F.col("at.frame").alias("first_frame"), "px")


def tile_map(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("video", "digest", "tile_id"), ["video", "digest"]).select("video", "frame", "tx", "ty", "tile_id")


def from_tiles(mapped: DataFrame, known: DataFrame, size: int, width: int) -> DataFrame:
    """Tiles back to pixels."""
    full = mapped.join(known.select("video", "tile_id", "px"), ["video", "tile_id"])
    each = full.select("video", "frame", "tx", "ty", F.posexplode("px").alias("spot", "color"))
    y, x = F.col("ty") * size + F.floor(F.col("spot") / size).cast("int"), F.col("tx") * size + F.col("spot") % size
    return each.select("video", "frame", (y * width + x).alias("idx"), "color")


def savings(mapped: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """video, frame, n_tiles, new_tiles, payload (2 bytes a tile, size * size for a new one), raw bytes."""
    grid = mapped.groupBy("video", "frame").agg(F.count("*").alias("n_tiles"))
    new = known.groupBy("video", F.col("first_frame").alias("frame")).agg(F.count("*").alias("new_tiles"))
    own = grid.join(new, ["video", "frame"], "left").withColumn("new_tiles", F.coalesce("new_tiles", F.lit(0).cast("long")))
    return own.withColumn("payload", F.col("n_tiles") * 2 + F.col("new_tiles") * size * size).withColumn("raw", F.col("n_tiles") * size * size)


def motion(px: DataFrame, block: int, reach: int, most_sad: int | None = None) -> DataFrame:
    """video, frame, bx, by, dx, dy, sad: the shift whose source block in the frame before differs least.

    A candidate counts only if its whole source block lies in the frame. Equal sums go to the shortest shift, then the
    smallest (dy, dx). Blocks whose best is above most_sad have null shifts: they are sent as they are.
    """
    shifts = sorted(((dx, dy) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: (abs(s[0]) + abs(s[1]), s[1], s[0]))

    def kernel(videos: list[str], numbers: np.ndarray, now: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, h, w, _ = now.shape
        rows, cols = h // block, w // block
        here, there = (x.sum(axis=3, dtype=np.int32) for x in (now, before))
        least = np.full((n, rows, cols), np.iinfo(np.int64).max)
        which = np.full((n, rows, cols), -1, np.int32)
        top, left = np.arange(rows)[:, None] * block, np.arange(cols) * block
        for k, (dx, dy) in enumerate(shifts):
            moved = np.zeros_like(there)
            y0, y1, x0, x1 = max(dy, 0), min(h, h + dy), max(dx, 0), min(w, w + dx)
            if y0 >= y1 or x0 >= x1:
                continue
            moved[:, y0:y1, x0:x1] = there[:, y0 - dy : y1 - dy, x0 - dx : x1 - dx]
            off = np.abs(here - moved)[:, : rows * block, : cols * block].reshape(n, rows, block, cols, block).sum(axis=(2, 4), dtype=np.int64)
            whole = (top >= y0) & (top + block <= y1) & (left >= x0) & (left + block <= x1)
            better = whole & (off < least)
            least[better], which[better] = off[better], k
        at = np.nonzero(which >= 0)
        shift = np.array(shifts, np.int32)[which[at]]
        columns = [np.asarray(numbers, np.int32)[at[0]], at[2].astype(np.int32), at[1].astype(np.int32), shift[:, 0], shift[:, 1], least[at]]
        names = pa.array(videos, pa.string()).take(pa.array(at[0]))
        yield pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], ["video", "frame", "bx", "by", "dx", "dy", "sad"])

    best = R.map_pairs(px, kernel, "video string, frame int, bx int, by int, dx int, dy int, sad long")
    if most_sad is None:
        return best
    return best.select("video", "frame", "bx", "by", *[F.when(F.col("sad") <= most_sad, F.col(c)).alias(c) for c in ("dx", "dy")], "sad")


def compensate(ix: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """Adds predicted: the pixel that the block's shift copies from the frame before, or its own where there is no shift."""
    own = ix.withColumns({"bx": F.floor(F.col("x") / block).cast("int"), "by": F.floor(F.col("y") / block).cast("int")}).join(vectors, ["video", "frame", "bx", "by"])
    own = own.withColumns({"from_frame": F.col("frame") - 1, "from_x": F.col("x") - F.col("dx"), "from_y": F.col("y") - F.col("dy")})
    before = ix.select("video", F.col("frame").alias("from_frame"), F.col("x").alias("from_x"), F.col("y").alias("from_y"), F.col("color").alias("copied"))
    found = own.join(before, ["video", "from_frame", "from_x", "from_y"], "left")
    return found.select("video", "frame", "idx", "color", F.coalesce("copied", "color").alias("predicted"), F.col("copied").isNull().alias("raw"))
