"""Kernels with feedback: error diffusion within a frame, temporal rate control within a video, k-means.

Error diffusion passes errors on in raster order; frames are independent, so a kernel works on many at once, pixel line by
pixel line. Rate control passes state from frame to frame: a task streams a video's frames and holds one frame of state;
videos are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.palette import palette_rows
from . import frames as R

# Where errors go (right, down, share), fixed values
WEIGHTS = {
    "atkinson": ((1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8)),
    "burkes": ((1, 0, 8 / 32), (2, 0, 4 / 32), (-2, 1, 2 / 32), (-1, 1, 4 / 32), (0, 1, 8 / 32), (1, 1, 4 / 32), (2, 1, 2 / 32)),
    "sierra": ((1, 0, 2 / 4), (-1, 1, 1 / 4), (0, 1, 1 / 4)),
    "floyd": ((1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)),
}
# Scene classes by the share of pixels that changed, fixed values: below, RDO threshold, ME threshold, budget, dither weight
SCENES = ((0.01, 40.0, 3.0, 0.05, 0.2), (0.05, 25.0, 5.0, 0.10, 0.4), (0.20, 15.0, 7.0, 0.20, 0.5), (0.50, 8.0, 10.0, 0.35, 0.6), (float("inf"), 0.0, 0.0, 1.0, 0.8))


SPACE = 1 << 18  # distances held at once


def slope(method: str) -> int:
    """The least slope of lines slope * y + x = constant on which no pixel depends on another and errors arrive in raster order."""
    reach = WEIGHTS[method]
    apart = [-(-(u - x) // (y - v)) for x, y, _ in reach for u, v, _ in reach if y > v]
    return max([1 - -(-x // y) if x < 0 else 1 for x, y, _ in reach if y] + [-(x // y) + 1 for x, y, _ in reach if y] + apart)


def diffused(images: np.ndarray, colors: np.ndarray, method: str) -> np.ndarray:
    """Palette indices of an (h, w, 3) image, or of many, (n, h, w, 3).

    Pixels are kept by (line, y), so that a line's pixels lie side by side and an error goes to a line further by the same
    shift for all of them; what would leave the frame lands in cells that no pixel has.
    """
    if images.ndim == 3:
        return diffused(images[None], colors, method)[0]
    n, h, w, _ = images.shape
    step, colors = slope(method), colors.astype(np.float32)
    widest = -(-w // step)
    block = max(1, SPACE // (widest * len(colors)))
    if n > block:
        return np.concatenate([diffused(images[at : at + block], colors, method) for at in range(0, n, block)])
    reach = sorted(WEIGHTS[method], key=lambda r: -r[1])
    lines = w + step * (h - 1)
    work = np.zeros((lines + 2 * step + 3, h + 2, 3, n), np.float32)
    for y in range(h):
        work[step * y : step * y + w, y] = images[:, y].transpose(1, 2, 0)
    out = np.zeros((lines, h, n), np.uint8)
    for line in range(lines):
        top, end = max(0, -(-(line - w + 1) // step)), min(h, line // step + 1)
        here = work[line, top:end]
        far = here[:, 0, :, None] - colors[:, 0]
        far *= far
        for c in (1, 2):
            part = here[:, c, :, None] - colors[:, c]
            part *= part
            far += part
        near = far.argmin(axis=2)
        out[line, top:end] = near
        error = here - colors[near].transpose(0, 2, 1)
        for dx, dy, share in reach:
            work[line + step * dy + dx, top + dy : end + dy] += error * np.float32(share)
    place = step * np.arange(h)[:, None] + np.arange(w)
    return out[place, np.arange(h)[:, None]].transpose(2, 0, 1).astype(np.int32)


def error_diffusion(px: DataFrame, method: str, name: str = "full") -> DataFrame:
    """video, frame, idx, color of pixel rows."""
    colors = np.array([row[3:] for row in palette_rows(name)], np.float32)

    def kernel(block: R.Block) -> Iterator[pa.RecordBatch]:
        videos, numbers, images = block
        yield R.rows_of(videos, numbers, *images.shape[1:3], color=diffused(images, colors, method))

    return R.map_rows(px, ("video", "frame"), lambda: kernel, "video string, frame int, idx int, color int")


def error_diffusion_packed(frames: DataFrame, method: str, name: str = "full") -> DataFrame:
    """video, frame, width, height, colors (a byte a pixel) of packed frames, without a shuffle."""
    colors = np.array([row[3:] for row in palette_rows(name)], np.float32)

    def kernel(block: R.Block) -> Iterator[pa.RecordBatch]:
        videos, numbers, images = block
        yield R.packed_of(videos, numbers, diffused(images, colors, method).astype(np.uint8), "colors")

    return R.map_packed(frames, lambda: kernel, "video string, frame int, width int, height int, colors binary")


def box_mean(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1)
    return sum(p[dy : dy + a.shape[0], dx : dx + a.shape[1]] for dy in range(3) for dx in range(3)) / 9.0


def oklab_array(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    light = np.where(c > 0.04045, ((np.maximum(c, 0) + 0.055) / 1.055) ** 2.4, c / 12.92)
    cones = light @ np.array(C.TO_CONES).T
    return (np.sign(cones) * np.abs(cones) ** (1 / 3)) @ np.array(C.TO_LAB).T


def scene(ratio: float) -> tuple[float, float, float, float]:
    return next(row[1:] for row in SCENES if ratio < row[0])


class RateControl:
    """One video's sender. What it remembers is a frame wide: the picture before, the indices on the screen, the error that the
    next picture should make up for, and for how long and how much each pixel has wanted to change."""

    def __init__(self, colors: np.ndarray):
        self.colors, self.lab = colors, oklab_array(colors)
        self.screen: np.ndarray | None = None

    def frame(self, image: np.ndarray) -> np.ndarray:
        """The indices on the screen after a picture, (h, w, 3)."""
        if self.screen is None:
            self.debt, self.wish = np.zeros_like(image), np.zeros(image.shape[:2])
        target = image + self.debt
        lab = oklab_array(target)
        screen, carried = self.nearest(lab), 0.5
        if self.screen is not None:
            moved = box_mean(np.abs(image - self.picture).mean(axis=2))
            rdo, me, share, carried = scene(float((moved > 5.0).mean()))
            off = np.sqrt(((lab - self.lab[self.screen]) ** 2).sum(axis=2))
            restless = (moved >= me) & (off >= rdo / 255.0 * tolerance(image))
            self.wish += np.where(restless, off, 0)
            screen = np.where(self.allowed(restless, int(screen.size * share)), screen, self.screen)
            self.wish[screen != self.screen] = 0
        self.debt = np.clip((target - self.colors[screen]) * carried, -32, 32)
        self.screen, self.picture = screen, image
        return screen

    def nearest(self, lab: np.ndarray) -> np.ndarray:
        far = sum((lab[..., i, None] - self.lab[:, i]) ** 2 for i in range(3))
        return far.argmin(axis=2)

    def allowed(self, restless: np.ndarray, budget: int) -> np.ndarray:
        """Pixels that may change: all restless ones if the budget holds them, else the strongest wishes, first ones of equals."""
        if restless.sum() <= budget:
            return restless
        out = np.zeros(restless.size, bool)
        out[np.argsort(-self.wish, axis=None, kind="stable")[:budget]] = True
        return out.reshape(restless.shape)


def tolerance(image: np.ndarray) -> np.ndarray:
    """3 where a picture is flat, down to 1 where it varies."""
    gray = image.mean(axis=2)
    variance = np.maximum(box_mean(gray**2) - box_mean(gray) ** 2, 0)
    return 1 + 2 * (1 - np.clip(variance / 500.0, 0, 1))


def rate_controlled(px: DataFrame, name: str = "full") -> DataFrame:
    """video, frame, idx, color: palette indices under the temporal budget. A task streams the videos it gets."""
    colors = np.array([row[3:] for row in palette_rows(name)], float)

    def make():
        video, state = None, RateControl(colors)

        def kernel(block: R.Block) -> Iterator[pa.RecordBatch]:
            nonlocal video, state
            videos, numbers, images = block
            out = np.empty(images.shape[:3], np.int32)
            for i, own in enumerate(videos):
                if own != video:
                    video, state = own, RateControl(colors)
                out[i] = state.frame(images[i].astype(float))
            yield R.rows_of(videos, numbers, *images.shape[1:3], color=out)

        return kernel

    return R.map_rows(px, ("video",), make, "video string, frame int, idx int, color int")


def scene_class(ratio: Column) -> Column:
    """struct<rdo, me, budget, weight> of a change ratio."""
    out = None
    for below, *values in reversed(SCENES):
        row = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("rdo", "me", "budget", "weight"), strict=True)])
        out = row if out is None else F.when(ratio < below, row).otherwise(out)
    return out


def kmeans_assign(points: DataFrame, centroids: list[tuple[float, float, float]]) -> DataFrame:
    """Adds k, the nearest centroid, lowest of equals. points: r, g, b, n (how many)."""
    table = F.array(*[F.struct(F.lit(i).alias("k"), *[F.lit(float(v)).alias(n) for v, n in zip(c, "rgb", strict=True)]) for i, c in enumerate(centroids)])

    def far(c: Column) -> Column:
        return (F.col("r") - c["r"]) * (F.col("r") - c["r"]) + (F.col("g") - c["g"]) * (F.col("g") - c["g"]) + (F.col("b") - c["b"]) * (F.col("b") - c["b"])

    return points.withColumn("k", F.array_min(F.transform(table, lambda c: F.struct(F.round(far(c), 9).alias("d"), c["k"].alias("k"))))["k"])


def kmeans_update(assigned: DataFrame) -> DataFrame:
    """k, r, g, b, n: weighted means."""
    return assigned.groupBy("k").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"], F.sum("n").alias("n"))


def distinct_points(px: DataFrame, every: int = 10, most_frames: int = 30) -> DataFrame:
    """Distinct colours of the sampled frames and their counts; the sample is the method's own: 30 frames at most."""
    taken = px.where((F.col("frame") % every == 0) & (F.col("frame") < every * most_frames))
    return taken.groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def first_centroids(points: DataFrame, k: int) -> list[tuple[float, float, float]]:
    """The k smallest distinct colours: the same on every run."""
    return [tuple(map(float, row)) for row in points.select("r", "g", "b").orderBy("r", "g", "b").limit(k).collect()]


def kmeans(px: DataFrame, k: int, rounds: int = 10, close: float = 1e-2) -> list[tuple[float, float, float]]:
    """Lloyd's rounds; each collects k rows. An empty cluster keeps its place."""
    points = distinct_points(px).cache()
    try:
        now = first_centroids(points, k)
        for _ in range(rounds):
            moved = {row["k"]: (row["r"], row["g"], row["b"]) for row in kmeans_update(kmeans_assign(points, now)).collect()}
            after = [moved.get(i, c) for i, c in enumerate(now)]
            done = all(abs(a - b) <= close for x, y in zip(now, after, strict=True) for a, b in zip(x, y, strict=True))
            now = after
            if done:
                break
        return now
    finally:
        points.unpersist()
