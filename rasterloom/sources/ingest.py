"""Frames from files, at the rate and size that is asked for: raw RGB24 streams, PNG folders, resampling, scaling."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames as R
from .scratch import opened, stored

SLICE = 8 << 20  # bytes of a raw file that a task reads at once
MOST_TASKS = 20_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Short rows that stand for much work, one a task. The number is given, or adaptive execution would merge them."""
    return rows.repartition(max(1, min(MOST_TASKS, rows.count())), *keys)


def stem(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def raw_frames(spark: SparkSession, path: str, width: int, height: int, fps: float = 20.0, seconds: float | None = None) -> DataFrame:
    """Packed frames of files of raw RGB24 frames; a partial last frame is dropped.

    Files are listed without their contents and cut into slices of whole frames, which tasks read by their place, so that a
    file's size is bounded by nothing.
    """
    size = width * height * 3
    step = max(1, SLICE // size)
    whole = F.floor(F.col("length") / size)
    n = (whole if seconds is None else F.least(whole, F.lit(int(seconds * fps)))).cast("int")
    files = spark.read.format("binaryFile").load(path).select("path", n.alias("n")).where("n > 0")
    slices = files.select("path", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("first"))
    slices = spread(slices.select(stem(F.col("path")).alias("video"), "path", "first", F.least(F.lit(step), F.col("n") - F.col("first")).alias("n")), "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, name, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, local = opened(name)
                with store.open_input_file(local) as f:
                    data = f.read_at(n * size, first * size)
                images = np.frombuffer(data, np.uint8).reshape(n, height, width, 3)
                yield R.packed_of([video] * n, np.arange(first, first + n), images)

    return slices.mapInArrow(run, R.PACKED)


def png_pixels(data: bytes) -> np.ndarray:
    """(h, w, 3) of a PNG of 8 bits a channel that isn't interlaced: grey, colour, palette, with or without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    pos, packed, palette, head = 8, [], None, None
    while pos + 8 <= len(data):
        size, name = struct.unpack_from(">I", data, pos)[0], data[pos + 4 : pos + 8]
        body = data[pos + 8 : pos + 8 + size]
        pos += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, depth, kind, _, _, woven = head
    if depth != 8 or woven or kind not in (0, 2, 3, 4, 6):
        raise ValueError("only PNGs of 8 bits a channel that aren't interlaced are read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.int32)
    for y in range(h):
        how, now = lines[y, 0], lines[y, 1:].reshape(w, n).astype(np.int32)
        if how == 1:
            now = np.cumsum(now, axis=0)
        elif how == 2:
            now = now + above
        elif how in (3, 4):
            left, corner = np.zeros(n, np.int32), np.zeros(n, np.int32)
            for x in range(w):
                up = above[x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (now[x] + guess) & 255, up
                now[x] = left
        above = now & 255
        out[y] = above
    if kind == 3:
        return palette[out[..., 0]]
    return out[..., :3] if n >= 3 else np.repeat(out[..., :1], 3, axis=2)


def png_bytes(image: np.ndarray) -> bytes:
    """An (h, w, 3) image of bytes as a PNG."""
    h, w, _ = image.shape

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def numbered(rows: DataFrame, by: str, out: str) -> DataFrame:
    """rows with out, their place from 0 in the order of a column, without one task that sorts them all.

    The ranges are written: they are cut by a sample and merged by size, both of which may differ when they are made again.
    """
    ranged = stored(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row a partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    known = ranged.withColumn("_rank", rank).join(F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _before long")), "_part")
    return known.withColumn(out, (F.col("_before") + F.col("_rank")).cast("int")).drop("_part", "_rank", "_before")


def png_frames(spark: SparkSession, path: str, video: str) -> DataFrame:
    """Packed frames of a folder of PNGs, numbered in the order of their names."""
    names = numbered(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path"), "path", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, local = opened(name)
                with store.open_input_file(local) as f:
                    image = png_pixels(f.read())
                yield R.packed_of([video], np.array([frame]), image[None])

    return spread(names.select("path", "frame"), "path").mapInArrow(run, R.PACKED)


def write_pngs(frames: DataFrame, path: str) -> int:
    """A PNG a frame, <video>_<frame>.png, the frame in eight digits; returns how many."""
    store, local = opened(path)
    store.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, local = opened(path)
        for videos, numbers, images in R.images_of_packed(batches):
            for video, frame, image in zip(videos, numbers, images, strict=True):
                with store.open_output_stream(f"{local}/{video}_{frame:08d}.png") as f:
                    f.write(png_bytes(image))
            yield pa.RecordBatch.from_arrays([pa.array([len(videos)], pa.int64())], ["n"])

    return frames.select("video", "frame", "width", "height", "rgb").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def resampled(frames: DataFrame, source_fps: float, fps: float) -> DataFrame:
    """Frames at another rate: frame i of the source stands from its own time, rounded to a frame of the target, until the next
    one's; frames that the target has no time for go, others are repeated. Pixel rows or packed frames."""

    def at(frame: Column) -> Column:
        return F.floor(frame * (fps / source_fps) + 0.5).cast("int")

    times = F.when(at(F.col("frame") + 1) > at(F.col("frame")), F.sequence(at(F.col("frame")), at(F.col("frame") + 1) - 1)).otherwise(F.array().cast("array<int>"))
    others = [c for c in frames.columns if c != "frame"]
    return frames.select(*others, F.explode(times).alias("frame")).select(*frames.columns)


def bilinear(images: np.ndarray, w: int, h: int) -> np.ndarray:
    """Images (n, height, width, 3) at another size: the four pixels around a point, centres at halves, borders repeated."""
    if images.shape[1:3] == (h, w):
        return images
    out = images.astype(float)
    for axis, size in ((1, h), (2, w)):
        old = out.shape[axis]
        spot = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        first = np.floor(spot).astype(int)
        part = (spot - first).reshape([-1 if i == axis else 1 for i in range(4)])
        out = out.take(first, axis) * (1 - part) + out.take(np.minimum(first + 1, old - 1), axis) * part
    return np.floor(np.floor(out * 1e6 + 0.5) / 1e6 + 0.5).astype(np.uint8)


def area(images: np.ndarray, w: int, h: int) -> np.ndarray:
    """Images at a smaller size that divides theirs: means of blocks. Other sizes are scaled by bilinear()."""
    n, old_h, old_w, _ = images.shape
    if old_h % h or old_w % w:
        return bilinear(images, w, h)
    means = images.reshape(n, h, old_h // h, w, old_w // w, 3).astype(float).mean(axis=(2, 4))
    return np.floor(means + 0.5).astype(np.uint8)


def fitted(width: int, height: int, w: int, h: int) -> tuple[int, int, int, int]:
    """Width, height, left and top of a frame scaled into w x h with its aspect kept."""
    if width * h >= w * height:
        new_w, new_h = w, max(1, (w * height * 2 + width) // (2 * width))
    else:
        new_w, new_h = max(1, (h * width * 2 + height) // (2 * height)), h
    return new_w, new_h, (w - new_w) // 2, (h - new_h) // 2


def scaled(frames: DataFrame, width: int, height: int, mode: str = "letterbox") -> DataFrame:
    """Packed frames of width x height: letterbox keeps the aspect and pads with black, stretch doesn't, area takes means. Frames
    of that size stay as they are."""
    if mode not in ("letterbox", "stretch", "area"):
        raise ValueError(f"no such mode: {mode}")

    def kernel(block: R.Block) -> Iterator[pa.RecordBatch]:
        videos, numbers, images = block
        if images.shape[1:3] != (height, width):
            if mode == "letterbox":
                w, h, left, top = fitted(images.shape[2], images.shape[1], width, height)
                out = np.zeros((len(images), height, width, 3), np.uint8)
                out[:, top : top + h, left : left + w] = bilinear(images, w, h)
                images = out
            else:
                images = (bilinear if mode == "stretch" else area)(images, width, height)
        yield R.packed_of(videos, numbers, images)

    return R.map_packed(frames, lambda: kernel, R.PACKED)
