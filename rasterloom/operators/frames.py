"""Whole frames: pixel rows as streams of images, and packed frames, one row each.

Packed frames are (video, frame, width, height, rgb), rgb the bytes of height x width x 3. They come packed from sources and
move a frame as one value; pixel rows are put together by one shuffle on (video, frame) and a sort, whose stream is cut into
images batch by batch, so that a task holds a block of frames and never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "video string, frame int, width int, height int, rgb binary"
BLOCK = 1 << 20  # pixels in a block of frames

Block = tuple[list[str], np.ndarray, np.ndarray]  # videos, frame numbers, images (n, height, width, 3)


def images_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of frames of one size from (video, frame, y, r, g, b) rows in order of video, frame and index."""

    def cut(rows: pa.Table, last: bool) -> Iterator[tuple[int, int]]:
        """Start and end of each frame that is complete."""
        frame = rows.column("frame").to_numpy()
        video = rows.column("video").combine_chunks().dictionary_encode()
        video = (video.chunk(0) if isinstance(video, pa.ChunkedArray) else video).indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero((frame[1:] != frame[:-1]) | (video[1:] != video[:-1])) + 1
        edges = [0, *new.tolist(), *([len(frame)] if last else [])]
        yield from zip(edges[:-1], edges[1:], strict=True)

    def blocks(rows: pa.Table, spans: list[tuple[int, int]]) -> Iterator[Block]:
        rgb = np.stack([rows.column(c).to_numpy() for c in "rgb"], axis=1)
        frame, y, video = rows.column("frame").to_numpy(), rows.column("y").to_numpy(), rows.column("video")
        at = 0
        while at < len(spans):
            a, b = spans[at]
            height, size = int(y[b - 1]) + 1, b - a
            most = max(1, BLOCK // size)
            end = at
            while end < len(spans) and end - at < most and spans[end][1] - spans[end][0] == size and int(y[spans[end][1] - 1]) + 1 == height:
                end += 1
            starts = [s for s, _ in spans[at:end]]
            yield [video[s].as_py() for s in starts], frame[starts], rgb[a : spans[end - 1][1]].reshape(end - at, height, -1, 3)
            at = end

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            rows = pa.Table.from_batches(held)
            spans = list(cut(rows, False))
            if spans:
                yield from blocks(rows, spans)
                held = rows.slice(spans[-1][1]).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held)
    if n:
        rows = pa.Table.from_batches(held)
        yield from blocks(rows, list(cut(rows, True)))


def images_of_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of frames of one size from packed frames."""
    for batch in batches:
        sizes = list(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True))
        at = 0
        while at < batch.num_rows:
            h, w = sizes[at]
            most, end = max(1, BLOCK // (h * w)), at
            while end < batch.num_rows and end - at < most and sizes[end] == (h, w):
                end += 1
            part = batch.slice(at, end - at)
            rgb = np.frombuffer(b"".join(x.as_py() for x in part.column("rgb")), np.uint8).reshape(end - at, h, w, 3)
            yield part.column("video").to_pylist(), part.column("frame").to_numpy(), rgb
            at = end


def rows_of(videos: list[str], frames: np.ndarray, h: int, w: int, **values: np.ndarray) -> pa.RecordBatch:
    """Pixel rows of a block: video, frame, idx and values, arrays of one number a pixel."""
    n = len(frames)
    video = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(n, dtype=np.int32), h * w)), pa.array(videos, pa.string())).cast(pa.string())
    cols = [video, pa.array(np.repeat(frames.astype(np.int32), h * w)), pa.array(np.tile(np.arange(h * w, dtype=np.int32), n)), *(pa.array(v.ravel()) for v in values.values())]
    return pa.RecordBatch.from_arrays(cols, ["video", "frame", "idx", *values])


def packed_of(videos: list[str], frames: np.ndarray, images: np.ndarray, name: str = "rgb") -> pa.RecordBatch:
    """Packed frames of a block of images (n, height, width, ...) of bytes."""
    n, h, w = images.shape[:3]
    size = [pa.array(np.full(n, x, np.int32)) for x in (w, h)]
    data = pa.array([np.ascontiguousarray(x).tobytes() for x in images], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(videos, pa.string()), pa.array(frames.astype(np.int32)), *size, data], ["video", "frame", "width", "height", name])


def in_order(px: DataFrame, *keys: str) -> DataFrame:
    """Pixel rows as images_of_rows needs them, all of a key in one task."""
    own = px.select("video", "frame", "idx", "y", "r", "g", "b")
    return own.repartition(*keys).sortWithinPartitions("video", "frame", "idx")


def map_rows(px: DataFrame, keys: tuple[str, ...], make: Callable[[], Callable[[Block], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """A kernel over blocks of frames of pixel rows. make() gives a task its kernel, which may keep state between blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for block in images_of_rows(batches):
            yield from kernel(block)

    return in_order(px, *keys).mapInArrow(run, schema)


def map_packed(frames: DataFrame, make: Callable[[], Callable[[Block], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """The same over packed frames, where they are: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for block in images_of_packed(batches):
            yield from kernel(block)

    return frames.select("video", "frame", "width", "height", "rgb").mapInArrow(run, schema)


def pack(px: DataFrame) -> DataFrame:
    """Pixel rows to packed frames."""

    def kernel(block: Block) -> Iterator[pa.RecordBatch]:
        videos, numbers, images = block
        yield packed_of(videos, numbers, images.astype(np.uint8))

    return map_rows(px, ("video", "frame"), lambda: kernel, PACKED)


def unpack(frames: DataFrame) -> DataFrame:
    """Packed frames to pixel rows: video, frame, idx, x, y, r, g, b."""

    def kernel(block: Block) -> Iterator[pa.RecordBatch]:
        videos, numbers, images = block
        n, h, w, _ = images.shape
        place = np.tile(np.arange(h * w, dtype=np.int32), n)
        yield rows_of(videos, numbers, h, w, x=place % w, y=place // w, **{c: images[..., i].astype(np.int32) for i, c in enumerate("rgb")})

    return map_packed(frames, lambda: kernel, "video string, frame int, idx int, x int, y int, r int, g int, b int")


def map_pairs(px: DataFrame, kernel: Callable[[list[str], np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A kernel over blocks of (videos, frame numbers, images, images before), for all frames that have one before.

    Pixel rows are shuffled once, to put frames together; what meets its neighbour after that is a packed frame, a value.
    """
    packed = pack(px)
    before = packed.select("video", (F.col("frame") + 1).alias("frame"), F.col("rgb").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            earlier = [np.frombuffer(x.as_py(), np.uint8) for x in batch.column("before")]
            for videos, numbers, images in images_of_packed(iter([batch])):
                yield from kernel(videos, numbers, images, np.stack(earlier[at : at + len(videos)]).reshape(images.shape))
                at += len(videos)

    return packed.join(before, ["video", "frame"]).select("video", "frame", "width", "height", "rgb", "before").mapInArrow(run, schema)
