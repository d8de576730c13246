"""What leaves the engine for others: animated GIFs and packs, zip files of a video's scripts."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import opened


def lzw(values: bytes, bits: int) -> bytes:
    """GIF's variable-width codes for values of so many bits; the table starts anew when it is full."""
    clear = 1 << bits
    out, held, n = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(clear)}, bits + 1

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += width
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    following, now = clear + 2, b""
    for i in range(len(values)):
        longer = now + values[i : i + 1]
        if longer in table:
            now = longer
            continue
        put(table[now])
        if following < 4096:
            table[longer] = following
            if following == 1 << width:
                width += 1
            following += 1
        else:
            put(clear)
            table, width, following = {bytes([k]): k for k in range(clear)}, bits + 1, clear + 2
        now = values[i : i + 1]
    if now:
        put(table[now])
        if following == 1 << width and width < 12:  # readers add an entry for the last code too, so the end code can be wider
            width += 1
    put(clear + 1)
    if n:
        out.append(held & 255)
    return bytes(out)


def unlzw(data: bytes, bits: int) -> bytes:
    clear = 1 << bits
    held, n, width, out = 0, 0, bits + 1, []
    table: list[bytes] = []
    before: bytes | None = None
    for byte in data:
        held |= byte << n
        n += 8
        while n >= width:
            code = held & (1 << width) - 1
            held >>= width
            n -= width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
                continue
            if code == clear + 1:
                return b"".join(out)
            if before is None:
                now = table[code]
            else:
                now = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + now[:1])
            out.append(now)
            before = now
            if len(table) == 1 << width and width < 12:
                width += 1
    raise ValueError("GIF data without an end")


def gif_head(w: int, h: int, colors: list[tuple[int, int, int]]) -> tuple[bytes, int]:
    """Header, screen and colour table, endless repetition; and how many bits an index takes."""
    bits = max(2, (len(colors) - 1).bit_length())
    table = b"".join(map(bytes, colors)) + b"\0\0\0" * ((1 << bits) - len(colors))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0 | bits - 1, 0, 0) + table + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0", bits


def gif_frame(index: np.ndarray, bits: int, hundredths: int) -> bytes:
    """One (h, w) image of indices, shown for so long."""
    h, w = index.shape
    data = lzw(index.astype(np.uint8).tobytes(), bits)
    parts = b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255)))
    return b"\x21\xf9\x04\x04" + struct.pack("<H", hundredths) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits]) + parts + b"\0"


def gif_images(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Index images and colour table of a GIF as written here: whole frames, one table."""
    if data[:6] != b"GIF89a":
        raise ValueError("not a GIF89a")
    n = 2 << (data[10] & 7)
    colors = np.frombuffer(data, np.uint8, 3 * n, 13).reshape(n, 3)
    pos, out = 13 + 3 * n, []

    def parts(pos: int) -> tuple[bytes, int]:
        body = []
        while data[pos]:
            body.append(data[pos + 1 : pos + 1 + data[pos]])
            pos += 1 + data[pos]
        return b"".join(body), pos + 1

    while data[pos] != 0x3B:
        if data[pos] == 0x21:
            pos = parts(pos + 2)[1]
            continue
        w, h = struct.unpack_from("<HH", data, pos + 5)
        body, end = parts(pos + 11)
        out.append(np.frombuffer(unlzw(body, data[pos + 10]), np.uint8).reshape(h, w))
        pos = end
    return out, colors


def write_gifs(frames: DataFrame, path: str, colors: list[tuple[int, int, int]], scale: int = 4, fps: float = 20.0) -> DataFrame:
    """A GIF a video, <video>.gif, each pixel scale x scale of it: (video, n_frames). frames: packed indices, as
    video, frame, width, height, colors.

    A file is one video's frames in order, streamed by one task that holds a frame.
    """
    store, local = opened(path)
    store.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, local = opened(path)
        video, out, n, bits = None, None, 0, 0
        for batch in batches:
            for own, _, w, h, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != video:
                    if out is not None:
                        out.write(b";")
                        out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([video]), pa.array([n], pa.int64())], ["video", "n_frames"])
                    video, n = own, 0
                    out = store.open_output_stream(f"{local}/{own}.gif")
                    head, bits = gif_head(w * scale, h * scale, colors)
                    out.write(head)
                index = np.frombuffer(data, np.uint8).reshape(h, w)
                out.write(gif_frame(index.repeat(scale, 0).repeat(scale, 1), bits, round(100 / fps)))
                n += 1
        if out is not None:
            out.write(b";")
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([video]), pa.array([n], pa.int64())], ["video", "n_frames"])

    ordered = frames.select("video", "frame", "width", "height", "colors").repartition("video").sortWithinPartitions("video", "frame")
    return ordered.mapInArrow(run, "video string, n_frames long")


def read_gifs(spark: SparkSession, path: str) -> DataFrame:
    """video, frame, idx, color of written GIFs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                video = name.rsplit("/", 1)[-1].removesuffix(".gif")
                for frame, image in enumerate(gif_images(data)[0]):
                    n = image.size
                    yield pa.RecordBatch.from_arrays([pa.array([video] * n), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(image.ravel().astype(np.int32))], ["video", "frame", "idx", "color"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gif").load(path).select("path", "content")
    return files.mapInArrow(run, "video string, frame int, idx int, color int")


def manifest(name: str, version: tuple[int, int, int]) -> str:
    return json.dumps({"format_version": 2, "header": {"name": name, "version": list(version)}, "modules": [{"type": "script", "entry": f"scripts/{name}.js", "version": list(version)}]}, separators=(",", ":"))


def write_packs(containers: DataFrame, path: str, version: tuple[int, int, int] = (1, 0, 0)) -> DataFrame:
    """A zip a video, <video>.zip, with its manifest and its script: (video, n_bytes). A container is a row, so is its zip."""
    store, local = opened(path)
    store.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, local = opened(path)
        for batch in batches:
            for video, container in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, body in (("manifest.json", manifest(video, version)), (f"scripts/{video}.js", f"export const {video} = {container};")):
                        z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
                with store.open_output_stream(f"{local}/{video}.zip") as f:
                    f.write(out.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([video]), pa.array([len(out.getvalue())], pa.int64())], ["video", "n_bytes"])

    return containers.select("video", "container").mapInArrow(run, "video string, n_bytes long")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """pack, name, body of the files in zips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([name]), pa.array([z.read(name)], pa.binary())], ["pack", "name", "body"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("pack"), "content").mapInArrow(run, "pack string, name string, body binary")
