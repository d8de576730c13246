"""Container documents: JSON with packets as 15-bit text, written and read.

v4 has a chunk a group of frames and three index numbers a frame, v3 one binary and two numbers, older ones a text a frame.
Those of the second encoder have neither header nor count in it, and starts that count from the run before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec as K
from ..operators import frames
from . import ingest

FORMAT, FORMAT_V3 = "varint_rle_v4", "varint_rle_v3"
SCHEMA = (
    "width int, height int, frame_count int, format string, gop_boundaries array<int>, adaptive_palette boolean, "
    "level_blocks array<struct<name:string,block:string,rgb:array<int>>>, index string, chunks array<string>, binary string, frames array<string>, keyframe_interval int"
)


def assemble(chunks: DataFrame, index: DataFrame, gops: DataFrame, palette: DataFrame, width: int, height: int) -> DataFrame:
    """(video, container): one document a video."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("gop_id", K.units_text(K.text_units(F.col("chunk"))).alias("t")))), lambda s: s["t"])
    texts = chunks.groupBy("video").agg(ordered.alias("chunks"))
    starts = F.array_sort(F.collect_list("start_frame"))
    cuts = gops.groupBy("video").agg(F.concat(starts, F.array(F.max("end_frame"))).alias("gop_boundaries"), F.max("end_frame").alias("frame_count"))
    own = texts.join(index, "video").join(cuts, "video").crossJoin(F.broadcast(levels_of(palette)))  # levels is one row
    fields = F.struct(
        F.lit(width).alias("width"), F.lit(height).alias("height"), "frame_count", F.lit(FORMAT).alias("format"), "gop_boundaries", F.lit(False).alias("adaptive_palette"),
        "level_blocks", K.units_text(K.text_units(F.col("index"))).alias("index"), "chunks",
    )
    return own.select("video", F.to_json(fields).alias("container"))


def write(containers: DataFrame, path: str) -> None:
    """One line of JavaScript a video: export const <video> = <document>;"""
    containers.select(F.concat(F.lit("export const "), "video", F.lit(" = "), "container", F.lit(";")).alias("value")).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(video, container) of written documents."""
    files = spark.read.text(path, wholetext=True)  # documents may span lines
    one = r"(?s)export\s+const\s+(\w+)\s*=\s*(\{.*?\})\s*;?\s*(?=export\s+const\s|\z)"  # packed text holds U+2028, which a plain . ends at
    each = files.select(F.explode(F.regexp_extract_all("value", F.lit(one), 0)).alias("value"))
    return each.select(F.regexp_extract("value", one, 1).alias("video"), F.regexp_extract("value", one, 2).alias("container"))


def parsed(containers: DataFrame, form: str | None = FORMAT) -> DataFrame:
    """video and the document's fields, one struct column c, of documents of a format; None: of those with a text a frame."""
    found = containers.select("video", F.from_json("container", SCHEMA).alias("c"))
    return found.where(F.col("c.format") == form) if form else found.where("c.format is null and c.frames is not null")


def parsed_adaptive(containers: DataFrame) -> DataFrame:
    """As parsed(), of v4 documents whatever form their palettes have; those aren't read."""
    levels = "level_blocks array<struct<name:string,block:string,rgb:array<int>>>, "
    return containers.select("video", F.from_json("container", SCHEMA.replace(levels, "")).alias("c")).where(F.col("c.format") == FORMAT)


def levels_of(palette: DataFrame) -> DataFrame:
    """One row: level_blocks."""
    entries = F.array_sort(F.collect_list(F.struct("color", "name", "block", F.array("r", "g", "b").alias("rgb"))))
    return palette.groupBy().agg(F.transform(entries, lambda s: F.struct(s["name"].alias("name"), s["block"].alias("block"), s["rgb"].alias("rgb"))).alias("level_blocks"))


def text_of(hexed: Column) -> Column:
    return K.units_text(K.text_units(hexed))


def assemble_v3(packets: DataFrame, palette: DataFrame, width: int, height: int) -> DataFrame:
    """(video, container) of packets (video, frame, is_keyframe, packet): all in one binary, offset and length of each."""
    size = (F.length("packet") / 2).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("frame", "packet", size.alias("n"), "is_keyframe")))
    videos = packets.groupBy("video").agg(listed.alias("f"))
    # offsets by one pass over the frames in order, which holds the index as it grows
    offset = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("n", size).withColumn("offset", F.coalesce(F.sum("n").over(offset), F.lit(0).cast("long")))
    entry = F.concat(K.varint_hex(F.shiftleft("offset", 1).bitwiseOR(F.col("is_keyframe").cast("long"))), K.varint_hex(F.col("n")))
    index = placed.groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", entry.alias("e")))), lambda s: s["e"]), "").alias("index"))
    own = videos.join(index, "video").crossJoin(F.broadcast(levels_of(palette)))  # levels is one row
    fields = F.struct(
        F.lit(width).alias("width"), F.lit(height).alias("height"), F.size("f").alias("frame_count"), F.lit(FORMAT_V3).alias("format"), "level_blocks",
        text_of(F.col("index")).alias("index"), text_of(F.array_join(F.transform("f", lambda s: s["packet"]), "")).alias("binary"),
    )
    return own.select("video", F.to_json(fields).alias("container"))


def assemble_frames(texts: DataFrame, palette: DataFrame, width: int, height: int, interval: int = 30) -> DataFrame:
    """(video, container) of texts (video, frame, text): a text a frame, empty where nothing was sent."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame", "text"))), lambda s: s["text"])
    own = texts.groupBy("video").agg(listed.alias("frames")).crossJoin(F.broadcast(levels_of(palette)))  # levels is one row
    fields = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(interval).alias("keyframe_interval"), "level_blocks", F.size("frames").alias("frame_count"), "frames")
    return own.select("video", F.to_json(fields).alias("container"))


def frame_texts(packets: DataFrame) -> DataFrame:
    """video, frame, text of packets: K: before a keyframe's."""
    text = F.concat(F.when(F.col("is_keyframe"), "K:").otherwise(""), text_of(F.col("packet")))
    return packets.select("video", "frame", F.when(F.length("packet") == 0, "").otherwise(text).alias("text"))


def relative_packets(deltas: DataFrame, kinds: DataFrame) -> DataFrame:
    """video, frame, is_keyframe, packet of the second encoder. deltas: runs with delta; kinds: video, frame, kind."""
    own = deltas.withColumn("hexed", K.varint_hex(K.pack(F.col("delta"), F.col("len"), F.col("color"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "hexed"))), lambda s: s["hexed"]), "")
    bodies = own.groupBy("video", "frame").agg(body.alias("packet"))
    return kinds.join(bodies, ["video", "frame"], "left").select("video", "frame", (F.col("kind") == "K").alias("is_keyframe"), F.coalesce("packet", F.lit("")).alias("packet"))


def index_of(documents: DataFrame) -> DataFrame:
    """video, frame, gop_id, offset, length, is_keyframe from the index text: three numbers a frame."""
    numbers = documents.select("video", K.let(K.text_hex(F.col("c.index")), K.varints).alias("v"))
    # the entries are made in the index's row and then spread, so that no frame carries the index
    at = F.sequence(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1)
    entry = F.transform(F.when(F.size("v") >= 3, at).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        i.alias("frame"), F.element_at("v", i * 3 + 1).alias("gop_id"), F.shiftright(F.element_at("v", i * 3 + 2), 1).alias("offset"),
        F.element_at("v", i * 3 + 3).alias("length"), (F.element_at("v", i * 3 + 2).bitwiseAND(F.lit(1).cast("long")) == 1).alias("is_keyframe"),
    ))
    return numbers.select("video", F.inline(entry))


def writes(documents: DataFrame) -> DataFrame:
    """video, frame, idx, color: the pixels that each frame's packet writes. Empty packets write nothing."""
    chunks = documents.select("video", F.posexplode("c.chunks").alias("gop_id", "text")).select("video", F.col("gop_id").cast("long").alias("gop_id"), K.text_hex(F.col("text")).alias("chunk"))
    # a chunk is cut into its packets where it is: a group of frames is a row, no packet carries the chunk
    places = index_of(documents).where("length > 0").groupBy("video", "gop_id").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    return packet_writes(places.join(chunks, ["video", "gop_id"]).select("video", F.explode(F.transform("places", lambda p: _cut(F.col("chunk"), p))).alias("packet")))


def _cut(chunk: Column, place: Column) -> Column:
    return F.substring(chunk, (place["offset"] * 2 + 1).cast("int"), (place["length"] * 2).cast("int"))


def packet_writes(packets: DataFrame) -> DataFrame:
    """video, frame, idx, color of packets (hex digits): header, count, runs."""
    numbers = packets.select("video", K.varints(F.col("packet")).alias("v")).select("video", F.shiftright(F.element_at("v", 1), 1).alias("frame"), F.explode(F.slice("v", 3, 1 << 30)).alias("value"))
    index, length, color = K.unpack(F.col("value"))
    return numbers.select("video", "frame", F.explode(F.sequence(index, index + length - 1)).alias("idx"), color.alias("color"))


def index_v3(documents: DataFrame) -> DataFrame:
    """video, frame, gop_id (-1: there are no groups), offset, length, is_keyframe from two numbers a frame."""
    numbers = documents.select("video", K.let(K.text_hex(F.col("c.index")), K.varints).alias("v"))
    at = F.when(F.size("v") >= 2, F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    entry = F.transform(at, lambda i: F.struct(
        i.alias("frame"), F.lit(-1).cast("long").alias("gop_id"), F.shiftright(F.element_at("v", i * 2 + 1), 1).alias("offset"),
        F.element_at("v", i * 2 + 2).alias("length"), (F.element_at("v", i * 2 + 1).bitwiseAND(F.lit(1).cast("long")) == 1).alias("is_keyframe"),
    ))
    return numbers.select("video", F.inline(entry))


def writes_v3(documents: DataFrame) -> DataFrame:
    """As writes(), of v3 documents: the binary is cut into packets in its own row."""
    places = index_v3(documents).where("length > 0").groupBy("video").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    whole = documents.select("video", K.text_hex(F.col("c.binary")).alias("chunk"))
    return packet_writes(places.join(whole, "video").select("video", F.explode(F.transform("places", lambda p: _cut(F.col("chunk"), p))).alias("packet")))


def _frame_packets(documents: DataFrame) -> DataFrame:
    """video, frame, packet of texts that a player takes: not empty, and from U+1000 up behind a K: if there is one."""
    texts = documents.select("video", F.posexplode("c.frames").alias("frame", "text"))
    first = F.ascii(F.when(F.substring("text", 1, 2) == "K:", F.substring("text", 3, 1)).otherwise(F.substring("text", 1, 1)))
    return texts.where(F.coalesce(first >= 0x1000, F.lit(False))).select("video", "frame", K.text_hex(F.col("text")).alias("packet"))


def writes_frames(documents: DataFrame) -> DataFrame:
    """As writes(), of documents with a text a frame; a frame is its place in the list, whatever its header says."""
    numbers = _frame_packets(documents).select("video", "frame", F.explode(F.slice(K.varints(F.col("packet")), 3, 1 << 30)).alias("value"))
    index, length, color = K.unpack(F.col("value"))
    return numbers.select("video", "frame", F.explode(F.sequence(index, index + length - 1)).alias("idx"), color.alias("color"))


def writes_relative(documents: DataFrame) -> DataFrame:
    """As writes(), of the second encoder's documents: a run starts where the starts before it add up to."""
    numbers = _frame_packets(documents).select("video", "frame", F.posexplode(K.varints(F.col("packet"))).alias("n", "value"))
    delta, length, color = K.unpack(F.col("value"))
    own = numbers.select("video", "frame", "n", delta.alias("delta"), length.alias("len"), color.alias("color"))
    start = F.sum("delta").over(Window.partitionBy("video", "frame").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("start", start).select("video", "frame", F.explode(F.expr("sequence(start, start + len - 1)")).alias("idx"), "color")


def raw_frames(spark: SparkSession, path: str, width: int, height: int, fps: float = 20.0, seconds: float | None = None) -> DataFrame:
    """video, frame, idx, x, y, r, g, b of files of raw RGB24 frames."""
    return frames.unpack(ingest.raw_frames(spark, path, width, height, fps, seconds))
