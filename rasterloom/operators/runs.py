"""Runs of equal colour, their packets, and the chunks and index made of packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec as K


def runs(written: DataFrame, cap: int = K.MAX_RUN) -> DataFrame:
    """video, frame, y, x0, len, color, start: stretches of a row with one colour, cut at the cap. Adds kind if there.

    Gaps and islands: within (frame, row, colour) x minus its rank is constant along a run.
    """
    keys = ["video", "frame", "y", "color", *(["kind"] if "kind" in written.columns else [])]
    rank = F.row_number().over(Window.partitionBy("video", "frame", "y", "color").orderBy("x"))
    island = written.withColumn("island", F.col("x") - rank)
    spot = F.row_number().over(Window.partitionBy("video", "frame", "y", "color", "island").orderBy("x"))
    cut = island.withColumn("piece", F.floor((spot - 1) / cap))
    return cut.groupBy(*keys, "island", "piece").agg(F.min("x").alias("x0"), F.min("idx").alias("start"), F.count("*").cast("int").alias("len")).drop("island", "piece")


def runs_of_list(written: DataFrame, cap: int = K.MAX_RUN) -> DataFrame:
    """The same columns from the list of changed pixels alone: a run goes on while the index grows by one, the row and the
    colour stay, and it is shorter than the cap."""
    w = Window.partitionBy("video", "frame").orderBy("idx")
    same = (F.col("idx") == F.lag("idx").over(w) + 1) & (F.col("y") == F.lag("y").over(w)) & (F.col("color") == F.lag("color").over(w))
    stretch = written.withColumn("begins", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("stretch", F.sum("begins").over(w))
    place = F.row_number().over(Window.partitionBy("video", "frame", "stretch").orderBy("idx")) - 1
    cut = stretch.withColumn("piece", F.floor(place / cap))
    return cut.groupBy("video", "frame", "y", "color", "stretch", "piece").agg(F.min("x").alias("x0"), F.min("idx").alias("start"), F.count("*").cast("int").alias("len")).drop("stretch", "piece")


def packed(found: DataFrame) -> DataFrame:
    """Adds value, the run as a number, and hexed, the number as bytes."""
    out = found.withColumn("value", K.pack(F.col("start"), F.col("len"), F.col("color")))
    return out.withColumn("hexed", K.varint_hex(F.col("value")))


def packets(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """video, frame, is_keyframe, n_runs, packet (hex digits): header, count, runs in pixel order. Skipped frames are empty."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "hexed"))), lambda s: s["hexed"]), "")
    bodies = packed(found).groupBy("video", "frame").agg(ordered.alias("body"), F.count("*").alias("n_runs"))
    all_frames = kinds.join(bodies, ["video", "frame"], "left").withColumn("is_keyframe", F.col("kind") == "K")
    n = F.coalesce("n_runs", F.lit(0).cast("long"))
    whole = F.concat(K.varint_hex(K.header(F.col("frame"), F.col("is_keyframe"))), K.varint_hex(n), F.coalesce("body", F.lit("")))
    return all_frames.select("video", "frame", "is_keyframe", n.alias("n_runs"), F.when(F.col("kind") == "S", "").otherwise(whole).alias("packet"))


def frame_index(with_gops: DataFrame) -> DataFrame:
    """video, gop_id, frame, offset, length, is_keyframe: byte places of packets in their chunk."""
    before = Window.partitionBy("video", "gop_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    sized = with_gops.withColumn("length", (F.length("packet") / 2).cast("long"))
    return sized.select("video", "gop_id", "frame", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "is_keyframe")


def index_hex(index: DataFrame) -> DataFrame:
    """One row a video: the index as bytes, three numbers a frame - gop, offset and keyframe bit, length."""
    entry = F.concat(K.varint_hex(F.col("gop_id")), K.varint_hex(F.shiftleft("offset", 1).bitwiseOR(F.col("is_keyframe").cast("long"))), K.varint_hex(F.col("length")))
    listed = F.array_sort(F.collect_list(F.struct("frame", entry.alias("e"))))
    return index.groupBy("video").agg(F.array_join(F.transform(listed, lambda s: s["e"]), "").alias("index"))


def chunks(with_gops: DataFrame) -> DataFrame:
    """video, gop_id, chunk (hex digits): packets of a group in frame order."""
    listed = F.array_sort(F.collect_list(F.struct("frame", "packet")))
    return with_gops.groupBy("video", "gop_id").agg(F.array_join(F.transform(listed, lambda s: s["packet"]), "").alias("chunk"))


def run_deltas(found: DataFrame) -> DataFrame:
    """Adds delta: a run's start minus the start before it in the frame, the first one's from 0."""
    return found.withColumn("delta", F.col("start") - F.lag("start", 1, 0).over(Window.partitionBy("video", "frame").orderBy("start")))


def spread(found: DataFrame) -> DataFrame:
    """Runs back to pixels."""
    return found.withColumn("idx", F.explode(F.expr("sequence(start, start + len - 1)")))
