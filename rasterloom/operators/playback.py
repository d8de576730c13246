"""Ticks, work budgets, audio windows and caches of a player, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import WindowSpec

START_DELAY, AUDIO_TICKS, WRITES, YIELDS = 5, 200, 4000, 12  # ticks before the first frame, ticks an audio chunk, writes before a yield, yields a tick


def of_video() -> WindowSpec:
    return Window.partitionBy("video").orderBy("frame")


def tick_schedule(frames: DataFrame, interval: int = 2) -> DataFrame:
    """video, tick, frame: every tick of the run and the frame that it shows."""
    return frames.select("video", "frame", F.explode(F.sequence(F.col("frame") * interval, (F.col("frame") + 1) * interval - 1)).alias("t")).select("video", (F.col("t") + START_DELAY).alias("tick"), "frame")


def tick_budget(writes: DataFrame) -> DataFrame:
    """writes: video, frame, n. Adds yields, ticks that the frame takes, and the tick at which it is done."""
    own = writes.withColumn("yields", F.floor(F.col("n") / (WRITES + 1)))
    own = own.withColumn("ticks", F.ceil((F.col("yields") + 1) / YIELDS))
    return own.withColumn("done_at", F.sum("ticks").over(of_video().rowsBetween(Window.unboundedPreceding, 0)) + START_DELAY)


def audio_chunk(frame: Column, interval: int) -> Column:
    return F.floor(frame * interval / AUDIO_TICKS).cast("int")


def audio_switches(frames: DataFrame, interval: int = 2) -> DataFrame:
    """Frames at which another audio chunk begins."""
    own = frames.withColumn("chunk", audio_chunk(F.col("frame"), interval))
    return own.withColumn("before", F.lag("chunk").over(of_video())).where(F.col("before").isNull() | (F.col("before") != F.col("chunk"))).select("video", "frame", "chunk")


def prefetch(with_gops: DataFrame, ahead: int = 10) -> DataFrame:
    """Adds next_gop, the group of the frame `ahead` later where it is another one."""
    later = F.lead("gop_id", ahead).over(of_video())
    return with_gops.withColumn("next_gop", F.when(later != F.col("gop_id"), later))


def _walked(size: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, held, begun = None, [], False
        for batch in batches:
            hits: list[bool | None] = []
            for own, gop in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or own != video:
                    video, held, begun = own, [], True
                hit = gop is not None and gop in held
                hits.append(True if hit else None if gop is None or None in held else False)
                if not hit:
                    held = [gop, *held][:size]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], ["video", "at", "gop_id", "hit"])

    return walk


def cache_hits(requests: DataFrame, size: int = 4) -> DataFrame:
    """requests: video, at, gop_id. Adds hit under a first-in-first-out cache: a hit does not renew its entry.

    One pass over a video's requests in order, which holds the cache and a batch of rows.
    """
    own = requests.select("video", F.col("at").cast("bigint").alias("at"), F.col("gop_id").cast("bigint").alias("gop_id"))
    ordered = own.repartition("video").sortWithinPartitions("video", "at", "gop_id")
    return ordered.mapInArrow(_walked(size), StructType([*own.schema, StructField("hit", BooleanType())]))


def neighbour_videos(catalog: DataFrame) -> DataFrame:
    """Adds next_id and previous_id in the order of position, around the end. position counts the videos from 0."""
    n = catalog.agg(F.count("*").alias("n"))
    spots = catalog.select(F.col("position").alias("p"), F.col("video_id").alias("other"))
    own = catalog.crossJoin(F.broadcast(n))  # one row
    for step, name in ((1, "next_id"), (-1, "previous_id")):
        own = own.withColumn("p", F.pmod(F.col("position") + step, "n")).join(spots.withColumnRenamed("other", name), "p").drop("p")
    return own.drop("n")
