"""Tables of a data folder, and the raster fixtures made of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.palette import palette_rows

WIDTH = HEIGHT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, idx, x, y, r, g, b: 64 events a frame; a partial last frame is dropped.

    The frame limit is a plain comparison with a one-row count, so it reaches the scan as a filter on event_id.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    size = WIDTH * HEIGHT
    whole = events.agg(F.floor(F.count("*") / size).alias("n")).first()["n"] * size
    e, u, hot = F.col("event_id"), F.col("user_id"), F.col("value") > 200
    still = (F.floor(e / size / 24) * 96) % 256
    return events.where(e < whole).select(
        F.lit("v0").alias("video"), F.floor(e / size).cast("int").alias("frame"), (e % size).cast("int").alias("idx"),
        (e % WIDTH).cast("int").alias("x"), F.floor(e % size / WIDTH).cast("int").alias("y"),
        F.when(hot, (u * 37) % 256).otherwise((e % WIDTH) * 32).cast("int").alias("r"),
        F.when(hot, (u * 91) % 256).otherwise(F.floor(e % size / WIDTH) * 32).cast("int").alias("g"),
        F.when(hot, (u * 53) % 256).otherwise(still).cast("int").alias("b"),
    )


def nearest_rgb(r: Column, g: Column, b: Column, name: str = "full") -> Column:
    """The palette index with the smallest squared distance, the lowest of equals.

    No join and no array: (distance - |pixel|^2) * 128 + index is linear in the channels, and its least is taken in generated
    code. Doubles hold it exactly and need no overflow checks, which keeps the code small enough to be compiled.
    """
    x, y, z = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (r, g, b))
    ranks = [F.lit(128.0 * (p * p + q * q + s * s) + c) - x * (256.0 * p) - y * (256.0 * q) - z * (256.0 * s) for c, _, _, p, q, s in palette_rows(name)]
    return F.pmod(F.least(*ranks), F.lit(128.0)).cast("int")


def nearest_center(r: Column, g: Column, b: Column, name: str = "full") -> Column:
    """The same for channels that aren't whole numbers: distances to six digits, as whole numbers with the index behind."""
    x, y, z = (c.cast("double") for c in (r, g, b))
    ranks = [F.floor(((x - p) * (x - p) + (y - q) * (y - q) + (z - s) * (z - s)) * 1e6 + 0.5) * 128 + c for c, _, _, p, q, s in palette_rows(name)]
    return (F.least(*ranks) % 128).cast("int")


def indexed(spark: SparkSession, sf_dir: str, name: str = "full") -> DataFrame:
    """video, frame, idx, x, y, color."""
    px = pixels(spark, sf_dir)
    return px.select("video", "frame", "idx", "x", "y", nearest_rgb(F.col("r"), F.col("g"), F.col("b"), name).alias("color"))
