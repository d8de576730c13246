"""Headline queries of the raster engine, timed; one JSON line.

BENCH_SF_DIR: data folder. BENCH_CPUS: local cores. After one query to warm up, each is timed over a full run into a sink
that keeps nothing. frames_per_sec are conversions of generated 64 x 64 frames, to compare with frame rates.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import frames, kernels
from rasterloom.operators import pixels as P
from rasterloom.plans import catalog
from rasterloom.session import local_session

HEADLINES = (
    "quantize_rgb", "quantize_oklab", "dither_ordered", "dither_ordered_perceptual", "dither_floyd", "dither_atkinson", "rdo_encode", "frame_delta", "adaptive_skip", "scene_score",
    "gop_boundaries", "pack_run", "frame_index", "gop_chunk", "container_decode", "reconstruct_frames", "seek_state", "psnr", "ssim_global", "delta_e2000", "tile_dictionary", "motion_vectors",
    "motion_compensate", "events_tumbling", "events_session",
)
SIDE, FRAMES = 64, 1000
PALETTE = "full"


def run(make) -> float:
    """Seconds from the call that makes a DataFrame, which may write what it reads several times, to its last row."""
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def generated(spark, n: int):
    """Frames of smooth colour with noise, made on the fly."""
    idx, noise = F.col("id") % (SIDE * SIDE), F.pmod(F.xxhash64("id"), F.lit(32))
    x, y, frame = idx % SIDE, F.floor(idx / SIDE), F.floor(F.col("id") / (SIDE * SIDE))
    return spark.range(n * SIDE * SIDE).select(
        F.lit("v0").alias("video"), frame.cast("int").alias("frame"), idx.cast("int").alias("idx"), x.cast("int").alias("x"), y.cast("int").alias("y"),
        ((x * 4 + noise + frame) % 256).cast("int").alias("r"), ((y * 4 + noise) % 256).cast("int").alias("g"), ((x + y + noise * 3) % 256).cast("int").alias("b"),
    )


def generated_packed(spark, n: int, tasks: int):
    """The same frames packed, as a source of frames gives them: one row a frame, made where it is read."""
    place = np.arange(SIDE * SIDE)
    x, y = place % SIDE, place // SIDE

    def run(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            noise = (place * 2654435761 + numbers[:, None] * 40503) % 32
            images = np.stack([(x * 4 + noise + numbers[:, None]) % 256, (y * 4 + noise) % 256, (x + y + noise * 3) % 256], axis=2).astype(np.uint8)
            yield frames.packed_of(["v0"] * len(numbers), numbers, images.reshape(-1, SIDE, SIDE, 3))

    return spark.range(0, n, 1, tasks).mapInArrow(run, frames.PACKED)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    run(lambda: queries[HEADLINES[0]](spark, sf_dir))
    for name in HEADLINES:
        seconds[name] = round(run(lambda name=name: queries[name](spark, sf_dir)), 3)
    rates, cpus = {}, int(os.environ.get("BENCH_CPUS", "8"))
    for label, palette, n, make in (
        ("concrete_none", "concrete", FRAMES, P.quantize_rgb), ("full_none", "full", FRAMES, P.quantize_rgb), ("all_none", "all", FRAMES, P.quantize_rgb),
        ("full_bayer", "full", FRAMES, lambda px, p: P.quantize_rgb(P.dither_ordered(px), p)), ("full_oklab", "full", FRAMES // 4, P.quantize_oklab),
    ):
        rates[label] = round(n / run(lambda n=n, make=make, palette=palette: make(generated(spark, n), palette)), 1)
    for method in ("floyd", "atkinson"):
        seconds_of = {n: run(lambda n=n, method=method: kernels.error_diffusion_packed(generated_packed(spark, n, cpus), method, PALETTE)) for n in (64, 4 * FRAMES)}  # the first starts the workers
        rates[f"full_{method}"] = round(4 * FRAMES / seconds_of[4 * FRAMES], 1)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "frames_per_sec": rates}))


if __name__ == "__main__":
    main()
