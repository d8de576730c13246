"""Wire format, kernels, containers and streams against plain Python and NumPy."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import codec as K
from rasterloom.functions import color as C
from rasterloom.functions.palette import PALETTES
from rasterloom.operators import frames, kernels, metrics, runs
from rasterloom.operators import playback as Y
from rasterloom.operators import temporal as T
from rasterloom.plans import temporal_queries, wire_queries
from rasterloom.sources import containers
from rasterloom.streaming import player


def leb(v: int) -> str:
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return (out + bytes([v])).hex().upper()


def fifteen(data: bytes) -> list[int]:
    if not data:
        return []
    bits = "".join(f"{b:08b}" for b in data)
    pad = -len(bits) % 15
    bits += "0" * pad
    return [4096 + pad] + [4096 + int(bits[i : i + 15], 2) for i in range(0, len(bits), 15)]


def test_varints_at_their_edges(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**31 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("h", K.varint_hex(F.col("v"))).withColumn("n", K.varint_bytes(F.col("v")))
    for row in df.withColumn("back", K.varints(F.col("h"))).collect():
        assert row["h"] == leb(row["v"]) and row["n"] * 2 == len(row["h"]) and row["back"] == [row["v"]]


def test_a_million_varints_in_one_row(spark):
    """In seconds: a fold that appends to an array would take hours."""
    rng = np.random.default_rng(2)
    values = (rng.integers(0, 2**35, 1_000_000) >> rng.integers(0, 35, 1_000_000)).tolist()
    text = "".join(map(leb, values))
    start = time.perf_counter()
    got = spark.createDataFrame([(text,)], "h string").select(K.varints(F.col("h")).alias("v")).first()["v"]
    assert time.perf_counter() - start < 60 and got == values


def test_cut_off_varints(spark):
    """Numbers are read from whole bytes; a last one that is cut off is left out."""
    rows = [("8181", []), ("0181", [1]), ("", []), ("FFFFFFFF0F01", [2**32 - 1, 1]), ("FF" * 7 + "7F05", [2**56 - 1, 5])]
    df = spark.createDataFrame([(h,) for h, _ in rows], "h string").select("h", K.varints(F.col("h")).alias("v"))
    assert {r["h"]: r["v"] for r in df.collect()} == dict(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=40))
def test_text_round_trip(spark, data):
    data = [*data, *(bytes(range(n)) for n in range(17)), b""]
    df = spark.createDataFrame([(i, d.hex().upper()) for i, d in enumerate(data)], "i int, h string")
    df = df.withColumn("u", K.text_units(F.col("h"))).withColumn("t", K.units_text(F.col("u"))).withColumn("back", K.text_hex(F.col("t")))
    for row in df.withColumn("key", K.text_hex(F.concat(F.lit("K:"), "t"))).collect():
        assert row["u"] == fifteen(data[row["i"]]) and row["back"] == row["key"] == row["h"]


def test_runs_stop_at_the_cap(spark):
    colors = [5] * 100 + [9] * 28 + [3] * 128
    ix = spark.createDataFrame([("v", 0, i, i % 128, i // 128, c) for i, c in enumerate(colors)], "video string, frame int, idx int, x int, y int, color int")
    found = runs.runs(ix)
    assert sorted((r["start"], r["len"], r["color"]) for r in found.collect()) == [(0, 64, 5), (64, 36, 5), (100, 28, 9), (128, 64, 3), (192, 64, 3)]
    value = runs.packed(found).select("value")
    index, length, color = K.unpack(F.col("value"))
    back = value.select(F.explode(F.sequence(index, index + length - 1)).alias("idx"), color.alias("c")).orderBy("idx").collect()
    assert [r["c"] for r in back] == colors


def test_skip_is_a_fold(spark):
    """Each frame differs from its neighbour by too little, but adds up."""
    frames = [[1] * k + [0] * (100 - k) for k in range(6)]
    ix = spark.createDataFrame([("v", f, i, i % 10, i // 10, c) for f, px in enumerate(frames) for i, c in enumerate(px)], "video string, frame int, idx int, x int, y int, color int")
    kinds = {r["frame"]: r["kind"] for r in T.emitted(ix, 30, 0.015).collect()}
    assert "".join(kinds[f] for f in range(6)) == "KSPSPS"
    assert {r["kind"] for r in T.emitted(ix, 0, 0.0).collect()} == {"K", "P"}


def raster(image: np.ndarray, colors: np.ndarray, method: str) -> np.ndarray:
    h, w, _ = image.shape
    work, out = image.astype(np.float32), np.zeros((h, w), np.int32)
    for y in range(h):
        for x in range(w):
            k = int(((colors - work[y, x]) ** 2).sum(axis=1).argmin())
            out[y, x], error = k, work[y, x] - colors[k]
            for dx, dy, share in kernels.WEIGHTS[method]:
                if 0 <= x + dx < w and y + dy < h:
                    work[y + dy, x + dx] += error * np.float32(share)
    return out


@pytest.mark.parametrize("method", sorted(kernels.WEIGHTS))
def test_diffusion_in_lines_is_raster_order(method):
    image = np.random.default_rng(3).integers(0, 256, (11, 13, 3))
    colors = np.array([row[3:] for row in PALETTES["concrete"]], np.float32)
    assert (kernels.diffused(image, colors, method) == raster(image, colors, method)).all()


@pytest.mark.parametrize("method", sorted(kernels.WEIGHTS))
def test_many_frames_are_diffused_like_one(method):
    images = np.random.default_rng(4).integers(0, 256, (30, 9, 14, 3), dtype=np.uint8)
    colors = np.array([row[3:] for row in PALETTES["full"]], np.float32)
    got = kernels.diffused(images, colors, method)
    assert all((a == raster(image, colors, method)).all() for a, image in zip(got, images, strict=True))


def test_frames_of_rows_and_of_packed_rows(spark, monkeypatch):
    """Frames of two sizes, blocks that end within a batch, and back; diffusion of both forms is the same."""
    rng = np.random.default_rng(6)
    clips = {"a": rng.integers(0, 256, (40, 6, 5, 3), dtype=np.uint8), "b": rng.integers(0, 256, (3, 4, 9, 3), dtype=np.uint8)}
    rows = [(v, f, images.shape[2], images.shape[1], images[f].tobytes()) for v, images in clips.items() for f in range(len(images))]
    packed = spark.createDataFrame(rows, frames.PACKED).repartition(3)
    px = frames.unpack(packed)
    again = {(r["video"], r["frame"]): (r["width"], r["height"], bytes(r["rgb"])) for r in frames.pack(px.repartition(5)).collect()}
    assert again == {r[:2]: r[2:] for r in rows}
    one = {(r["video"], r["frame"], r["idx"]): r["color"] for r in kernels.error_diffusion(px, "floyd").collect()}
    for r in kernels.error_diffusion_packed(packed, "floyd").collect():
        assert [one[r["video"], r["frame"], i] for i in range(r["width"] * r["height"])] == list(bytes(r["colors"]))
    monkeypatch.setattr(frames, "BLOCK", 64)
    listed = sorted(tuple(r) for r in px.select("video", "frame", "idx", "y", "r", "g", "b").collect())
    table = pa.table({n: [r[i] for r in listed] for i, n in enumerate(("video", "frame", "idx", "y", "r", "g", "b"))})
    got = [(v, int(f), image) for videos, numbers, images in frames.images_of_rows(iter(table.to_batches(max_chunksize=17))) for v, f, image in zip(videos, numbers, images, strict=True)]
    assert [(v, f) for v, f, _ in got] == [r[:2] for r in rows] and all((image == clips[v][f]).all() for v, f, image in got)


def slow_rate_control(images: np.ndarray, colors: list[tuple], classes: set) -> list[list[int]]:
    """Rate control pixel by pixel, in plain Python."""
    h, w = images.shape[1:3]
    spots = [(y, x) for y in range(h) for x in range(w)]
    labs = [C.oklab_of(c) for c in colors]

    def mean9(values: dict) -> dict:
        return {(y, x): sum(values.get((y + dy, x + dx), 0.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9.0 for y, x in spots}

    def lab_of(rgb) -> tuple:
        light = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in rgb]
        cones = [sum(k * v for k, v in zip(row, light, strict=True)) for row in C.TO_CONES]
        return tuple(sum(k * v for k, v in zip(row, [np.sign(c) * abs(c) ** (1 / 3) for c in cones], strict=True)) for row in C.TO_LAB)

    def apart(a, b) -> float:
        return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))

    out, debt, wish, screen, before = [], {p: (0.0,) * 3 for p in spots}, {p: 0.0 for p in spots}, None, None
    for image in images:
        here = {p: tuple(map(float, image[p])) for p in spots}
        target = {p: tuple(a + b for a, b in zip(here[p], debt[p], strict=True)) for p in spots}
        lab = {p: lab_of(target[p]) for p in spots}
        best = {p: min(range(len(labs)), key=lambda k, p=p: (apart(lab[p], labs[k]), k)) for p in spots}
        weight = 0.5
        if screen is not None:
            moved = mean9({p: sum(abs(a - b) for a, b in zip(here[p], before[p], strict=True)) / 3 for p in spots})
            ratio = sum(m > 5.0 for m in moved.values()) / len(spots)
            rdo, me, share, weight = next(row[1:] for row in kernels.SCENES if ratio < row[0])
            classes.add(weight)
            gray = {p: sum(here[p]) / 3 for p in spots}
            mean, square = mean9(gray), mean9({p: g * g for p, g in gray.items()})
            off = {p: apart(lab[p], labs[screen[p]]) ** 0.5 for p in spots}
            scale = {p: 1 + 2 * (1 - min(1.0, max(square[p] - mean[p] ** 2, 0.0) / 500)) for p in spots}
            restless = [p for p in spots if not (moved[p] < me or off[p] < rdo / 255 * scale[p])]
            for p in restless:
                wish[p] += off[p]
            budget = int(len(spots) * share)
            if len(restless) > budget:
                restless = sorted(spots, key=lambda p: (-wish[p], p))[:budget]
            best = {p: best[p] if p in set(restless) else screen[p] for p in spots}
            wish = {p: wish[p] if best[p] == screen[p] else 0.0 for p in spots}
        debt = {p: tuple(min(32.0, max(-32.0, (t - c) * weight)) for t, c in zip(target[p], colors[best[p]], strict=True)) for p in spots}
        screen, before = best, here
        out.append([best[p] for p in spots])
    return out


def test_rate_control_frame_by_frame(spark):
    """Scenes of all five classes, two videos in one task, against plain loops."""
    rng = np.random.default_rng(9)
    clips, classes = [], set()
    for _ in range(2):
        now, images = rng.integers(0, 256, (20, 24, 3)), []
        for share in (0, 0.002, 0.004, 0.01, 0.05, 1.0, 0.003, 0.002):
            now = now.copy()
            change = rng.random((20, 24)) < share
            now[change] = rng.integers(0, 256, (int(change.sum()), 3))
            images.append(np.clip(now + rng.integers(-2, 3, now.shape), 0, 255))
        clips.append(np.stack(images).astype(np.uint8))
    colors = [row[3:] for row in PALETTES["full"]]
    rows = [(f"v{v}", f, 24, 20, images[f].tobytes()) for v, images in enumerate(clips) for f in range(len(images))]
    px = frames.unpack(spark.createDataFrame(rows, frames.PACKED))
    got = kernels.rate_controlled(px).toPandas().sort_values(["video", "frame", "idx"])
    for v, images in enumerate(clips):
        own = got[got.video == f"v{v}"]["color"].to_numpy().reshape(len(images), -1)
        assert own.tolist() == slow_rate_control(images, colors, classes)
    assert classes == {row[4] for row in kernels.SCENES}


def test_delta_e_of_published_pairs(spark):
    """Pairs from the CIEDE2000 reference data of Sharma, Wu and Dalal."""
    pairs = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082)]
    df = spark.createDataFrame([((*p[:3],), (*p[3:6],), p[6]) for p in pairs], "p struct<L:double,a:double,b:double>, q struct<L:double,a:double,b:double>, want double")
    for row in C.with_delta_e2000(df, "p", "q").collect():
        assert row["delta_e"] == pytest.approx(row["want"], abs=1e-4)


def test_identical_frames(spark, tiny):
    from rasterloom.sources.tables import pixels

    px = pixels(spark, tiny).where("frame < 3")
    same = metrics.paired(px, px)
    assert {r["psnr"] for r in metrics.psnr(same).collect()} == {100.0}
    assert {round(r["delta_e"], 9) for r in metrics.delta_e(same).collect()} == {0.0}
    assert all(r["ssim"] > 1 for r in metrics.ssim(same).collect())  # the sample covariance exceeds the variance
    assert all(r["ssim"] == pytest.approx(1.0) for r in metrics.ssim_windows(same, 8).collect())


def test_container_file_round_trip(spark, tiny, tmp_path):
    made = wire_queries.container_of(spark, tiny)
    containers.write(made, str(tmp_path / "c"))
    back = containers.writes(containers.parsed(containers.read(spark, str(tmp_path / "c"))))
    want = temporal_queries.written(spark, tiny).select("video", "frame", "idx", "color")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_raw_frames(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 4, 6, 3), dtype=np.uint8)
    (tmp_path / "clip.rgb").write_bytes(rgb.tobytes() + b"cut off")
    got = containers.raw_frames(spark, str(tmp_path), 6, 4).orderBy("frame", "idx").collect()
    assert [(r["r"], r["g"], r["b"]) for r in got] == [tuple(map(int, p)) for p in rgb.reshape(-1, 3)]
    assert containers.raw_frames(spark, str(tmp_path), 6, 4, fps=10, seconds=0.2).count() == 2 * 24


def test_rate_control_keeps_to_its_budget(spark, tiny):
    from rasterloom.sources.tables import pixels

    out = kernels.rate_controlled(pixels(spark, tiny)).toPandas().sort_values(["frame", "idx"])["color"].to_numpy().reshape(-1, 64)
    assert ((out[1:] != out[:-1]).sum(axis=1) <= 64).all() and out.max() < len(PALETTES["full"])


def test_windows_over_a_stream(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{tiny}/events.parque[t]")
    run = player.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    batch = player.windowed(spark.read.parquet(f"{tiny}/events.parquet"))
    assert got == {(r["window"]["start"], r["event_type"]): r["n"] for r in batch.collect()}


def test_screen_state_over_a_stream(spark, tiny, tmp_path):
    """Writes that arrive in two batches change as many cells as a plain dictionary says."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writes = temporal_queries.written(spark, tiny).select("video", "frame", "idx", "color")
    schema = writes.schema
    writes.where("frame < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = player.played(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("screens").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    writes.where("frame >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    run.stop()
    screen, want = {}, []
    rows = sorted(map(tuple, writes.collect()))
    for frame in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == frame]
        changed = sum(screen.get(i) != c for _, _, i, c in own)
        screen |= {i: c for _, _, i, c in own}
        want.append((frame, len(own), changed))
    assert sorted((r["frame"], r["n_written"], r["n_changed"]) for r in spark.table("screens").collect()) == want


def test_cache_of_all_events_in_one_pass(spark):
    """Every event of the largest scale, in one video and in seven, against a loop; no array holds a video's requests."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select(F.lit("v0").alias("video"), F.col("event_id").alias("at"), (F.col("user_id") % 7).alias("gop_id"))
    both = events.unionByName(events.withColumn("video", F.concat(F.lit("w"), (F.col("at") % 7).cast("string"))))
    df = Y.cache_hits(both, 4)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    want, held = [], {}
    for video, at, gop in sorted(map(tuple, both.collect())):
        cache = held.setdefault(video, [])
        want.append((video, at, gop, gop in cache))
        if gop not in cache:
            held[video] = [gop, *cache][:4]
    assert len(want) == 200_000 and sorted(map(tuple, df.select("video", "at", "gop_id", "hit").collect())) == want
