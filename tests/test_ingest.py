"""Frames from files, scaling and rates, older containers, and palettes by group, against plain Python."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import codec as K
from rasterloom.functions.palette import PALETTES
from rasterloom.operators import adaptive as A
from rasterloom.operators import frames
from rasterloom.plans import ingest_queries, wire_queries
from rasterloom.sources import containers, exports, ingest
from rasterloom.sources.tables import pixels


def packed_rows(clips: dict[str, np.ndarray]) -> list[tuple]:
    return [(v, f, x.shape[2], x.shape[1], x[f].tobytes()) for v, x in clips.items() for f in range(len(x))]


def png_of(image: np.ndarray, kind: int, how: int, palette: bytes = b"") -> bytes:
    """A PNG of (h, w, n) channels with one filter for all lines."""
    h, w, n = image.shape
    above, out = np.zeros((w, n), int), []
    for y in range(h):
        now = image[y].astype(int)
        left = np.vstack([np.zeros((1, n), int), now[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [np.zeros_like(now), left, above, (left + above) // 2, near][how]
        out.append(bytes([how]) + ((now - guess) % 256).astype(np.uint8).tobytes())
        above = now

    def chunk(name: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")

    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    data = zlib.compress(b"".join(out))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_pngs_of_all_kinds(how):
    rng = np.random.default_rng(how)
    for kind, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        image = rng.integers(0, 256, (7, 5, n))
        want = image[..., :3] if n >= 3 else np.repeat(image[..., :1], 3, axis=2)
        assert (ingest.png_pixels(png_of(image, kind, how)) == want).all()
    inks = rng.integers(0, 256, (9, 3)).astype(np.uint8)
    index = rng.integers(0, 9, (7, 5, 1))
    assert (ingest.png_pixels(png_of(index, 3, how, inks.tobytes())) == inks[index[..., 0]]).all()


def test_a_folder_of_pngs_in_the_order_of_names(spark, tmp_path):
    images = np.random.default_rng(1).integers(0, 256, (25, 4, 6, 3), dtype=np.uint8)
    for i, image in enumerate(images):
        (tmp_path / f"f{i:03d}.png").write_bytes(ingest.png_bytes(image))
    (tmp_path / "notes.txt").write_text("x")
    got = {r["frame"]: bytes(r["rgb"]) for r in ingest.png_frames(spark, str(tmp_path), "v").collect()}
    assert got == {i: image.tobytes() for i, image in enumerate(images)}


def test_numbers_are_the_same_however_often_they_are_read(spark):
    """So many names that the ranges come from a sample, which another run draws anew."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rows = spark.range(20_000).repartition(8, F.xxhash64("id")).select("id", F.format_string("file:/x/v0_%08d.png", "id").alias("path"))
        got = ingest.numbered(rows, "path", "frame")
        for _ in range(2):
            assert [(r["id"], r["frame"]) for r in got.orderBy("id").collect()] == [(i, i) for i in range(20_000)]
    finally:
        spark.conf.set(setting, before)


def test_raw_files_are_read_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "SLICE", 3 * 72)
    images = np.random.default_rng(2).integers(0, 256, (50, 4, 6, 3), dtype=np.uint8)
    (tmp_path / "clip.one.rgb").write_bytes(images.tobytes() + b"cut off")
    (tmp_path / "short.rgb").write_bytes(b"less than a frame")
    df = ingest.raw_frames(spark, str(tmp_path), 6, 4)
    assert {(r["video"], r["frame"]): bytes(r["rgb"]) for r in df.collect()} == {("clip.one", i): x.tobytes() for i, x in enumerate(images)}
    assert df.rdd.getNumPartitions() == 17
    assert ingest.raw_frames(spark, str(tmp_path), 6, 4, fps=10, seconds=0.7).count() == 7


def test_rates(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("frame"))
    for source, fps in ((30.0, 20.0), (20.0, 30.0), (20.0, 20.0), (24.0, 1.0)):
        want = [max(i for i in range(100) if int(i * fps / source + 0.5) <= k) for k in range(int(100 * fps / source + 0.5))]
        got = [int(x) for x in ingest.resampled(df.withColumn("source", F.col("frame")), source, fps).orderBy("frame").toPandas()["source"]]
        assert got == want


def test_scaled_frames(spark):
    rng = np.random.default_rng(3)
    clips = {"wide": rng.integers(0, 256, (3, 4, 16, 3), dtype=np.uint8), "high": rng.integers(0, 256, (2, 9, 3, 3), dtype=np.uint8), "same": rng.integers(0, 256, (2, 8, 8, 3), dtype=np.uint8)}
    df = spark.createDataFrame(packed_rows(clips), frames.PACKED)

    def slow(image, w, h):
        old_h, old_w, _ = image.shape
        out = np.zeros((h, w, 3), np.uint8)
        for y in range(h):
            for x in range(w):
                sy, sx = (min(max((k + 0.5) * old / new - 0.5, 0), old - 1) for k, old, new in ((y, old_h, h), (x, old_w, w)))
                y0, x0 = int(sy), int(sx)
                y1, x1, fy, fx = min(y0 + 1, old_h - 1), min(x0 + 1, old_w - 1), sy - y0, sx - x0
                left = image[y0, x0] * (1 - fy) + image[y1, x0] * fy
                right = image[y0, x1] * (1 - fy) + image[y1, x1] * fy
                out[y, x] = np.floor(np.round(left * (1 - fx) + right * fx, 6) + 0.5)
        return out

    for mode in ("letterbox", "stretch"):
        got = {(r["video"], r["frame"]): np.frombuffer(r["rgb"], np.uint8).reshape(8, 8, 3) for r in ingest.scaled(df, 8, 8, mode).collect()}
        for video, w, h, left, top in (("wide", 8, 2, 0, 3), ("high", 3, 8, 2, 0), ("same", 8, 8, 0, 0)):
            for f, image in enumerate(clips[video]):
                want = np.zeros((8, 8, 3), np.uint8)
                if mode == "stretch":
                    want = slow(image, 8, 8)
                else:
                    want[top : top + h, left : left + w] = slow(image, w, h)
                assert (got[video, f] == want).all()
    with pytest.raises(ValueError):
        ingest.scaled(df, 8, 8, "other")


def test_containers_of_several_lines(spark, tmp_path):
    """Documents as other tools print them, two in a file, with text that holds U+2028."""
    text = "".join(map(chr, (0x1003, 0x2028, 0x2029, 0x8FFF)))
    docs = {v: {"width": 8, "height": 8, "frame_count": 1, "format": containers.FORMAT, "gop_boundaries": [0, 1], "level_blocks": [{"block": "a;}", "states": {}}], "index": text, "chunks": [text]} for v in ("one", "two")}
    (tmp_path / "c.js").write_text("".join(f"export const {v} = {json.dumps(d, indent=2, ensure_ascii=False)};\n\n" for v, d in docs.items()), encoding="utf-8")
    got = {r["video"]: json.loads(r["container"]) for r in containers.read(spark, str(tmp_path)).collect()}
    assert got == docs


def test_player_reads_the_text(spark):
    """Text decoded as the player does: each unit minus 0x1000 is fifteen bits."""
    data = [bytes(range(n)) * 3 for n in range(1, 60)]
    rows = spark.createDataFrame([(d.hex().upper(),) for d in data], "h string").select("h", K.units_text(K.text_units(F.col("h"))).alias("t")).collect()
    for r in rows:
        bits = "".join(f"{ord(c) - 0x1000:015b}" for c in r["t"][1:])
        bits = bits[: len(bits) - (ord(r["t"][0]) - 0x1000)]
        assert bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).hex().upper() == r["h"]


def test_palettes_by_group(spark, tiny):
    """Palettes, matches and what a container with a palette a group gives back, against plain Python."""
    own, gops, made, ix = ingest_queries.adaptive_of(spark, tiny)
    px = {}
    for r in pixels(spark, tiny).collect():
        px.setdefault(r["frame"], {})[r["idx"]] = (r["r"], r["g"], r["b"])
    cuts = [(r["gop_id"], r["start_frame"], r["end_frame"]) for r in gops.orderBy("gop_id").collect()]
    inks = [row[3:] for row in PALETTES["all"]]
    palettes, by_thumb = {}, {}
    for gop, start, end in cuts:
        thumb = px[start][0]
        if thumb not in by_thumb:
            counts = {}
            for f in [f for f in range(start, end) if (f - start) % 10 == 0][:30]:
                for c in px[f].values():
                    counts[c] = counts.get(c, 0) + 1
            points = sorted(counts)
            now = [tuple(map(float, c)) for c in points[: min(ingest_queries.SIZE, len(inks))]]
            for _ in range(10):
                near = {p: min(range(len(now)), key=lambda k, p=p: (round(sum((a - b) ** 2 for a, b in zip(p, now[k], strict=True)), 9), k)) for p in points}
                after = []
                for k, c in enumerate(now):
                    mine = [p for p in points if near[p] == k]
                    n = sum(counts[p] for p in mine)
                    after.append(tuple(sum(p[i] * counts[p] for p in mine) / n for i in range(3)) if mine else c)
                done = all(abs(a - b) <= 1e-2 for x, y in zip(now, after, strict=True) for a, b in zip(x, y, strict=True))
                now = after
                if done:
                    break
            best = [min(range(len(inks)), key=lambda k, c=c: (round(sum((a - b) ** 2 for a, b in zip(inks[k], c, strict=True)), 6), k)) for c in now]
            by_thumb[thumb] = list(dict.fromkeys([*best, *range(len(inks))]))[: ingest_queries.SIZE]
        palettes[gop] = by_thumb[thumb]
    assert {r["gop_id"]: list(r["inks"]) for r in made.collect()} == palettes

    def nearest(gop, c):
        return min(range(len(palettes[gop])), key=lambda k: (sum((a - b) ** 2 for a, b in zip(inks[palettes[gop][k]], c, strict=True)), k))

    group = {f: gop for gop, start, end in cuts for f in range(start, end)}
    for r in ix.collect():
        local = nearest(group[r["frame"]], px[r["frame"]][r["idx"]])
        assert (r["gop_id"], r["local"], r["color"]) == (group[r["frame"]], local, palettes[group[r["frame"]]][local])

    made_containers, sent = ingest_queries.adaptive_container(spark, tiny)
    blocks = {row[0]: (row[2], *row[3:]) for row in PALETTES["all"]}
    want = sorted((r["frame"], r["idx"], *blocks[r["color"]]) for r in sent.collect())
    back = A.decoded(made_containers, containers.writes(containers.parsed_adaptive(made_containers)))
    assert sorted((r["frame"], r["idx"], r["block"], r["r"], r["g"], r["b"]) for r in back.collect()) == want
    document = json.loads(made_containers.first()["container"])
    assert document["adaptive_palette"] is True and len(document["level_blocks"]) == len(cuts) == len(document["gop_boundaries"]) - 1


def test_old_containers_hold_what_new_ones_do(spark, tiny):
    made = containers.assemble_v3(wire_queries.packets_of(spark, tiny), spark.createDataFrame([(0, "n", "b", 1, 2, 3)], "color int, name string, block string, r int, g int, b int"), 8, 8)
    document = json.loads(made.first()["container"])
    assert document["format"] == containers.FORMAT_V3 and document["frame_count"] == 15 and "chunks" not in document


def test_gif_codes_and_files():
    rng = np.random.default_rng(8)
    for bits in (2, 3, 6, 8):
        for n in (0, 1, 2, 5000, 60_000):
            for most in (1, 1 << bits):
                values = rng.integers(0, most, n).astype(np.uint8).tobytes()
                assert exports.unlzw(exports.lzw(values, bits), bits) == values
    colors = [tuple(map(int, c)) for c in rng.integers(0, 256, (39, 3))]
    images = [rng.integers(0, 39, (6, 9)) for _ in range(4)]
    head, bits = exports.gif_head(9, 6, colors)
    back, table = exports.gif_images(head + b"".join(exports.gif_frame(x, bits, 5) for x in images) + b";")
    assert all((a == b).all() for a, b in zip(back, images, strict=True)) and [tuple(map(int, c)) for c in table[:39]] == colors


def test_gif_codes_of_every_length():
    """The last code can be the one after which codes are wider: then the end code is wider too."""
    rng = np.random.default_rng(9)
    for bits in (2, 3, 6, 8):
        values = rng.integers(0, 1 << bits, 5000).astype(np.uint8).tobytes()
        for n in (*range(1200), *range(3700, 5001, 13)):
            assert exports.unlzw(exports.lzw(values[:n], bits), bits) == values[:n]
