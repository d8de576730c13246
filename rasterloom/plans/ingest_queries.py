"""Frames from files, other rates and sizes, older containers, and palettes that change with the scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.palette import PALETTES, palette
from ..operators import adaptive as A
from ..operators import frames
from ..operators import pixels as P
from ..operators import runs as R
from ..operators import temporal as T
from ..sources import containers, exports, ingest, scratch
from ..sources.tables import HEIGHT, WIDTH, pixels
from .pixel_queries import PX
from .registry import query
from .temporal_queries import gops_of, kinds_of, written
from .wire_queries import RUN, container_of, packets_of, runs_of

WRITES = "frame:i idx:i color:i"


def packed(spark, sf_dir):
    return frames.pack(pixels(spark, sf_dir))


# --- rate and size

_RATE = "select o.f as frame, idx, r, g, b from px cross join lateral (select unnest(range(cast(floor(frame * {k}::double + 0.5) as bigint), cast(floor((frame + 1) * {k}::double + 0.5) as bigint))) as f) o"


@query("resample_down", PX, _RATE.format(k=0.375), "px")
def resample_down(spark, sf_dir):
    """20 frames a second at 7.5: most frames go."""
    return ingest.resampled(pixels(spark, sf_dir).select("frame", "idx", "r", "g", "b"), 20.0, 7.5)


@query("resample_up", PX, _RATE.format(k=1.25), "px")
def resample_up(spark, sf_dir):
    """20 frames a second at 25: every fourth frame is shown twice."""
    return ingest.resampled(pixels(spark, sf_dir).select("frame", "idx", "r", "g", "b"), 20.0, 25.0)


def _scale_sql(w: int, h: int, left: int = 0, top: int = 0, wide: int | None = None, high: int | None = None) -> str:
    """Bilinear scaling of the 8 x 8 frames to w x h, set into a black frame."""

    def taps(size: int, old: int) -> str:
        spot = f"least({old - 1}.0::double, greatest(0.0::double, (o.i + 0.5::double) * {old} / {size} - 0.5))"
        return f"select o.i as i, cast(floor({spot}) as int) as a, least(cast(floor({spot}) as int) + 1, {old - 1}) as b, {spot} - floor({spot}) as p from range({size}) as o(i)"

    wide, high = wide or w, high or h
    across = ", ".join(f"l.{c} * (1 - p) + r.{c} * p as {c}" for c in "rgb")
    down = ", ".join(f"floor(floor((u.{c} * (1 - p) + d.{c} * p) * 1e6 + 0.5) / 1e6 + 0.5) as {c}" for c in "rgb")
    return f"""tx as ({taps(w, WIDTH)}), ty as ({taps(h, HEIGHT)}),
downed as (select u.frame, u.x, ty.i as y, {", ".join(f"u.{c} * (1 - p) + d.{c} * p as {c}" for c in "rgb")} from ty join px u on u.y = ty.a join px d on d.y = ty.b and d.frame = u.frame and d.x = u.x),
done as (select l.frame, tx.i as x, l.y, {", ".join(f"floor(floor((l.{c} * (1 - p) + r.{c} * p) * 1e6 + 0.5) / 1e6 + 0.5) as {c}" for c in "rgb")} from tx join downed l on l.x = tx.a join downed r on r.x = tx.b and r.frame = l.frame and r.y = l.y)
===
select f.frame, s.i as idx, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from frames f cross join range({wide * high}) as s(i) left join done d on d.frame = f.frame and d.x + {left} = s.i % {wide} and d.y + {top} = s.i // {wide}"""


@query("scale_letterbox", PX, _scale_sql(12, 12, 2, 0, 16, 12), "px frames")
def scale_letterbox(spark, sf_dir):
    return frames.unpack(ingest.scaled(packed(spark, sf_dir), 16, 12, "letterbox"))


@query("scale_stretch", PX, _scale_sql(12, 5), "px frames")
def scale_stretch(spark, sf_dir):
    return frames.unpack(ingest.scaled(packed(spark, sf_dir), 12, 5, "stretch"))


@query("scale_area", PX, "select frame, (y // 4) * 4 + x // 2 as idx, floor(avg(r) + 0.5) as r, floor(avg(g) + 0.5) as g, floor(avg(b) + 0.5) as b from px group by frame, y // 4, x // 2", "px")
def scale_area(spark, sf_dir):
    return frames.unpack(ingest.scaled(packed(spark, sf_dir), 4, 2, "area"))


@query("resize_guard", PX, "select * from px", "px")
def resize_guard(spark, sf_dir):
    """Frames that have the size already come back as they are."""
    return frames.unpack(ingest.scaled(packed(spark, sf_dir), WIDTH, HEIGHT, "stretch"))


@query("scan_png", PX, "select * from px", "px")
def scan_png(spark, sf_dir):
    """Every frame written as a PNG, and the folder read in the order of names."""
    folder = scratch.folder(spark, "png")
    ingest.write_pngs(packed(spark, sf_dir), folder)
    return frames.unpack(ingest.png_frames(spark, folder, "v0"))


@query(
    "edge_find_mask", "frame:i idx:i mask:f",
    """grays as (select frame, idx, x, y, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 as v from px),
found as (select a.frame, a.idx, a.x, a.y, case when count(*) < 9 then any_value(a.v) else least(255, greatest(0, 9 * any_value(a.v) - sum(b.v))) end as e from grays a join grays b on b.frame = a.frame and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 group by a.frame, a.idx, a.x, a.y),
blurred as (select a.frame, a.idx, sum(b.e * dx.w * dy.w) / 16.0 / 255.0 as e from found a cross join (values (-1, 1), (0, 2), (1, 1)) dx(d, w) cross join (values (-1, 1), (0, 2), (1, 1)) dy(d, w) join found b on b.frame = a.frame and b.x = least(7, greatest(0, a.x + dx.d)) and b.y = least(7, greatest(0, a.y + dy.d)) group by a.frame, a.idx)
===
select frame, idx, least(1.0, greatest(0.0, 1.0 - case when max(e) over (partition by frame) > 0 then e / max(e) over (partition by frame) else e end)) as mask from blurred""", "px",
)
def edge_find_mask(spark, sf_dir):
    return P.find_edges_mask(pixels(spark, sf_dir))


# --- containers


@query("container_files", WRITES, "select frame, idx, color from written", "written")
def container_files(spark, sf_dir):
    """Containers written to files, found in them again, and decoded."""
    folder = scratch.folder(spark, "containers")
    containers.write(container_of(spark, sf_dir), folder)
    return containers.writes(containers.parsed(containers.read(spark, folder)))


@query("container_v3", WRITES, "select frame, idx, color from written", "written")
def container_v3(spark, sf_dir):
    """One binary, two index numbers a frame."""
    made = containers.assemble_v3(packets_of(spark, sf_dir), palette(spark, "full"), WIDTH, HEIGHT)
    return containers.writes_v3(containers.parsed(made, containers.FORMAT_V3))


@query("container_v3_index", "frame:i gop_id:i offset:i length:i is_keyframe:b", 'select frame, -1 as gop_id, coalesce(sum(length(packet) // 2) over (order by frame rows between unbounded preceding and 1 preceding), 0) as "offset", length(packet) // 2 as length, is_keyframe from packets', "packets")
def container_v3_index(spark, sf_dir):
    made = containers.assemble_v3(packets_of(spark, sf_dir), palette(spark, "full"), WIDTH, HEIGHT)
    return containers.index_v3(containers.parsed(made, containers.FORMAT_V3))


@query("container_v2", WRITES, "select frame, idx, color from written where frame % 7 <> 3", "written")
def container_v2(spark, sf_dir):
    """A text a frame; every seventh in the oldest form, Base64, which a player passes over."""
    texts = containers.frame_texts(packets_of(spark, sf_dir))
    texts = texts.withColumn("text", F.when((F.col("frame") % 7 == 3) & (F.col("text") != ""), F.concat(F.lit("K:"), F.base64(F.encode("text", "UTF-8")))).otherwise(F.col("text")))
    return containers.writes_frames(containers.parsed(containers.assemble_frames(texts, palette(spark, "full"), WIDTH, HEIGHT), None))


@query("container_relative", WRITES, "select frame, idx, color from written", "written")
def container_relative(spark, sf_dir):
    """The second encoder's documents: starts count from the run before."""
    own = containers.relative_packets(R.run_deltas(runs_of(spark, sf_dir)), kinds_of(spark, sf_dir))
    return containers.writes_relative(containers.parsed(containers.assemble_frames(containers.frame_texts(own), palette(spark, "full"), WIDTH, HEIGHT), None))


@query("rle_changed_list", RUN, "select * from runs", "runs")
def rle_changed_list(spark, sf_dir):
    return R.runs_of_list(written(spark, sf_dir))


# --- palettes by group

SIZE = 24


def adaptive_of(spark, sf_dir):
    """Packed frames, groups, palettes and matched pixels."""
    own, gops = scratch.stored(packed(spark, sf_dir), "packed"), scratch.stored(gops_of(spark, sf_dir), "gops")
    made = scratch.stored(A.palettes(own, gops, "all", SIZE), "palettes")
    return own, gops, made, A.matched(own, gops, made, "all")


@query("adaptive_palettes", "gop_id:i position:i color:i")
def adaptive_palettes(spark, sf_dir):
    return adaptive_of(spark, sf_dir)[2].select("gop_id", F.posexplode("inks").alias("position", "color"))


@query("adaptive_quantize", "frame:i idx:i gop_id:i color:i local:i")
def adaptive_quantize(spark, sf_dir):
    return adaptive_of(spark, sf_dir)[3]


def adaptive_container(spark, sf_dir):
    """(containers, what they write)."""
    _, gops, made, ix = adaptive_of(spark, sf_dir)
    ix = scratch.stored(ix, "matched")
    kinds = scratch.stored(T.emitted(ix), "kinds")
    sent = scratch.stored(A.packed_deltas(ix, kinds), "sent")
    with_gops = T.assign_gops(R.packets(A.localised(R.runs(sent), gops, made), kinds), gops)
    whole = containers.assemble(R.chunks(with_gops), R.index_hex(R.frame_index(with_gops)), gops, palette(spark, "all"), WIDTH, HEIGHT)
    return A.with_levels(whole, A.level_lists(made, "all")), sent


@query("adaptive_container_decode", "frame:i idx:i block:s r:i g:i b:i")
def adaptive_container_decode(spark, sf_dir):
    """A container with a palette a group, read back down to block colours."""
    made = adaptive_container(spark, sf_dir)[0]
    return A.decoded(made, containers.writes(containers.parsed_adaptive(made)))


# --- for others


@query("gif_export", WRITES, "select frame, (y * 4 + dy.d) * 32 + x * 4 + dx.d as idx, color from ix cross join range(4) as dx(d) cross join range(4) as dy(d)", "ix")
def gif_export(spark, sf_dir):
    """Matched frames as an animated GIF, four times as wide, and the file read back."""
    own = P.quantize_rgb(pixels(spark, sf_dir))
    packed_index = frames.pack(own.select("video", "frame", "idx", "y", F.col("color").alias("r"), F.col("color").alias("g"), F.col("color").alias("b")))
    index = packed_index.select("video", "frame", "width", "height", F.unhex(F.regexp_replace(F.hex("rgb"), "(..)....", "$1")).alias("colors"))
    folder = scratch.folder(spark, "gif")
    exports.write_gifs(index, folder, [row[3:] for row in PALETTES["full"]], 4).collect()  # a row a video
    return exports.read_gifs(spark, folder)


@query(
    "pack_zip", "pack:s name:s digest:s",
    """c as (select '{"width":8,"height":8,"frame_count":' || (select max(end_frame) from gops) || ',"format":"varint_rle_v4","gop_boundaries":[' || (select string_agg(start_frame, ',' order by start_frame) || ',' || max(end_frame) from gops)
  || '],"adaptive_palette":false,"level_blocks":[' || (select string_agg('{"name":"' || name || '","block":"' || block || '","rgb":[' || r || ',' || g || ',' || b || ']}', ',' order by color) from pal where palette = 'full')
  || '],"index":"' || (select t from texts where kind = -1) || '","chunks":["' || (select string_agg(t, '","' order by kind) from texts where kind >= 0) || '"]}' as container)
===
select 'v0' as pack, 'scripts/v0.js' as name, md5('export const v0 = ' || container || ';') as digest from c
union all select 'v0', 'manifest.json', md5('{"format_version":2,"header":{"name":"v0","version":[1,0,0]},"modules":[{"type":"script","entry":"scripts/v0.js","version":[1,0,0]}]}')""", "gops pal texts",
)
def pack_zip(spark, sf_dir):
    """A pack of the container and its manifest, opened again."""
    folder = scratch.folder(spark, "packs")
    exports.write_packs(container_of(spark, sf_dir), folder).collect()  # a row a video
    return exports.read_packs(spark, folder).select("pack", "name", F.md5("body").alias("digest"))
