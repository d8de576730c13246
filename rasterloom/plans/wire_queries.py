"""Runs, packets, text, index, chunks: the wire format both ways, and containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec as K
from ..functions.palette import palette
from ..operators import runs as R
from ..operators import temporal as T
from ..sources import containers, scratch
from ..sources.tables import HEIGHT, WIDTH, indexed, pixels
from .registry import SIZE, leb_sql, query
from .temporal_queries import gops_of, kinds_of, written

RUN = "frame:i y:i x0:i len:i color:i"


def runs_of(spark, sf_dir):
    return R.runs(written(spark, sf_dir))


def packets_of(spark, sf_dir, gops=None):
    """Packets with their groups. Pixels and kinds of frames are made once: both sides of a join read them."""
    ix = scratch.stored(indexed(spark, sf_dir), "indexed")
    kinds = scratch.stored(T.emitted(ix), "kinds")
    return T.assign_gops(R.packets(R.runs(T.deltas(ix, kinds)), kinds), gops_of(spark, sf_dir) if gops is None else gops)


@query("rle_runs", RUN, "select * from runs", "runs")
def rle_runs(spark, sf_dir):
    return runs_of(spark, sf_dir)


@query("rle_keyframe", RUN, "k as (select *, x - row_number() over (partition by frame, y, color order by x) as island from ix where frame % 30 = 0)\n===\nselect frame, y, min(x) as x0, count(*) as len, color from k group by frame, y, color, island", "ix")
def rle_keyframe(spark, sf_dir):
    return R.runs(indexed(spark, sf_dir).where(T.is_keyframe(F.col("frame"), 30)))


@query("run_delta", "frame:i start:i delta:i", "select frame, start, start - lag(start, 1, 0) over (partition by frame order by start) as delta from runs", "runs")
def run_delta(spark, sf_dir):
    return R.run_deltas(runs_of(spark, sf_dir))


@query("pack_run", "frame:i start:i len:i color:i value:i", "select frame, start, len, color, value from packed", "packed")
def pack_run(spark, sf_dir):
    return R.packed(runs_of(spark, sf_dir))


@query("unpack_run", "frame:i value:i idx:i len:i color:i", "select frame, value, value >> 13 as idx, ((value >> 7) & 63) + 1 as len, value & 127 as color from packed", "packed")
def unpack_run(spark, sf_dir):
    own = R.packed(runs_of(spark, sf_dir)).select("frame", "value")
    index, length, color = K.unpack(F.col("value"))
    return own.select("frame", "value", index.alias("idx"), length.alias("len"), color.alias("color"))


@query("frame_header", "frame:i header:i", "select frame, (frame::bigint << 1) | (case when kind = 'K' then 1 else 0 end) as header from kinds", "kinds")
def frame_header(spark, sf_dir):
    return kinds_of(spark, sf_dir).select("frame", K.header(F.col("frame"), F.col("kind") == "K").alias("header"))


@query("varint_encode", "value:i hexed:s", f"select distinct value, {leb_sql('value')} as hexed from (select value from packed union all select l_orderkey * 77777 % 2147483647 from lineitem)", "packed")
def varint_encode(spark, sf_dir):
    """Run values and a spread of others, up to five bytes."""
    from ..sources.tables import table

    more = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 77777 % 2147483647).alias("value"))
    values = R.packed(runs_of(spark, sf_dir)).select("value").unionByName(more).distinct()
    return values.withColumn("hexed", K.varint_hex(F.col("value")))


@query("varint_decode", "frame:i position:i value:i", "select frame, position, value from (select frame, 0 as position, (frame::bigint << 1) | (case when kind = 'K' then 1 else 0 end) as value from kinds where kind <> 'S' union all select frame, 1, count(*) from packed group by frame union all select frame, 1 + row_number() over (partition by frame order by start), value from packed) where frame in (select frame from packed)", "kinds packed")
def varint_decode(spark, sf_dir):
    """Packets taken apart again: header, count, runs."""
    own = packets_of(spark, sf_dir).where("n_runs > 0")
    return own.select("frame", F.posexplode(K.varints(F.col("packet"))).alias("position", "value"))


@query("frame_index", "gop_id:i frame:i offset:i length:i is_keyframe:b", 'select gop_id, frame, offset_ as "offset", length, is_keyframe from places', "places")
def frame_index(spark, sf_dir):
    return R.frame_index(packets_of(spark, sf_dir))


@query("gop_chunk", "gop_id:i chunk:s", "select gop_id, string_agg(packet, '' order by frame) as chunk from places group by gop_id", "places")
def gop_chunk(spark, sf_dir):
    return R.chunks(packets_of(spark, sf_dir))


@query(
    "utf16_pack", "gop_id:i position:i unit:i",
    "c as (select gop_id, string_agg(packet, '' order by frame) as chunk from places group by gop_id),\nbits as (select gop_id, string_agg(lpad(bin(('0x' || substr(chunk, i.i * 2 + 1, 2))::bigint), 8, '0'), '' order by i.i) as b from c join range(200000) as i(i) on i.i < length(chunk) // 2 group by gop_id),\npads as (select gop_id, (15 - length(b) % 15) % 15 as pad, b || repeat('0', (15 - length(b) % 15) % 15) as b from bits)\n===\nselect gop_id, 0 as position, 4096 + pad as unit from pads union all select gop_id, i.i + 1, list_sum(list_transform(range(15), lambda k: (substr(b, i.i * 15 + k + 1, 1) = '1')::bigint << (14 - k))) + 4096 from pads join range(200000) as i(i) on i.i < length(b) // 15", "places",
)
def utf16_pack(spark, sf_dir):
    """Chunks as the code units of 15-bit text."""
    return R.chunks(packets_of(spark, sf_dir)).select("gop_id", F.posexplode(K.text_units(F.col("chunk"))).alias("position", "unit"))


@query("utf16_roundtrip", "gop_id:i chunk:s", "select gop_id, string_agg(packet, '' order by frame) as chunk from places group by gop_id", "places")
def utf16_roundtrip(spark, sf_dir):
    """Chunks written as text and read back."""
    text = R.chunks(packets_of(spark, sf_dir)).select("gop_id", K.units_text(K.text_units(F.col("chunk"))).alias("text"))
    return text.select("gop_id", K.text_hex(F.col("text")).alias("chunk"))


_G1 = "from range(64) as y(y) cross join range(64) as x(x)"


@query("g1_decode", "idx:i color:i", f"select y.y * 64 + x.x as idx, 11 as color {_G1}")
def g1_decode(spark, sf_dir):
    """An old container's text: 64 x 64 pixels of colour 11, as Base64 of numbers (distance << 6 | colour)."""
    numbers = bytes([11]) + bytes([75]) * (64 * 64 - 1)
    import base64

    row = spark.createDataFrame([("K:" + base64.b64encode(numbers).decode(),)], "frame string")
    values = row.select(F.posexplode(K.varints(F.hex(F.unbase64(F.regexp_replace("frame", "^K:", ""))))).alias("position", "value"))
    from pyspark.sql import Window

    order = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # one frame: as many rows as pixels
    return values.select(F.sum(F.shiftright("value", 6)).over(order).alias("idx"), F.col("value").bitwiseAND(F.lit(63)).alias("color"))


def container_of(spark, sf_dir):
    gops = scratch.stored(gops_of(spark, sf_dir), "gops")
    px = scratch.stored(packets_of(spark, sf_dir, gops), "packets")
    return containers.assemble(R.chunks(px), R.index_hex(R.frame_index(px)), gops, palette(spark, "full"), WIDTH, HEIGHT)


@query(
    "container_json", "video:s container:s",
    """select 'v0' as video, '{"width":8,"height":8,"frame_count":' || (select max(end_frame) from gops) || ',"format":"varint_rle_v4","gop_boundaries":[' || (select string_agg(start_frame, ',' order by start_frame) || ',' || max(end_frame) from gops)
  || '],"adaptive_palette":false,"level_blocks":[' || (select string_agg('{"name":"' || name || '","block":"' || block || '","rgb":[' || r || ',' || g || ',' || b || ']}', ',' order by color) from pal where palette = 'full')
  || '],"index":"' || (select t from texts where kind = -1) || '","chunks":["' || (select string_agg(t, '","' order by kind) from texts where kind >= 0) || '"]}' as container""", "gops pal texts",
)
def container_json(spark, sf_dir):
    return container_of(spark, sf_dir)


@query("container_decode", "frame:i idx:i color:i", "select frame, idx, color from written", "written")
def container_decode(spark, sf_dir):
    """A container read back down to the pixels that its frames write."""
    return containers.writes(containers.parsed(container_of(spark, sf_dir)))
