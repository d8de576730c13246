"""Playback in batch, tiles, motion, and the event stream's windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import playback as Y
from ..operators import temporal as T
from ..sources.tables import WIDTH, indexed, pixels, table
from .registry import query
from .temporal_queries import gops_of, written


def frames_of(spark, sf_dir):
    return pixels(spark, sf_dir).select("video", "frame").distinct()


@query("tick_schedule", "tick:i frame:i", "select 5 + frame * 2 + t.d as tick, frame from frames cross join range(2) as t(d)", "frames")
def tick_schedule(spark, sf_dir):
    return Y.tick_schedule(frames_of(spark, sf_dir), 2)


_WRITES = "n as (select frame, count(*) * 1000 as n from written group by frame)"


@query("tick_budget", "frame:i n:i yields:i ticks:i done_at:i", _WRITES + "\n===\nselect frame, n, n // 4001 as yields, (n // 4001 + 1 + 11) // 12 as ticks, 5 + sum((n // 4001 + 1 + 11) // 12) over (order by frame) as done_at from n", "written")
def tick_budget(spark, sf_dir):
    """Ticks that frames take, each write counted a thousandfold to reach the limits."""
    writes = written(spark, sf_dir).groupBy("video", "frame").agg((F.count("*") * 1000).alias("n"))
    return Y.tick_budget(writes)


@query("audio_chunks", "frame:i chunk:i", "select frame, frame * 2 // 200 as chunk from frames", "frames")
def audio_chunks(spark, sf_dir):
    return frames_of(spark, sf_dir).withColumn("chunk", Y.audio_chunk(F.col("frame"), 2))


@query("audio_switches", "frame:i chunk:i", "select frame, chunk from (select frame, frame * 2 // 200 as chunk, lag(frame * 2 // 200) over (order by frame) as before from frames) where before is null or before <> chunk", "frames")
def audio_switches(spark, sf_dir):
    return Y.audio_switches(frames_of(spark, sf_dir), 2)


@query("chunk_order", "chunk:i name:s position:i", "select chunk, name, row_number() over (order by chunk) - 1 as position from (select distinct frame * 2 // 200 as chunk, 'chunk_' || (frame * 2 // 200) as name from frames)", "frames")
def chunk_order(spark, sf_dir):
    """Chunk files in the order of their numbers, not of their names."""
    names = audio_chunks(spark, sf_dir).select(F.concat(F.lit("chunk_"), "chunk").alias("name")).distinct()
    own = names.withColumn("chunk", F.regexp_extract("name", r"(\d+)$", 1).cast("int"))
    listed = own.groupBy().agg(F.array_sort(F.collect_list(F.struct("chunk", "name"))).alias("s"))  # one row a chunk file
    return listed.select(F.posexplode("s").alias("position", "s")).select("s.chunk", "s.name", "position")


@query("prefetch_gop", "frame:i gop_id:i next_gop:s", "select frame, gop_id, case when later <> gop_id then cast(later as varchar) end as next_gop from (select frame, gop_id, lead(gop_id, 10) over (order by frame) as later from gop_of)", "gop_of")
def prefetch_gop(spark, sf_dir):
    own = T.assign_gops(frames_of(spark, sf_dir), gops_of(spark, sf_dir))
    return Y.prefetch(own, 10)


# a step for each 50 requests, which a fold goes through one by one
_WALK = """r as (select event_id - min(event_id) over () as n, user_id % 7 as gop_id from events),
parts as (select n // 50 as part, list({'turn': n, 'gop_id': gop_id, 'hit': false, 'held': []::bigint[]} order by n) as own from r group by 1),
walk(part, done) as (
  select -1::bigint, [{'turn': -1::bigint, 'gop_id': -1::bigint, 'hit': false, 'held': []::bigint[]}]
  union all
  select p.part, list_reduce(list_concat([list_concat([], [w.done[-1]])], list_transform(p.own, lambda x: [x])), lambda done, x: list_concat(done, [{
    'turn': x[1].turn, 'gop_id': x[1].gop_id, 'hit': list_contains(done[-1].held, x[1].gop_id),
    'held': case when list_contains(done[-1].held, x[1].gop_id) then done[-1].held else list_slice(list_prepend(x[1].gop_id, done[-1].held), 1, 4) end}]))
  from walk w join parts p on p.part = w.part + 1)
===
select s.turn, s.gop_id, s.hit from (select unnest(done[2:]) as s from walk where part >= 0)"""


@query("gop_cache_sim", "turn:i gop_id:i hit:b", _WALK)
def gop_cache_sim(spark, sf_dir):
    """Requests of all events against a cache of four groups: the request list is the input."""
    events = table(spark, sf_dir, "events")
    return Y.cache_hits(events.select(F.lit("v0").alias("video"), F.col("event_id").alias("at"), (F.col("user_id") % 7).alias("gop_id")), 4).withColumnRenamed("at", "turn")


@query("next_video", "video_id:s next_id:s previous_id:s", "v as (select n_name as video_id, row_number() over (order by n_nationkey) - 1 as p from nation)\n===\nselect v.video_id, a.video_id as next_id, b.video_id as previous_id from v join v a on a.p = (v.p + 1) % 25 join v b on b.p = (v.p + 24) % 25")
def next_video(spark, sf_dir):
    """A list of videos, here nations, with their neighbours around the end."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("video_id"), F.col("n_nationkey").alias("position"))
    return Y.neighbour_videos(names)


TILE = 4


@query("tile_dictionary", "tile_id:i digest:s first_frame:i", "select tile_id, digest, first_frame from dict", "dict")
def tile_dictionary(spark, sf_dir):
    return B.dictionary(B.tiles(indexed(spark, sf_dir), TILE))


@query("tile_map", "frame:i tx:i ty:i tile_id:i", "select frame, tx, ty, tile_id from tiles join dict using (digest)", "dict")
def tile_map(spark, sf_dir):
    found = B.tiles(indexed(spark, sf_dir), TILE)
    return B.tile_map(found, B.dictionary(found))


@query("tile_reconstruct", "frame:i idx:i color:i", "select frame, idx, color from ix", "ix")
def tile_reconstruct(spark, sf_dir):
    found = B.tiles(indexed(spark, sf_dir), TILE)
    known = B.dictionary(found)
    return B.from_tiles(B.tile_map(found, known), known, TILE, WIDTH)


@query("tile_savings", "frame:i n_tiles:i new_tiles:i payload:i raw:i", "select frame, n_tiles, new_tiles, n_tiles * 2 + new_tiles * 16 as payload, n_tiles * 16 as raw from (select frame, count(*) as n_tiles from tiles group by frame) join (select frame, (select count(*) from dict where first_frame = frame) as new_tiles from frames) using (frame)", "dict frames")
def tile_savings(spark, sf_dir):
    found = B.tiles(indexed(spark, sf_dir), TILE)
    known = B.dictionary(found)
    return B.savings(B.tile_map(found, known), known, TILE)


@query("motion_vectors", "frame:i bx:i by:i dx:i dy:i sad:i", 'select frame, bx, by_ as "by", dx, dy, sad from shifts', "shifts")
def motion_vectors(spark, sf_dir):
    return B.motion(pixels(spark, sf_dir), TILE, 2)


@query(
    "motion_compensate", "frame:i idx:i color:i predicted:i raw:b",
    "select i.frame, i.idx, i.color, coalesce(p.color, i.color) as predicted, p.color is null as raw from ix i join shifts s on s.frame = i.frame and s.bx = i.x // 4 and s.by_ = i.y // 4 left join ix p on s.sad <= 600 and p.frame = i.frame - 1 and p.x = i.x - s.dx and p.y = i.y - s.dy", "ix shifts",
)
def motion_compensate(spark, sf_dir):
    return B.compensate(indexed(spark, sf_dir), B.motion(pixels(spark, sf_dir), TILE, 2, most_sad=600), TILE)


EVENTS = "window_start:i event_type:s n:i total:f"


@query("events_tumbling", EVENTS, "select epoch(time_bucket(interval 10 seconds, ts, timestamp '1970-01-01'))::bigint as window_start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def events_tumbling(spark, sf_dir):
    """Ten-second windows of real timestamps."""
    own = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 seconds").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.withColumn("window_start", F.unix_timestamp("w.start"))


@query("events_sliding", EVENTS, "select epoch(time_bucket(interval 10 minutes, ts, timestamp '1970-01-01'))::bigint - k.k * 600 as window_start, event_type, count(*) as n, sum(value) as total from events cross join range(3) as k(k) group by 1, 2")
def events_sliding(spark, sf_dir):
    """Half-hour windows that begin every ten minutes."""
    own = table(spark, sf_dir, "events").groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.withColumn("window_start", F.unix_timestamp("w.start"))


@query(
    "events_session", "user_id:i session_start:i session_end:i n:i",
    "g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as new, event_id from events),\ns as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as s from g)\n===\nselect user_id, epoch_us(min(ts)) as session_start, epoch_us(max(ts)) + 1800000000 as session_end, count(*) as n from s group by user_id, s",
)
def events_session(spark, sf_dir):
    """Sessions that end after half an hour without an event of the user."""
    own = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp_ltz")).alias("session_start"), F.unix_micros(F.col("w.end").cast("timestamp_ltz")).alias("session_end"), "n")
