"""Differences between frames, skipping, scene cuts, quality and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.palette import palette
from ..operators import metrics as M
from ..operators import pixels as P
from ..operators import temporal as T
from ..sources.tables import WIDTH, indexed, pixels
from .registry import SIZE, query

SCORE = "frame:i sad:f hist:f edge:f score:f"


def kinds_of(spark, sf_dir):
    return T.emitted(indexed(spark, sf_dir))


def written(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return T.deltas(ix, T.emitted(ix))


def decoded_pairs(spark, sf_dir):
    """The frames and their palette version."""
    px = pixels(spark, sf_dir)
    return M.paired(px, P.decode(indexed(spark, sf_dir), palette(spark, "full")))


def gops_of(spark, sf_dir):
    return T.boundaries(T.scene_score(pixels(spark, sf_dir)))


@query("frame_diff", "frame:i idx:i prev:i color:i", "select * from (select frame, idx, color, coalesce(lag(color) over (partition by idx order by frame), -1) as prev from ix) where color <> prev", "ix")
def frame_diff(spark, sf_dir):
    return T.changes(indexed(spark, sf_dir))


@query("unchanged_rows", "frame:i y:i", "select distinct a.frame, a.y from ix a where a.frame > 0 and not exists (select 1 from ix b join ix c on c.frame = b.frame - 1 and c.idx = b.idx where b.frame = a.frame and b.y = a.y and b.color <> c.color)", "ix")
def unchanged_rows(spark, sf_dir):
    ix = indexed(spark, sf_dir)
    return ix.where("frame > 0").select("video", "frame", "y").distinct().join(T.changes(ix).select("video", "frame", "y").distinct(), ["video", "frame", "y"], "left_anti")


@query("pixels_except", "frame:i idx:i color:i", "select frame, idx, color from ix where frame > 0 except all select frame + 1, idx, color from ix", "ix")
def pixels_except(spark, sf_dir):
    """The changed pixels of later frames as a difference of sets."""
    ix = indexed(spark, sf_dir).select("frame", "idx", "color")
    return ix.where("frame > 0").exceptAll(ix.select((F.col("frame") + 1).alias("frame"), "idx", "color"))


@query("change_ratio", "frame:i ratio:f", "select a.frame, avg(case when a.color <> b.color then 1.0 else 0.0 end) as ratio from ix a join ix b on a.idx = b.idx and a.frame = b.frame + 1 group by a.frame", "ix")
def change_ratio(spark, sf_dir):
    own = T.with_previous(indexed(spark, sf_dir), ["color"])
    return own.groupBy("video", "frame").agg(F.avg((F.col("color") != F.col("color_before")).cast("int")).alias("ratio"))


@query("keyframes", "frame:i is_keyframe:b", "select frame, frame % 30 = 0 as is_keyframe from frames", "frames")
def keyframes(spark, sf_dir):
    return pixels(spark, sf_dir).select("video", "frame").distinct().withColumn("is_keyframe", T.is_keyframe(F.col("frame"), 30))


@query("adaptive_skip", "frame:i kind:s", "select frame, kind from kinds", "kinds")
def adaptive_skip(spark, sf_dir):
    return kinds_of(spark, sf_dir)


@query("frame_delta", "frame:i idx:i color:i kind:s", "select * from written", "written")
def frame_delta(spark, sf_dir):
    return written(spark, sf_dir)


@query("encode_stats", "total:i keyframes:i skipped:i sent:i", "select count(*) as total, count(*) filter (where kind = 'K') as keyframes, count(*) filter (where kind = 'S') as skipped, count(*) filter (where kind <> 'S') as sent from kinds", "kinds")
def encode_stats(spark, sf_dir):
    k = F.col("kind")
    return kinds_of(spark, sf_dir).groupBy("video").agg(F.count("*").alias("total"), F.count_if(k == "K").alias("keyframes"), F.count_if(k == "S").alias("skipped"), F.count_if(k != "S").alias("sent"))


@query("frame_sad", "frame:i sad:f", "select * from sads", "sads")
def frame_sad(spark, sf_dir):
    return T.sad(pixels(spark, sf_dir))


@query("histogram32", "frame:i bin:i n:i", "select * from hist", "hist")
def histogram32(spark, sf_dir):
    return T.histogram(pixels(spark, sf_dir))


@query("histogram_diff", "frame:i hist:f", "select * from hists", "hists")
def histogram_diff(spark, sf_dir):
    return T.histogram_diff(pixels(spark, sf_dir))


@query("edge_diff", "frame:i edge:f", "select * from edged", "edged")
def edge_diff(spark, sf_dir):
    return T.edge_diff(pixels(spark, sf_dir))


@query("scene_score", SCORE, "select * from scores", "scores")
def scene_score(spark, sf_dir):
    return T.scene_score(pixels(spark, sf_dir))


@query("gop_boundaries", "gop_id:i start_frame:i end_frame:i", "select * from gops", "gops")
def gop_boundaries(spark, sf_dir):
    return gops_of(spark, sf_dir)


@query("gop_assign", "frame:i gop_id:i", "select * from gop_of", "gop_of")
def gop_assign(spark, sf_dir):
    frames = pixels(spark, sf_dir).select("video", "frame").distinct()
    return T.assign_gops(frames, gops_of(spark, sf_dir))


@query("gop_palette", "frame:i gop_id:i palette:s color:i r:i g:i b:i", "select frame, gop_id, palette, color, r, g, b from gop_of join pal on palette = case when gop_id % 2 = 0 then 'concrete' else 'expanded' end", "gop_of pal")
def gop_palette(spark, sf_dir):
    """The palette in force at each frame, when groups take turns between two."""
    own = gop_assign(spark, sf_dir).withColumn("palette", F.when(F.col("gop_id") % 2 == 0, "concrete").otherwise("expanded"))
    return own.join(F.broadcast(palette(spark, "concrete", "expanded").select("palette", "color", "r", "g", "b")), "palette")


@query("reconstruct_frames", "frame:i idx:i color:i", f"select f.frame, p.idx, (select arg_max(w.color, w.frame) from written w where w.idx = p.idx and w.frame <= f.frame) as color from frames f cross join range({SIZE}) as p(idx)", "written frames")
def reconstruct_frames(spark, sf_dir):
    frames = pixels(spark, sf_dir).select("video", "frame").distinct()
    return T.reconstructed(written(spark, sf_dir), frames, SIZE)


@query("seek_keyframe", "target:i keyframe:i", "select t.frame as target, max(k.frame) as keyframe from frames t join kinds k on k.kind = 'K' and k.frame <= t.frame group by t.frame", "kinds frames")
def seek_keyframe(spark, sf_dir):
    """The nearest keyframe at or before each frame: an as-of join as a window over the frames."""
    from pyspark.sql import Window

    own = kinds_of(spark, sf_dir)
    last = F.last(F.when(F.col("kind") == "K", F.col("frame")), ignorenulls=True).over(Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return own.select("video", F.col("frame").alias("target"), last.alias("keyframe"))


@query("seek_state", "idx:i color:i", "key as (select max(frame) as f from kinds where kind = 'K' and frame <= 100)\n===\nselect idx, arg_max(color, frame) as color from written where frame between (select f from key) and least(100, (select max(frame) from frames)) group by idx", "written kinds frames")
def seek_state(spark, sf_dir):
    return T.seek(written(spark, sf_dir), 100)


@query("clear_screen", "frame:i idx:i color:i r:i g:i b:i", f"select 0 as frame, i.idx, color, r, g, b from range({SIZE}) as i(idx) cross join pal where palette = 'full' and color = 0", "pal")
def clear_screen(spark, sf_dir):
    first = palette(spark, "full").where("color = 0").select("color", "r", "g", "b", F.lit(0).alias("frame"))
    return first.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))))


@query("psnr", "frame:i psnr:f", "select frame, case when mse = 0 then 100.0 else 20 * log10(255 / sqrt(mse)) end as psnr from (select frame, avg((a - b) * (a - b)) as mse from both_chans group by frame)", "both_chans")
def psnr(spark, sf_dir):
    return M.psnr(decoded_pairs(spark, sf_dir))


@query("ssim_global", "frame:i ssim:f", "select * from ssims", "ssims")
def ssim_global(spark, sf_dir):
    return M.ssim(decoded_pairs(spark, sf_dir))


@query("ssim_sampled", "ssim:f n_frames:i", "select avg(ssim) as ssim, count(*) as n_frames from ssims where frame % 10 = 0 and frame < 500", "ssims")
def ssim_sampled(spark, sf_dir):
    return M.ssim_sampled(decoded_pairs(spark, sf_dir))


@query(
    "ssim_local", "frame:i ssim:f",
    """sides as (select frame, idx % 8 as x, idx // 8 as y, unnest([{'c': 0, 'a': r1, 'b': r2}, {'c': 1, 'a': g1, 'b': g2}, {'c': 2, 'a': b1, 'b': b2}]) as v from mates),
wins as (select frame, v.c as c, wx.d as wx, wy.d as wy, avg(v.a) as ma, avg(v.b) as mb, var_samp(v.a) as va, var_samp(v.b) as vb, covar_samp(v.a, v.b) as cov
  from sides cross join range(2) as wx(d) cross join range(2) as wy(d) where x between wx.d and wx.d + 6 and y between wy.d and wy.d + 6 group by all)
===
select frame, avg(((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) as ssim from wins group by frame""", "mates",
)
def ssim_local(spark, sf_dir):
    return M.ssim_windows(decoded_pairs(spark, sf_dir), WIDTH)


@query("delta_e2000", "frame:i delta_e:f", "select * from des", "des")
def delta_e2000(spark, sf_dir):
    return M.delta_e(decoded_pairs(spark, sf_dir))


@query("quality_gate", "frame:i ssim:f delta_e:f passed:b", "select frame, ssim, delta_e, ssim >= 0.85 and delta_e <= 3.0 as passed from ssims join des using (frame)", "ssims des")
def quality_gate(spark, sf_dir):
    pairs = decoded_pairs(spark, sf_dir)
    return M.gate(M.ssim(pairs).join(M.delta_e(pairs), ["video", "frame"]))


@query("metric_zip", "frame:i same:i", "select a.frame, count(*) filter (where a.r = d.r and a.g = d.g and a.b = d.b) as same from px a join decoded d on d.frame = a.frame and d.idx = a.idx where d.frame < (select max(frame) from px) group by a.frame", "px decoded")
def metric_zip(spark, sf_dir):
    """Frames compared one by one up to the end of the shorter version, which lacks the last frame."""
    px = pixels(spark, sf_dir)
    last = px.groupBy("video").agg(F.max("frame").alias("last"))
    shorter = P.decode(indexed(spark, sf_dir), palette(spark, "full")).join(last, "video").where(F.col("frame") < F.col("last"))
    pairs = M.paired(px, shorter)
    same = (F.col("r1") == F.col("r2")) & (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("b2"))
    return pairs.groupBy("video", "frame").agg(F.count_if(same).alias("same"))


@query(
    "metric_report", "metric:s value:s",
    "m as (select (select avg(case when mse = 0 then 100.0 else 20 * log10(255 / sqrt(mse)) end) from (select frame, avg((a - b) * (a - b)) as mse from both_chans group by frame)) as psnr, (select avg(ssim) from ssims) as ssim)\n===\nselect 'psnr' as metric, printf('%.4f', psnr) as value from m union all select 'ssim', printf('%.4f', ssim) from m union all select 'ms_ssim', 'nan'", "both_chans ssims",
)
def metric_report(spark, sf_dir):
    """Averages as text; a measure that isn't available is not a number there and null here."""
    pairs = decoded_pairs(spark, sf_dir)
    own = M.psnr(pairs).join(M.ssim(pairs), ["video", "frame"]).agg(F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))
    return M.report(own.withColumn("ms_ssim", F.lit(None).cast("double")))


@query("stats_rollup", "gop_id:i kind:s frames:i", "select gop_id, kind, count(*) as frames from kinds join gop_of using (frame) group by rollup (gop_id, kind)", "kinds gop_of")
def stats_rollup(spark, sf_dir):
    return T.assign_gops(kinds_of(spark, sf_dir), gops_of(spark, sf_dir)).rollup("gop_id", "kind").agg(F.count("*").alias("frames"))


@query("distinct_colors", "frame:i colors:i", "select frame, count(distinct color) as colors from ix group by frame", "ix")
def distinct_colors(spark, sf_dir):
    return indexed(spark, sf_dir).groupBy("video", "frame").agg(F.countDistinct("color").alias("colors"))


@query("sample_cap", "frame:i", "select frame from frames where frame % 10 = 0 order by frame limit 30", "frames")
def sample_cap(spark, sf_dir):
    """The first 30 sampled frames: the cap is the feature."""
    return pixels(spark, sf_dir).where("frame % 10 = 0").select("frame").distinct().orderBy("frame").limit(30)
