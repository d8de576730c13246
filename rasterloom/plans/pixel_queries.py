"""Scans, colour, dithering, quantization and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.palette import FALLBACK, NAMESPACE, PALETTES, palette
from ..operators import kernels, metrics
from ..operators import pixels as P
from ..operators import temporal as T
from ..sources.tables import HEIGHT, WIDTH, indexed, nearest_center, nearest_rgb, pixels, table
from .registry import oklab_sql, query

PX = "frame:i idx:i r:i g:i b:i"


@query("scan_frames", PX, "select * from px", "px")
def scan_frames(spark, sf_dir):
    return pixels(spark, sf_dir)


@query("sample_every_nth", PX, "select * from px where frame % 4 = 0", "px")
def sample_every_nth(spark, sf_dir):
    return P.every_nth(pixels(spark, sf_dir), 20.0, 5.0)


@query("limit_duration", PX, "select * from px where frame < 40", "px")
def limit_duration(spark, sf_dir):
    return P.first_seconds(pixels(spark, sf_dir), 2.0, 20.0)


@query("palette_catalog", "palette:s color:i name:s block:s r:i g:i b:i", "select * from pal", "pal")
def palette_catalog(spark, sf_dir):
    return palette(spark)


@query("palette_union", "name:s r:i g:i b:i", "select distinct name, r, g, b from pal where palette in ('concrete', 'full')", "pal")
def palette_union(spark, sf_dir):
    return palette(spark, "concrete").unionByName(palette(spark, "full")).select("name", "r", "g", "b").distinct()


@query("video_catalog", "video_id:s title:s frame_count:i width:i height:i", "select 'v0' as video_id, 'events' as title, count(distinct frame) as frame_count, max(x) + 1 as width, max(y) + 1 as height from px", "px")
def video_catalog(spark, sf_dir):
    counted = pixels(spark, sf_dir).groupBy(F.col("video").alias("video_id")).agg((F.max("frame") + 1).alias("frame_count"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return counted.withColumn("title", F.lit("events"))


@query("upscale_nearest", PX, "select frame, (y * 4 + dy.d) * 32 + x * 4 + dx.d as idx, r, g, b from px cross join range(4) as dx(d) cross join range(4) as dy(d)", "px")
def upscale_nearest(spark, sf_dir):
    return P.upscale(pixels(spark, sf_dir), WIDTH, 4)


@query("thumbnail_subsample", PX, "select * from px where x % 4 = 0 and y % 4 = 0", "px")
def thumbnail_subsample(spark, sf_dir):
    return P.subsample(pixels(spark, sf_dir), 4)


@query(
    "scene_palette_hash", "digest:s first_frame:i n_frames:i",
    "select digest, min(frame) as first_frame, count(*) as n_frames from (select frame, md5(string_agg(r || '.' || g || '.' || b, ',' order by idx)) as digest from px where x % 4 = 0 and y % 4 = 0 group by frame) group by digest", "px",
)
def scene_palette_hash(spark, sf_dir):
    thumb = P.subsample(pixels(spark, sf_dir), 4)
    listed = F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(".", "r", "g", "b").alias("c"))))
    digests = thumb.groupBy("video", "frame").agg(F.md5(F.array_join(F.transform(listed, lambda s: s["c"]), ",")).alias("digest"))
    return digests.groupBy("video", "digest").agg(F.min("frame").alias("first_frame"), F.count("*").alias("n_frames"))


@query("pixel_xy", "frame:i idx:i x:i y:i back:i", "select frame, idx, idx % 8 as x, idx // 8 as y, (idx // 8) * 8 + idx % 8 as back from px", "px")
def pixel_xy(spark, sf_dir):
    px = pixels(spark, sf_dir).select("frame", "idx")
    own = px.withColumn("x", F.col("idx") % WIDTH).withColumn("y", F.floor(F.col("idx") / WIDTH))
    return own.withColumn("back", F.col("y") * WIDTH + F.col("x"))


@query("gray_luma", "frame:i idx:i gray:f", "select frame, idx, v as gray from luma", "luma")
def gray_luma(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("gray", C.luma(*P.rgb()))


@query("gray_mean", "frame:i idx:i gray:f", "select frame, idx, v as gray from gray", "gray")
def gray_mean(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("gray", C.mean_gray(*P.rgb()))


_L, _A, _B = oklab_sql("r", "g", "b")


@query("oklab", "frame:i idx:i l:f a:f bb:f", f"select frame, idx, {_L} as l, {_A} as a, {_B} as bb from px", "px")
def oklab(spark, sf_dir):
    own = pixels(spark, sf_dir).withColumn("ok", C.oklab(*P.rgb()))
    return own.select("frame", "idx", F.col("ok.L").alias("l"), F.col("ok.a").alias("a"), F.col("ok.b").alias("bb"))


def _clipped(bias: str, source: str) -> str:
    cols = ", ".join(f"floor(round(least(255.0, greatest(0.0, {c} + {bias})), 6)) as {c}" for c in "rgb")
    return f"select frame, idx, {cols} from {source}"


_BAYER = f"((([{', '.join(map(str, C.BAYER))}])[(y % 4) * 4 + x % 4 + 1] / 16.0::double - 0.5) * 32.0::double)"


@query("dither_ordered", PX, _clipped(_BAYER, "px"), "px")
def dither_ordered(spark, sf_dir):
    return P.dither_ordered(pixels(spark, sf_dir))


@query("dither_ordered_perceptual", PX, _clipped(f"{_BAYER} * mask", "px join sobel using (frame, idx)"), "px sobel")
def dither_ordered_perceptual(spark, sf_dir):
    return P.dither_ordered_perceptual(pixels(spark, sf_dir))


_NOISE = f"((([{', '.join(map(str, C.blue_noise(WIDTH, HEIGHT)))}])[y * 8 + x + 1]::double - 0.5) * 64.0::double)"


@query("dither_blue_noise", PX, _clipped(_NOISE, "px"), "px")
def dither_blue_noise(spark, sf_dir):
    return P.dither_blue_noise(pixels(spark, sf_dir), WIDTH, HEIGHT)


for _method in kernels.WEIGHTS:
    query(f"dither_{_method}", "frame:i idx:i color:i")(lambda spark, sf_dir, m=_method: kernels.error_diffusion(pixels(spark, sf_dir), m))


@query("rdo_encode", "frame:i idx:i color:i")
def rdo_encode(spark, sf_dir):
    return kernels.rate_controlled(pixels(spark, sf_dir))


@query("quantize_rgb", "frame:i idx:i color:i", "select * from ix", "ix")
def quantize_rgb(spark, sf_dir):
    return P.quantize_rgb(pixels(spark, sf_dir))


_PL, _PA, _PB = oklab_sql("r", "g", "b")


@query(
    "quantize_oklab", "frame:i idx:i color:i",
    f"""labs as (select frame, idx, {_L} as l, {_A} as a, {_B} as bb from px), inks as (select color, {_PL} as l, {_PA} as a, {_PB} as bb from pal where palette = 'full'),
ranked as (select frame, idx, color, row_number() over (partition by frame, idx order by round((labs.l - inks.l) ** 2 + (labs.a - inks.a) ** 2 + (labs.bb - inks.bb) ** 2, 12), color) as rn from labs cross join inks)
===
select frame, idx, color from ranked where rn = 1""", "px pal",
)
def quantize_oklab(spark, sf_dir):
    return P.quantize_oklab(pixels(spark, sf_dir))


@query("decode_rgb", PX, "select i.frame, i.idx, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b from ix i left join pal p on p.palette = 'concrete' and p.color = i.color", "ix pal")
def decode_rgb(spark, sf_dir):
    return P.decode(indexed(spark, sf_dir), palette(spark, "concrete"))


@query(
    "block_alias", "color:i asked:s resolved:s",
    f"select color, asked, case when real in (select block from pal where palette = 'concrete') or real = '{NAMESPACE}hardened_clay' then real else '{NAMESPACE}{FALLBACK}' end as resolved "
    f"from (select color, asked, case when asked = '{NAMESPACE}terracotta' then '{NAMESPACE}hardened_clay' else asked end as real from (select color, case when name = 'terracotta' then '{NAMESPACE}terracotta' else block end as asked from pal where palette = 'full'))", "pal",
)
def block_alias(spark, sf_dir):
    """The full palette as a player that knows the plain colours and the clay resolves it."""
    asked = palette(spark, "full").withColumn("block", F.when(F.col("name") == "terracotta", NAMESPACE + "terracotta").otherwise(F.col("block")))
    known = [row[2] for row in PALETTES["concrete"]] + [NAMESPACE + "hardened_clay"]
    return P.block_ids(asked, known).withColumnRenamed("block", "asked")


@query("edge_gradient", "frame:i idx:i edge:f", "select * from edges", "edges")
def edge_gradient(spark, sf_dir):
    return P.gradient(pixels(spark, sf_dir))


@query("edge_sobel_mask", "frame:i idx:i mask:f", "select * from sobel", "sobel")
def edge_sobel_mask(spark, sf_dir):
    return P.sobel_mask(pixels(spark, sf_dir))


@query("avg_pool_3x3", "frame:i idx:i pooled:f", "select frame, idx, total / 9.0 as pooled from box", "box")
def avg_pool_3x3(spark, sf_dir):
    return P.avg_pool(pixels(spark, sf_dir).withColumn("gray", C.mean_gray(*P.rgb())), "gray", "pooled")


@query("local_variance", "frame:i idx:i variance:f", "select * from vars", "vars")
def local_variance(spark, sf_dir):
    return P.local_variance(pixels(spark, sf_dir))


@query("perceptual_scale", "frame:i idx:i scale:f", "select frame, idx, 1.0 + 2.0 * (1.0 - least(1.0, greatest(0.0, variance / 500.0))) as scale from vars", "vars")
def perceptual_scale(spark, sf_dir):
    return P.local_variance(pixels(spark, sf_dir)).withColumnRenamed("perceptual_scale", "scale")


@query(
    "minmax_normalise", "frame:i idx:i value:f",
    "select frame, idx, case when hi > lo then (v - lo) / (hi - lo) else 0.0 end as value from gray join (select frame, min(v) as lo, max(v) as hi from gray group by frame) using (frame)", "gray",
)
def minmax_normalise(spark, sf_dir):
    own = pixels(spark, sf_dir).withColumn("v", C.mean_gray(*P.rgb()))
    ends = own.groupBy("video", "frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return own.join(ends, ["video", "frame"]).withColumn("value", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))


_CENTRES = ((16, 16, 16), (40, 120, 200), (128, 128, 128), (200, 60, 40), (224, 224, 0), (250, 250, 250))


@query(
    "palette_from_centroids", "position:i color:i name:s",
    f"""c(k, r, g, b) as (values {", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(_CENTRES))}),
best as (select c.k, min(((c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2)::bigint * 128 + p.color) % 128 as color from c cross join pal p where p.palette = 'full' group by c.k)
===
select row_number() over (order by k) - 1 as position, color, name from (select color, min(k) as k from best group by color) join pal using (color) where palette = 'full'""", "pal",
)
def palette_from_centroids(spark, sf_dir):
    """The entries nearest to cluster centres, each once, in the centres' order."""
    centres = spark.createDataFrame([(i, *c) for i, c in enumerate(_CENTRES)], "k int, r int, g int, b int")
    chosen = centres.withColumn("color", nearest_rgb(F.col("r"), F.col("g"), F.col("b"))).groupBy("color").agg(F.min("k").alias("k"))
    ranked = chosen.join(F.broadcast(palette(spark, "full").select("color", "name")), "color").orderBy("k")
    return ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "color", "name"))).alias("s")).select(F.posexplode("s").alias("position", "s")).select("position", "s.color", "s.name")


@query(
    "palette_fill_remaining", "position:i color:i",
    "taken(k, color) as (values (0, 3), (1, 17), (2, 30))\n===\nselect row_number() over (order by first, k, color) - 1 as position, color from (select 0 as first, k, color from taken union all select 1, 0, color from pal where palette = 'full' and color not in (select color from taken)) order by first, k, color limit 20", "pal",
)
def palette_fill_remaining(spark, sf_dir):
    """Chosen entries filled up to 20 with the palette's others in their order: the size is the feature."""
    taken = spark.createDataFrame([(0, 3), (1, 17), (2, 30)], "k int, color int")
    rest = palette(spark, "full").select("color").join(F.broadcast(taken), "color", "left_anti").select(F.lit(1).alias("first"), F.lit(0).alias("k"), "color")
    listed = taken.select(F.lit(0).alias("first"), "k", "color").unionByName(rest)
    ordered = listed.groupBy().agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "k", "color"))), 1, 20).alias("s"))
    return ordered.select(F.posexplode("s").alias("position", "s")).select("position", "s.color")


_POINTS = "pts as (select r, g, b, count(*) as n from px where frame % 10 = 0 and frame < 300 group by r, g, b), cen as (select row_number() over (order by r, g, b) - 1 as k, r, g, b from (select r, g, b from pts order by r, g, b limit 16)), asg as (select r, g, b, n, k from (select pts.*, cen.k, row_number() over (partition by pts.r, pts.g, pts.b order by (pts.r - cen.r) ** 2 + (pts.g - cen.g) ** 2 + (pts.b - cen.b) ** 2, cen.k) as rn from pts cross join cen) where rn = 1)"


@query("kmeans_assign", "r:i g:i b:i n:i k:i", _POINTS + "\n===\nselect * from asg", "px")
def kmeans_assign(spark, sf_dir):
    points = kernels.distinct_points(pixels(spark, sf_dir))
    return kernels.kmeans_assign(points, kernels.first_centroids(points, 16))


@query("kmeans_update", "k:i r:f g:f b:f n:i", _POINTS + "\n===\nselect k, sum(r * n) / sum(n)::double as r, sum(g * n) / sum(n)::double as g, sum(b * n) / sum(n)::double as b, sum(n) as n from asg group by k", "px")
def kmeans_update(spark, sf_dir):
    return kernels.kmeans_update(kmeans_assign(spark, sf_dir))


def _rounds_sql(n: int) -> str:
    """Lloyd's rounds one after the other; once no centre moves by more than 0.01 they stay."""
    out = [_POINTS.partition(", asg as")[0], "c0 as (select k, r::double as r, g::double as g, b::double as b, false as done from cen)"]
    for i in range(n):
        far = "round((p.r - c.r) ** 2 + (p.g - c.g) ** 2 + (p.b - c.b) ** 2, 9)"
        out.append(f"a{i} as (select r, g, b, n, k from (select p.*, c.k, row_number() over (partition by p.r, p.g, p.b order by {far}, c.k) as rn from pts p cross join c{i} c) where rn = 1)")
        out.append(f"m{i} as (select k, sum(r * n) / sum(n)::double as r, sum(g * n) / sum(n)::double as g, sum(b * n) / sum(n)::double as b from a{i} group by k)")
        new = ", ".join(f"case when c.done then c.{x} else coalesce(m.{x}, c.{x}) end as {x}" for x in "rgb")
        moved = " or ".join(f"abs(coalesce(m.{x}, c.{x}) - c.{x}) > 0.01" for x in "rgb")
        out.append(f"c{i + 1} as (select c.k, {new}, c.done or not bool_or({moved}) over () as done from c{i} c left join m{i} m using (k))")
    return ",\n".join(out)


@query(
    "auto_palette", "position:i color:i",
    _rounds_sql(10) + """,
near as (select color, min(k) as k from (select c.k, p.color, row_number() over (partition by c.k order by round((c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2, 6), p.color) as rn from c10 c cross join pal p where p.palette = 'full') where rn = 1 group by color)
===
select row_number() over (order by first, k, color) - 1 as position, color from (select 0 as first, k, color from near union all select 1, 0, color from pal where palette = 'full' and color not in (select color from near)) order by first, k, color limit 24""", "px pal",
)
def auto_palette(spark, sf_dir):
    """Entries nearest to the final k-means centres, each once, filled up to 24."""
    centres = kernels.kmeans(pixels(spark, sf_dir), 16)
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "k int, r double, g double, b double")
    near = rows.withColumn("color", nearest_center(F.col("r"), F.col("g"), F.col("b"))).groupBy("color").agg(F.min("k").alias("k")).select(F.lit(0).alias("first"), "k", "color")
    rest = palette(spark, "full").select("color").join(F.broadcast(near), "color", "left_anti").select(F.lit(1).alias("first"), F.lit(0).alias("k"), "color")
    ordered = near.unionByName(rest).groupBy().agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "k", "color"))), 1, 24).alias("s"))
    return ordered.select(F.posexplode("s").alias("position", "s")).select("position", "s.color")


_RATIOS = "ratios as (select frame, avg(case when pooled > 5.0 then 1.0 else 0.0 end) as ratio from moved group by frame)"


def _pooled(spark, sf_dir):
    own = T.with_previous(pixels(spark, sf_dir), ["r", "g", "b"])
    moved = sum((F.abs(F.col(c) - F.col(f"{c}_before")) for c in "gb"), F.abs(F.col("r") - F.col("r_before"))) / 3.0
    return P.avg_pool(own.withColumn("moved", moved), "moved", "pooled")


@query(
    "scene_class", "frame:i ratio:f rdo:f me:f budget:f weight:f",
    _RATIOS + "\n===\nselect frame, ratio, case when ratio < 0.01 then 40 when ratio < 0.05 then 25 when ratio < 0.2 then 15 when ratio < 0.5 then 8 else 0 end as rdo, case when ratio < 0.01 then 3 when ratio < 0.05 then 5 when ratio < 0.2 then 7 when ratio < 0.5 then 10 else 0 end as me, case when ratio < 0.01 then 0.05 when ratio < 0.05 then 0.1 when ratio < 0.2 then 0.2 when ratio < 0.5 then 0.35 else 1.0 end as budget, case when ratio < 0.01 then 0.2 when ratio < 0.05 then 0.4 when ratio < 0.2 then 0.5 when ratio < 0.5 then 0.6 else 0.8 end as weight from ratios", "moved",
)
def scene_class(spark, sf_dir):
    ratios = _pooled(spark, sf_dir).groupBy("video", "frame").agg(F.avg((F.col("pooled") > 5.0).cast("int")).alias("ratio"))
    return ratios.withColumn("c", kernels.scene_class(F.col("ratio"))).select("frame", "ratio", "c.rdo", "c.me", "c.budget", "c.weight")


@query("me_mask", "frame:i idx:i still:b", _RATIOS + "\n===\nselect frame, idx, round(pooled, 9) < (case when ratio < 0.01 then 3 when ratio < 0.05 then 5 when ratio < 0.2 then 7 when ratio < 0.5 then 10 else 0 end) as still from moved join ratios using (frame)", "moved")
def me_mask(spark, sf_dir):
    own = _pooled(spark, sf_dir)
    ratios = own.groupBy("video", "frame").agg(F.avg((F.col("pooled") > 5.0).cast("int")).alias("ratio"))
    return own.join(ratios, ["video", "frame"]).withColumn("still", F.round("pooled", 9) < kernels.scene_class(F.col("ratio"))["me"])


@query(
    "rdo_mask", "frame:i idx:i far:f close:b",
    f"""labs as (select frame, idx, {_L} as l, {_A} as a, {_B} as bb from px), inks as (select color, {_PL} as l, {_PA} as a, {_PB} as bb from pal where palette = 'full'),
olds as (select i.frame + 1 as frame, i.idx, l as pl, a as pa, bb as pb from ix i join inks using (color)),
fars as (select frame, idx, round(sqrt((l - pl) ** 2 + (a - pa) ** 2 + (bb - pb) ** 2), 9) as far from labs join olds using (frame, idx))
===
select frame, idx, far, far < round(15.0::double / 255.0 * (1.0 + 2.0 * (1.0 - least(1.0, greatest(0.0, variance / 500.0)))), 9) as close from fars join vars using (frame, idx)""", "px pal ix vars",
)
def rdo_mask(spark, sf_dir):
    """Pixels whose colour is near enough, in OkLab, to the entry shown before: the middle scene class's threshold."""
    px = P.local_variance(pixels(spark, sf_dir)).withColumn("ok", C.oklab(*P.rgb()))
    ink = F.create_map(*[x for i, _, _, r, g, b in PALETTES["full"] for x in (F.lit(i), F.array(*map(F.lit, C.oklab_of((r, g, b)))))])
    old = indexed(spark, sf_dir).select("video", (F.col("frame") + 1).alias("frame"), "idx", F.element_at(ink, F.col("color")).alias("ink"))
    own = px.join(old, ["video", "frame", "idx"])
    far = sum(((F.col("ok")[n] - F.col("ink")[i]) * (F.col("ok")[n] - F.col("ink")[i]) for i, n in ((1, "a"), (2, "b"))), (F.col("ok")["L"] - F.col("ink")[0]) * (F.col("ok")["L"] - F.col("ink")[0]))
    own = own.withColumn("far", F.round(F.sqrt(far), 9))
    return own.withColumn("close", F.col("far") < F.round(F.lit(15.0) / 255.0 * F.col("perceptual_scale"), 9))


@query(
    "topk_budget", "frame:i idx:i importance:i",
    "imp as (select a.frame, a.idx, abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) as importance from px a join px b on a.idx = b.idx and a.frame = b.frame + 1)\n===\nselect frame, idx, importance from (select *, row_number() over (partition by frame order by importance desc, idx) as rn, count(*) over (partition by frame) as n from imp) where rn <= n * 20 // 100", "px",
)
def topk_budget(spark, sf_dir):
    """The fifth of each frame's pixels that changed most; equal ones by place."""
    from pyspark.sql import Window

    own = T.with_previous(pixels(spark, sf_dir), ["r", "g", "b"])
    own = own.withColumn("importance", sum((F.abs(F.col(c) - F.col(f"{c}_before")) for c in "gb"), F.abs(F.col("r") - F.col("r_before"))))
    frame = Window.partitionBy("video", "frame")
    ranked = own.withColumn("rn", F.row_number().over(frame.orderBy(F.desc("importance"), "idx"))).withColumn("n", F.count("*").over(frame))
    return ranked.where(F.col("rn") <= F.floor(F.col("n") * 20 / 100))


_NAMES = "regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g')"


@query("slug_dedupe", "p_partkey:i slug:s", f"select p_partkey, case when rn = 1 then slug else slug || '_' || rn end as slug from (select p_partkey, {_NAMES} as slug, row_number() over (partition by {_NAMES} order by p_partkey) as rn from part)")
def slug_dedupe(spark, sf_dir):
    """Names as identifiers; equal ones get _2, _3 and so on in key order."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9_]", "_").alias("slug"))
    rn = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return own.withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", "rn")).alias("slug"))


_PRESETS = (("light", 64, 64, 1), ("standard", 96, 96, 2), ("high", 128, 128, 2), ("fine", 128, 128, 4), ("ultra", 256, 256, 4), ("extreme", 512, 512, 10))


@query("presets_fps", "preset:s width:i height:i tick_interval:i fps:f", f"p(preset, width, height, tick_interval) as (values {', '.join(map(str, _PRESETS))})\n===\nselect *, 20.0 / tick_interval as fps from p")
def presets_fps(spark, sf_dir):
    return spark.createDataFrame(list(_PRESETS), "preset string, width int, height int, tick_interval int").withColumn("fps", 20.0 / F.col("tick_interval"))
