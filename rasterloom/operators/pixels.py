"""Row-local and neighbourhood operators over pixel rows (video, frame, idx, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import color as C
from ..functions.palette import ALIASES, FALLBACK, NAMESPACE, palette_rows
from ..sources.tables import nearest_rgb

RGB = ("r", "g", "b")


def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def every_nth(px: DataFrame, source_fps: float, fps: float) -> DataFrame:
    """Each max(1, round(source_fps / fps))-th frame."""
    return px.where(F.col("frame") % max(1, round(source_fps / fps)) == 0)


def first_seconds(px: DataFrame, seconds: float, fps: float) -> DataFrame:
    return px.where(F.col("frame") < int(seconds * fps))


def subsample(px: DataFrame, step: int = 8) -> DataFrame:
    return px.where((F.col("x") % step == 0) & (F.col("y") % step == 0))


def upscale(px: DataFrame, width: int, factor: int = 4) -> DataFrame:
    """Each pixel as factor x factor pixels of the wider frame."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))
    wide = px.withColumn("s", steps)
    x, y = F.col("x") * factor + F.col("s") % factor, F.col("y") * factor + F.floor(F.col("s") / factor).cast("int")
    return wide.select("video", "frame", (y * width * factor + x).alias("idx"), *RGB)


def with_bias(px: DataFrame, bias: Column) -> DataFrame:
    """Channels plus a bias, clipped to 0..255, taken to six digits and cut to whole numbers.

    Six digits by arithmetic: round() would go through decimals of any size for each value.
    """
    return px.withColumns({c: F.floor(F.floor(C.clamp(F.col(c) + bias, 0.0, 255.0) * 1e6 + 0.5) / 1e6).cast("int") for c in RGB})


def dither_ordered(px: DataFrame) -> DataFrame:
    return with_bias(px, C.bayer_bias(F.col("x"), F.col("y")))


def dither_ordered_perceptual(px: DataFrame) -> DataFrame:
    """Ordered bias times the mask, so that edges stay sharp."""
    return with_bias(sobel_mask(px), C.bayer_bias(F.col("x"), F.col("y")) * F.col("mask"))


def dither_blue_noise(px: DataFrame, width: int, height: int, spread: float = 64.0) -> DataFrame:
    table = F.array(*map(F.lit, C.blue_noise(width, height)))
    return with_bias(px, (F.element_at(table, F.col("y") * width + F.col("x") + 1) - 0.5) * spread)


def quantize_oklab(px: DataFrame, name: str = "full") -> DataFrame:
    """Adds color: the entry nearest in OkLab, to twelve digits of the squared distance, the first of equals.

    The palette is literals and the pixel's colour is computed once. A distance in units of 1e-12, times 128, plus the entry's
    number is a whole number of less than 50 bits, so the least of them names the entry.
    """
    own = px.withColumn("_ok", C.oklab(*rgb())).withColumns({f"_{n}": F.col("_ok")[n] for n in "Lab"})

    def rank(color: int, ink: tuple[float, float, float]) -> Column:
        parts = [(F.col(f"_{n}") - v) * (F.col(f"_{n}") - v) for n, v in zip("Lab", ink, strict=True)]
        return F.floor((parts[0] + parts[1] + parts[2]) * 1e12 + 0.5) * 128 + color

    ranks = [rank(row[0], C.oklab_of(row[3:])) for row in palette_rows(name)]
    return own.withColumn("color", (F.least(*ranks) % 128).cast("int")).drop("_ok", "_L", "_a", "_b")


def quantize_rgb(px: DataFrame, name: str = "full") -> DataFrame:
    return px.withColumn("color", nearest_rgb(*rgb(), name))


def decode(ix: DataFrame, palette: DataFrame) -> DataFrame:
    """Palette indices as channels; an index that the palette lacks is black."""
    found = ix.join(F.broadcast(palette.select("color", *RGB)), "color", "left")
    return found.select("video", "frame", "idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in RGB])


def block_ids(levels: DataFrame, known: list[str]) -> DataFrame:
    """Adds resolved: the block after its alias, or the fallback where it isn't known."""
    alias = F.coalesce(*[F.when(F.col("block") == NAMESPACE + a, NAMESPACE + b) for a, b in ALIASES.items()], F.col("block"))
    return levels.withColumn("resolved", F.when(alias.isin(known), alias).otherwise(NAMESPACE + FALLBACK))


def by_frame(px: DataFrame) -> DataFrame:
    """One shuffle that all windows within a frame share."""
    return px.repartition("video", "frame")


def along_row() -> WindowSpec:
    return Window.partitionBy("video", "frame", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("video", "frame", "x").orderBy("y")


def box3(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over 3x3 neighbourhoods, nothing beyond the border, as <column>_box: a row pass and a column pass."""
    near = [w.rowsBetween(-1, 1) for w in (along_row(), along_column())]
    out = by_frame(df).withColumns({f"{c}_box": F.sum(c).over(near[0]) for c in columns})
    return out.withColumns({f"{c}_box": F.sum(f"{c}_box").over(near[1]) for c in columns})


def avg_pool(df: DataFrame, column: str, out: str) -> DataFrame:
    """The 3x3 box sum over nine, at the border too."""
    return box3(df, [column]).withColumn(out, F.col(f"{column}_box") / 9.0).drop(f"{column}_box")


def local_variance(px: DataFrame) -> DataFrame:
    """Adds variance of mean grey in 3x3 boxes, and perceptual_scale, 3 where flat to 1 at edges."""
    own = px.withColumn("gray", C.mean_gray(*rgb())).withColumn("square", F.col("gray") * F.col("gray"))
    own = box3(own, ["gray", "square"])
    mean = F.col("gray_box") / 9.0
    own = own.withColumn("variance", F.greatest(F.col("square_box") / 9.0 - mean * mean, F.lit(0.0)))
    return own.withColumn("perceptual_scale", 1.0 + 2.0 * (1.0 - C.clamp(F.col("variance") / 500.0, 0.0, 1.0)))


def gradient(px: DataFrame) -> DataFrame:
    """Adds edge: the length of the gradient of mean grey, central inside, one-sided at borders."""
    own = by_frame(px).withColumn("gray", C.mean_gray(*rgb()))

    def slope(w) -> Column:
        a, b, here = F.lag("gray").over(w), F.lead("gray").over(w), F.col("gray")
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - here).when(b.isNull(), here - a).otherwise((b - a) / 2.0)

    own = own.withColumns({"gx": slope(along_row())}).withColumns({"gy": slope(along_column())})
    return own.withColumn("edge", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).drop("gx", "gy")


def find_edges_mask(px: DataFrame) -> DataFrame:
    """Adds mask: 1 minus the edges of whole-number luma - nine times the pixel minus its 3x3 box, within 0..255, a border pixel
    as it is - blurred by 1 2 1 both ways with borders repeated, as a share of the frame's largest."""
    gray = F.shiftright(F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768, 16)
    own = box3(px.withColumn("_g", gray).withColumn("_one", F.lit(1)), ["_g", "_one"])
    own = own.withColumn("_e", F.when(F.col("_one_box") < 9, F.col("_g")).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.col("_g") * 9 - F.col("_g_box")))))

    def blur(c: str, w) -> Column:
        return F.coalesce(F.lag(c).over(w), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))

    own = own.withColumn("_e", blur("_e", along_row())).withColumn("_e", blur("_e", along_column()) / 16.0 / 255.0)
    own = own.withColumn("_top", F.max("_e").over(Window.partitionBy("video", "frame")))
    share = F.when(F.col("_top") > 0, F.col("_e") / F.col("_top")).otherwise(F.col("_e"))
    return own.withColumn("mask", C.clamp(1.0 - share, 0.0, 1.0)).drop("_g", "_one", "_g_box", "_one_box", "_e", "_top")


def sobel_mask(px: DataFrame) -> DataFrame:
    """Adds mask: 1 minus half the Sobel magnitude of luma, within 0..1; zero padding."""
    own = by_frame(px).withColumn("luma", C.luma(*rgb()))

    def near(c: str, w, k: int) -> Column:
        return F.coalesce((F.lag(c) if k < 0 else F.lead(c)).over(w), F.lit(0.0))

    own = own.withColumns({"dx": near("luma", along_row(), 1) - near("luma", along_row(), -1), "sx": near("luma", along_row(), -1) + 2 * F.col("luma") + near("luma", along_row(), 1)})
    own = own.withColumns({"gx": near("dx", along_column(), -1) + 2 * F.col("dx") + near("dx", along_column(), 1), "gy": near("sx", along_column(), 1) - near("sx", along_column(), -1)})
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return own.withColumn("mask", 1.0 - C.clamp(size / 2.0, 0.0, 1.0)).drop("luma", "dx", "sx", "gx", "gy")
