"""Colour arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bayer 4x4 thresholds, fixed values, row by row
BAYER = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
# OkLab matrices, fixed values: linear RGB to cone responses, their cube roots to L, a, b
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
# sRGB to CIE XYZ and the D65 white point, fixed values
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Weighted grey of 0..255 channels, 0..1."""
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255.0


def mean_gray(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0


def linear(channel: Column) -> Column:
    """Linear light of a 0..255 sRGB channel."""
    c = channel / 255.0
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def _times(row: tuple[float, ...], values: list[Column]) -> Column:
    return sum((v * F.lit(k) for k, v in zip(row[1:], values[1:], strict=True)), values[0] * F.lit(row[0]))


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct<L, a, b> of doubles."""
    cones = [_times(row, [linear(r), linear(g), linear(b)]) for row in TO_CONES]
    roots = [F.signum(c) * F.pow(F.abs(c), F.lit(1.0 / 3.0)) for c in cones]
    return F.struct(*[_times(row, roots).alias(n) for row, n in zip(TO_LAB, ("L", "a", "b"), strict=True)])


def oklab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """The same for one colour, on the driver."""
    light = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in rgb]
    cones = [sum(k * v for k, v in zip(row, light, strict=True)) for row in TO_CONES]
    roots = [(1 if c > 0 else -1 if c < 0 else 0) * abs(c) ** (1 / 3) for c in cones]
    return tuple(sum(k * v for k, v in zip(row, roots, strict=True)) for row in TO_LAB)


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE L*a*b* of sRGB under D65: struct<L, a, b>."""

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)

    x, y, z = (f(_times(row, [linear(r), linear(g), linear(b)]) / w) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return F.struct((116.0 * y - 16.0).alias("L"), (500.0 * (x - y)).alias("a"), (200.0 * (y - z)).alias("b"))


def with_delta_e2000(df: DataFrame, p: str, q: str, out: str = "delta_e") -> DataFrame:
    """Adds the CIEDE2000 difference of two lab struct columns. In steps, so that no term is written out many times."""
    keep = df.columns
    c = F.col
    l1, a1, b1, l2, a2, b2 = (c(x)[n] for x in (p, q) for n in ("L", "a", "b"))
    df = df.withColumn("_m", F.pow((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2, F.lit(7.0)))
    df = df.withColumn("_g", 1 + 0.5 * (1 - F.sqrt(c("_m") / (c("_m") + 25.0**7))))
    df = df.withColumns({"_c1": F.sqrt(a1 * c("_g") * a1 * c("_g") + b1 * b1), "_c2": F.sqrt(a2 * c("_g") * a2 * c("_g") + b2 * b2), "_h1": F.degrees(F.atan2(b1, a1 * c("_g"))), "_h2": F.degrees(F.atan2(b2, a2 * c("_g")))})
    df = df.withColumns({n: F.when(c(n) < 0, c(n) + 360).otherwise(c(n)) for n in ("_h1", "_h2")}).withColumn("_gray", c("_c1") * c("_c2") == 0)
    turn = c("_h2") - c("_h1")
    total = c("_h1") + c("_h2")
    df = df.withColumns(
        {
            "_turn": F.when(c("_gray"), 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360),
            "_hm": F.when(c("_gray"), total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2),
            "_lm": (l1 + l2) / 2 - 50,
            "_cm": (c("_c1") + c("_c2")) / 2,
        }
    )
    hm, cm = c("_hm"), c("_cm")
    df = df.withColumns(
        {
            "_t": 1 - 0.17 * F.cos(F.radians(hm - 30)) + 0.24 * F.cos(F.radians(2 * hm)) + 0.32 * F.cos(F.radians(3 * hm + 6)) - 0.20 * F.cos(F.radians(4 * hm - 63)),
            "_p7": F.pow(cm, F.lit(7.0)),
            "_bend": 60 * F.exp(-((hm - 275) / 25) * ((hm - 275) / 25)),
        }
    )
    df = df.withColumns(
        {
            "_dl": (l2 - l1) / (1 + 0.015 * c("_lm") * c("_lm") / F.sqrt(20 + c("_lm") * c("_lm"))),
            "_dc": (c("_c2") - c("_c1")) / (1 + 0.045 * cm),
            "_dh": 2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_turn") / 2)) / (1 + 0.015 * cm * c("_t")),
            "_rt": -F.sin(F.radians(c("_bend"))) * 2 * F.sqrt(c("_p7") / (c("_p7") + 25.0**7)),
        }
    )
    return df.withColumn(out, F.sqrt(c("_dl") * c("_dl") + c("_dc") * c("_dc") + c("_dh") * c("_dh") + c("_rt") * c("_dc") * c("_dh"))).select(*keep, out)


def bayer_bias(x: Column, y: Column, spread: float = 32.0) -> Column:
    """The ordered-dither bias of a pixel, tiled 4 by 4."""
    return (F.element_at(F.array(*map(F.lit, BAYER)), (y % 4) * 4 + x % 4 + 1) / 16.0 - 0.5) * spread


def blue_noise(width: int, height: int, seed: int = 42, sigma: float = 1.5) -> list[float]:
    """A high-pass noise table in 0..1, row by row: seeded bytes minus their Gaussian blur, stretched. Six digits."""
    import numpy as np

    noise = np.random.default_rng(seed).integers(0, 256, (height, width)).astype(float)
    reach = np.arange(-5, 6)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    blur = noise
    for axis in (0, 1):
        at = np.clip(np.arange(blur.shape[axis])[:, None] + reach, 0, blur.shape[axis] - 1)
        blur = np.moveaxis(np.einsum("pkj,k->pj", np.moveaxis(blur, axis, 0)[at], kernel), 0, axis)
    high = noise - blur
    span = high.max() - high.min()
    return [round(float(v), 6) for v in ((high - high.min()) / span if span else np.zeros_like(high)).ravel()]
