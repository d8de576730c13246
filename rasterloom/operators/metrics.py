"""Quality measures between two versions of the same frames, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C

C1, C2 = 6.5025, 58.5225  # (0.01 * 255)^2 and (0.03 * 255)^2, fixed values


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pixels of both, r1 g1 b1 r2 g2 b2; frames past the shorter one have no partner and go."""
    a = first.select("video", "frame", "idx", *[F.col(c).alias(f"{c}1") for c in "rgb"])
    b = second.select("video", "frame", "idx", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return a.join(b, ["video", "frame", "idx"])


def channels(pairs: DataFrame) -> DataFrame:
    """A row for each channel value: video, frame, a, b."""
    return pairs.select("video", "frame", F.inline(F.array(*[F.struct(F.col(f"{c}1").cast("double").alias("a"), F.col(f"{c}2").cast("double").alias("b")) for c in "rgb"])))


def psnr(pairs: DataFrame, perfect: float = 100.0) -> DataFrame:
    mse = F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    return channels(pairs).groupBy("video", "frame").agg(F.when(mse == 0, perfect).otherwise(20.0 * F.log10(255.0 / F.sqrt(mse))).alias("psnr"))


def ssim_of(ma: Column, mb: Column, va: Column, vb: Column, cov: Column) -> Column:
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def ssim(pairs: DataFrame) -> DataFrame:
    """Global SSIM of mean grey: population variances with the sample covariance."""
    gray = pairs.select("video", "frame", C.mean_gray(*[F.col(f"{c}1") for c in "rgb"]).alias("a"), C.mean_gray(*[F.col(f"{c}2") for c in "rgb"]).alias("b"))
    stats = gray.groupBy("video", "frame").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_samp("a", "b").alias("cov"))
    return stats.select("video", "frame", ssim_of(*map(F.col, ("ma", "mb", "va", "vb", "cov"))).alias("ssim"))


def ssim_sampled(pairs: DataFrame, step: int = 10, most: int = 50) -> DataFrame:
    """The mean over each step-th frame, the first `most` of them: the limit is the measure's own."""
    taken = pairs.where((F.col("frame") % step == 0) & (F.col("frame") < step * most))
    return ssim(taken).groupBy("video").agg(F.avg("ssim").alias("ssim"), F.count("*").alias("n_frames"))


def delta_e(pairs: DataFrame) -> DataFrame:
    """Mean CIEDE2000 of each frame."""
    labs = pairs.select("video", "frame", C.lab(*[F.col(f"{c}1") for c in "rgb"]).alias("p"), C.lab(*[F.col(f"{c}2") for c in "rgb"]).alias("q"))
    return C.with_delta_e2000(labs, "p", "q").groupBy("video", "frame").agg(F.avg("delta_e").alias("delta_e"))


def report(values: DataFrame) -> DataFrame:
    """(metric, value) lines of a wide one-row table; a missing or not-a-number value is shown as nan."""
    lines = [F.struct(F.lit(c).alias("metric"), F.when(F.col(c).isNull() | F.isnan(c), "nan").otherwise(F.format_string("%.4f", c)).alias("value")) for c in values.columns]
    return values.select(F.inline(F.array(*lines)))


def gate(measures: DataFrame, least_ssim: float = 0.85, most_delta_e: float = 3.0) -> DataFrame:
    """Adds passed: both thresholds hold."""
    return measures.withColumn("passed", (F.col("ssim") >= least_ssim) & (F.col("delta_e") <= most_delta_e))


def ssim_windows(pairs: DataFrame, width: int, window: int = 7, data_range: float = 255.0) -> DataFrame:
    """Mean over channels of SSIM in whole window x window neighbourhoods, sample statistics. A frame is a group."""
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        n, c1, c2 = window * window, (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
        values = []
        for c in "rgb":
            a, b = (np.lib.stride_tricks.sliding_window_view(frame[f"{c}{i}"].to_numpy(float).reshape(-1, width), (window, window)).reshape(-1, n) for i in (1, 2))
            ma, mb = a.mean(axis=1), b.mean(axis=1)
            va, vb, cov = a.var(axis=1, ddof=1), b.var(axis=1, ddof=1), ((a - ma[:, None]) * (b - mb[:, None])).sum(axis=1) / (n - 1)
            values.append((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())
        return pd.DataFrame({"video": frame["video"].iloc[:1], "frame": frame["frame"].iloc[:1], "ssim": [float(np.mean(values))]})

    return pairs.groupBy("video", "frame").applyInPandas(run, "video string, frame int, ssim double")
