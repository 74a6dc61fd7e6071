"""Series masking (N6): rescale a daily metric so that its level is hidden
but its trend and seasonality survive, then replace the lowest values by a
PCHIP interpolation and round to tens.

Per series: factor linear from ``scale[0]`` at the 2nd-lowest value to
``scale[1]`` at the highest (clamped), times sin((pi/2)^0.2), times keyed
Gaussian noise N(1, 0.31); values at or under the 15 % quantile (linear) are
dropped and interpolated; the result is rounded half-even to tens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import numeric as M
from tillroll.functions.pseudonym import keyed_gaussian
from tillroll.operators.interpolate import pchip_fill
from tillroll.operators.reports import second_smallest_and_largest

SERIES_NOISE_SD = 0.31
LOW_QUANTILE = 0.15


def mask_series(df: DataFrame, series_cols: Sequence[str], order_col: str, metric: str,
                scale: tuple[float, float], seed: int, out_col: str | None = None,
                noise_sd: float = SERIES_NOISE_SD, low_quantile: float = LOW_QUANTILE,
                extrapolate: bool = True) -> DataFrame:
    s = list(series_cols)
    out_col = out_col or f"new_{metric}"
    # one row per series: bounded by the number of series
    bounds = second_smallest_and_largest(df, s, metric, "_lo", "_hi") if s else \
        second_smallest_and_largest(df, [], metric, "_lo", "_hi")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in s], F.col(order_col).cast("string"))
    noise = F.lit(1.0) + F.lit(noise_sd) * keyed_gaussian(key, seed, "series")
    factor = M.clamp_interp(F.col(metric).cast("double"), "_lo", "_hi",
                            F.lit(float(scale[0])), F.lit(float(scale[1])))
    # per-series frames: no hint (AQE broadcasts them when measured small)
    if s:
        joined = df.join(bounds, s, "left")
    else:
        joined = df.withColumn("_all", F.lit(0)).join(
            F.broadcast(bounds.withColumn("_all", F.lit(0))), "_all", "left").drop("_all")
    raw = joined.withColumn(
        "_new", F.col(metric).cast("double") * (factor * F.lit(M.SERIES_SIN_FACTOR) * noise))
    # exact quantile per series: a series has one value per day (bounded)
    q = raw.groupBy(*s).agg(F.percentile("_new", low_quantile).alias("_q")) if s else \
        raw.agg(F.percentile("_new", low_quantile).alias("_q"))
    if s:
        raw = raw.join(q, s, "left")
    else:
        raw = raw.withColumn("_all", F.lit(0)).join(
            F.broadcast(q.withColumn("_all", F.lit(0))), "_all", "left").drop("_all")
    low = raw.withColumn("_new", F.when(~(F.col("_new") <= F.col("_q")), F.col("_new")))
    filled = pchip_fill(low, s, order_col, "_new", "_filled", extrapolate=extrapolate)
    out = filled.withColumn(out_col, M.round_half_even("_filled", -1).cast("int"))
    return out.drop("_new", "_filled", "_q", "_lo", "_hi", metric)
