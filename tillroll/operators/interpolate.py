"""Shape-preserving piecewise cubic (PCHIP, Fritsch–Carlson) filling of nulls.

x is the row position inside the series (0, 1, 2, ... by ``order_col``), y the
value.  Derivatives at the known points follow the usual PCHIP rules
(weighted harmonic mean inside, three-point one-sided formula with the
monotonicity fixes at the ends, linear when only two points are known).
Nulls before the first known point stay null; those after the last one are
extrapolated unless ``extrapolate`` is false.

Windows are partitioned by series: one row per series and day, so a
partition is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    d = ((F.lit(2.0) * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (F.when(F.signum(d) != F.signum(m0), F.lit(0.0))
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > F.lit(3.0) * F.abs(m0)),
                  F.lit(3.0) * m0)
            .otherwise(d))


def pchip_fill(df: DataFrame, series_cols: Sequence[str], order_col: str, value_col: str,
               out_col: str, extrapolate: bool = True) -> DataFrame:
    s = list(series_cols)
    w = Window.partitionBy(*s).orderBy(order_col)
    base = df.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    y = F.col(value_col).cast("double")
    known = base.filter(F.col(value_col).isNotNull()).select(*s, "_x", y.alias("_y"))
    wk = Window.partitionBy(*s).orderBy("_x")
    wall = Window.partitionBy(*s)
    known = known.select(
        "*",
        F.lag("_x", 1).over(wk).alias("_xp1"), F.lag("_y", 1).over(wk).alias("_yp1"),
        F.lag("_x", 2).over(wk).alias("_xp2"), F.lag("_y", 2).over(wk).alias("_yp2"),
        F.lead("_x", 1).over(wk).alias("_xn1"), F.lead("_y", 1).over(wk).alias("_yn1"),
        F.lead("_x", 2).over(wk).alias("_xn2"), F.lead("_y", 2).over(wk).alias("_yn2"),
        F.count(F.lit(1)).over(wall).alias("_nk"),
    )
    hp = F.col("_x") - F.col("_xp1")
    hn = F.col("_xn1") - F.col("_x")
    mp = (F.col("_y") - F.col("_yp1")) / hp
    mn = (F.col("_yn1") - F.col("_y")) / hn
    w1 = F.lit(2.0) * hn + hp
    w2 = hn + F.lit(2.0) * hp
    interior = (F.when((F.signum(mp) != F.signum(mn)) | (mp == 0) | (mn == 0), F.lit(0.0))
                .otherwise((w1 + w2) / (w1 / mp + w2 / mn)))
    first = _edge(hn, F.col("_xn2") - F.col("_xn1"), mn,
                  (F.col("_yn2") - F.col("_yn1")) / (F.col("_xn2") - F.col("_xn1")))
    last = _edge(hp, F.col("_xp1") - F.col("_xp2"), mp,
                 (F.col("_yp1") - F.col("_yp2")) / (F.col("_xp1") - F.col("_xp2")))
    deriv = (F.when(F.col("_nk") < 2, F.lit(0.0))
             .when(F.col("_nk") == 2, F.coalesce(mn, mp))
             .when(F.col("_xp1").isNull(), first)
             .when(F.col("_xn1").isNull(), last)
             .otherwise(interior))
    knots = known.select(*s, "_x", F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"),
                                            deriv.alias("d")).alias("_knot"))
    # each knot also carries the previous knot (the interval used past the end)
    knots = knots.withColumn("_knot_prev", F.lag("_knot", 1).over(wk))
    joined = base.join(knots, [*s, "_x"], "left")
    wf = Window.partitionBy(*s).orderBy("_x")
    joined = joined.select(
        "*",
        F.last("_knot", ignorenulls=True).over(
            wf.rowsBetween(Window.unboundedPreceding, 0)).alias("_kp"),
        F.last("_knot_prev", ignorenulls=True).over(
            wf.rowsBetween(Window.unboundedPreceding, 0)).alias("_kpp"),
        F.first("_knot", ignorenulls=True).over(
            wf.rowsBetween(0, Window.unboundedFollowing)).alias("_kn"),
    )
    kp, kn, kpp = F.col("_kp"), F.col("_kn"), F.col("_kpp")
    val = _hermite(F.col("_x"), kp.x, kp.y, kp.d, kn.x, kn.y, kn.d)
    filled = (F.when(F.col(value_col).isNotNull(), y)
              .when(kp.isNotNull() & kn.isNotNull(), val))
    if extrapolate:
        ext = _hermite(F.col("_x"), kpp.x, kpp.y, kpp.d, kp.x, kp.y, kp.d)
        filled = filled.when(kn.isNull() & kpp.isNotNull(), ext)
    out = joined.withColumn(out_col, filled)
    return out.drop("_x", "_knot", "_knot_prev", "_kp", "_kpp", "_kn")


def _hermite(x: Column, xk: Column, yk: Column, dk: Column, xk1: Column, yk1: Column,
             dk1: Column) -> Column:
    """Cubic on [xk, xk1] with end values/slopes, evaluated in local
    coordinates (Horner form of the piecewise polynomial)."""
    h = xk1 - xk
    m = (yk1 - yk) / h
    c2 = (F.lit(3.0) * m - F.lit(2.0) * dk - dk1) / h
    c3 = (dk + dk1 - F.lit(2.0) * m) / (h * h)
    t = x - xk
    return ((c3 * t + c2) * t + dk) * t + yk
