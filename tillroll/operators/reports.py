"""Reporting aggregates: daily totals, rolling means, event comparison,
category summaries.

Row-level data is always aggregated first (A1) with partial + final
aggregation; the ordered windows (W1) then run on one row per day and series,
whose size is bounded by the calendar, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.dates import event_flag
from tillroll.functions.numeric import pct_change, round_half_even
from tillroll.session import materialize


def daily_total(df: DataFrame, date_col: str, value_col: str, out_col: str = "revenue_by_date",
                series_cols: Sequence[str] = ()) -> DataFrame:
    """A1: SUM(value) GROUP BY date (null dates form their own group)."""
    return (df.groupBy(*series_cols, F.col(date_col).cast("date").alias("date"))
            .agg(F.sum(value_col).alias(out_col)))


def rolling_mean(daily: DataFrame, value_col: str, rows: int = 6, out_col: str = "rolling_7day",
                 series_cols: Sequence[str] = (), order_col: str = "date",
                 digits: int | None = 0) -> DataFrame:
    """Mean over the current and ``rows`` preceding rows (by date,
    nulls last), optionally rounded half away from zero."""
    w = (Window.partitionBy(*series_cols).orderBy(F.col(order_col).asc_nulls_last())
         .rowsBetween(-rows, 0))
    m = F.avg(value_col).over(w)
    return daily.withColumn(out_col, F.round(m, digits) if digits is not None else m)


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column (half to even, binary-scaled)."""
    return df.select(*[
        round_half_even(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def event_impact(df: DataFrame, date_col: str, value_col: str, event_start: str,
                 analysis_end: str, rolling_rows: int = 6,
                 series_cols: Sequence[str] = ()) -> DataFrame:
    """Daily revenue, rolling mean, square-root scale, event flag and
    before/after means with the percentage increase."""
    s = list(series_cols)
    daily = daily_total(df, date_col, value_col, "revenue_by_date", s)
    out = rolling_mean(daily, "revenue_by_date", rolling_rows, "rolling_7day", s)
    flag = event_flag("date", event_start, analysis_end)
    out = out.select(
        *s, "date", "revenue_by_date", "rolling_7day",
        F.round(F.sqrt("revenue_by_date"), 0).alias("sqrt_revenue"),
        F.round(F.sqrt("rolling_7day"), 0).alias("sqrt_rolling"),
        F.when(flag == 1, F.round(F.sqrt("rolling_7day"), 0)).alias("sqrt_event_launching"),
        flag.alias("is_after_event"),
    )
    # One row per day and series: a series-wide window is bounded by the calendar.
    whole = Window.partitionBy(*s)
    before, after = F.col("is_after_event") == 0, F.col("is_after_event") == 1
    out = (out
           .withColumn("rbm", F.avg(F.when(before, F.col("revenue_by_date"))).over(whole))
           .withColumn("ram", F.avg(F.when(after, F.col("revenue_by_date"))).over(whole)))
    out = out.select(
        "*",
        F.when(before, F.col("rbm")).alias("raw_before_event_mean"),
        F.when(after, F.col("ram")).alias("raw_after_event_mean"),
        F.when(before, F.sqrt("rbm")).alias("sqrt_before_event_mean"),
        F.when(after, F.sqrt("ram")).alias("sqrt_after_event_mean"),
        pct_change("ram", "rbm").alias("event_increase"),
    )
    return round_numeric(out, 2)


def category_summary(df: DataFrame, group_col: str, revenue_col: str = "revenue",
                     qty_col: str = "qty", customer_col: str = "id") -> DataFrame:
    """A2: per group total / mean revenue, total quantity, distinct customers;
    null keys dropped; sorted by total revenue descending."""
    return (df.filter(F.col(group_col).isNotNull())
            .groupBy(group_col)
            .agg(F.coalesce(F.sum(revenue_col), F.lit(0.0)).alias("total_revenue"),
                 F.avg(revenue_col).alias("mean_revenue"),
                 F.coalesce(F.sum(qty_col), F.lit(0)).alias("total_quantity"),
                 F.count_distinct(customer_col).alias("cust_count"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), F.col(group_col)))


def dense_group_summary(df: DataFrame, group_cols: Sequence[str], revenue_col: str = "revenue",
                        qty_col: str = "qty", customer_col: str = "id") -> DataFrame:
    """A3: like A2 over every combination of the observed values of the keys
    (absent combinations: sums 0, mean null, distinct 0).

    The grid is the product of the keys' distinct values, which is what the
    report returns, so the product makes no row that isn't a result row; it is
    left-joined to the aggregate."""
    g = list(group_cols)
    base = df
    for c in g:
        base = base.filter(F.col(c).isNotNull())
    agg = (base.groupBy(*g)
           .agg(F.sum(revenue_col).alias("total_revenue"),
                F.avg(revenue_col).alias("mean_revenue"),
                F.sum(qty_col).alias("total_quantity"),
                F.count_distinct(customer_col).alias("cust_count")))
    domains = [df.select(c).filter(F.col(c).isNotNull()).distinct() for c in g]
    grid = reduce(lambda a, b: a.crossJoin(b), domains)
    out = grid.join(agg, g, "left")
    return out.select(
        *g,
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        "mean_revenue",
        F.coalesce("total_quantity", F.lit(0)).alias("total_quantity"),
        F.coalesce("cust_count", F.lit(0)).alias("cust_count"))


def group_sum(df: DataFrame, group_col: str, value_col: str, out_col: str = "total") -> DataFrame:
    """A4: sum by group (null keys dropped; an all-null group sums to 0)."""
    return (df.filter(F.col(group_col).isNotNull()).groupBy(group_col)
            .agg(F.coalesce(F.sum(value_col), F.lit(0.0)).alias(out_col)))


def value_counts(df: DataFrame, col: str, out_col: str = "count") -> DataFrame:
    """A5: rows per value (nulls dropped), most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(out_col))
            .orderBy(F.col(out_col).desc(), F.col(col)))


def second_smallest_and_largest(df: DataFrame, group_cols: Sequence[str], value_col: str,
                                lo_col: str = "lo", hi_col: str = "hi") -> DataFrame:
    """Per group the 2nd smallest value (ties count; the minimum when the
    group has one value) and the largest.

    ``row_number() <= 2`` is planned as a window group limit, applied before
    the shuffle as well, so at most two rows per group and partition move."""
    g = list(group_cols) or ["_all"]
    v = df.filter(F.col(value_col).isNotNull())
    if "_all" in g:
        v = v.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*g).orderBy(F.col(value_col).asc())
    two = v.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    lo = two.groupBy(*g).agg(F.max(value_col).alias(lo_col))
    hi = v.groupBy(*g).agg(F.max(value_col).alias(hi_col))
    out = lo.join(hi, g)
    return out.drop("_all")


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float, blocks: int = 256) -> DataFrame:
    """Exact quantile (linear interpolation) of each column: rows (column, n,
    mean, quantile).

    The range that holds the wanted ranks is narrowed until they are known: in a
    round, approximate quantiles cut a column's open range at up to ``blocks``
    values; the values between two cuts, and those equal to a cut, are counted
    with their smallest and largest.  A rank among equal values, or at the edge
    of its block, is known then; else its block is the next range.  A block has
    less than a hundredth of its range's rows, however the values lie, so ten
    billion values take five rounds.  The driver sees some 2 · ``blocks`` rows a
    column and round, no task holds or sorts a block.  The columns are written
    once, as every round reads them twice."""
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "quantile-values")
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")
    ).select("x.*").filter(F.col("v").isNotNull())
    shares = [i / blocks for i in range(1, blocks)]
    v, facts, found = F.col("v"), {}, {}
    ranges: dict[str, tuple[float | None, float | None, int]] = {c: (None, None, 0) for c in cols}
    while ranges:
        inside = F.lit(False)
        for c, (lo, hi, _) in ranges.items():
            own = F.col("column") == c
            inside = inside | (own if lo is None else own & (v > lo)) & (F.lit(True) if hi is None else v < hi)
        rows = values.filter(inside)
        cuts = {r["column"]: sorted(set(r["cuts"])) for r in
                rows.groupBy("column").agg(F.percentile_approx("v", shares, 10 * blocks).alias("cuts")).collect()}
        block = F.lit(0)
        for c, at in cuts.items():
            point = F.array_contains(F.lit(at), v).cast("int")
            block = F.when(F.col("column") == c, F.size(F.filter(F.lit(at), lambda x: x < v)) * 2 + point).otherwise(block)
        sizes = rows.groupBy("column", block.alias("block")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        narrowed = {}
        for c, (lo, hi, base) in ranges.items():
            own = sorted((r["block"], r["n"], r["s"], r["lo"], r["hi"]) for r in sizes if r["column"] == c)
            if c not in facts:
                total = sum(n for _, n, *_ in own)
                if not total:
                    continue
                at = (total - 1) * q
                facts[c] = (total, sum(x[2] for x in own) / total, math.floor(at), math.ceil(at), at - math.floor(at))
            low, high = facts[c][2:4]
            known: dict[int, float] = {}
            for b, n, _, smallest, largest in own:
                for rank in {low, high}:
                    if base <= rank < base + n:
                        if smallest == largest or rank == base:
                            known[rank] = smallest
                        elif rank == base + n - 1:
                            known[rank] = largest
                        else:  # between two cuts, where a cut is not a value of the block
                            ends = [lo, *cuts[c], hi]
                            narrowed[c] = (ends[b // 2], ends[b // 2 + 1], base)
                base += n
            found.setdefault(c, {}).update(known)
        ranges = narrowed
    out = [(c, n, mean, found[c][low] + (found[c][high] - found[c][low]) * part)
           for c, (n, mean, low, high, part) in facts.items()]
    return df.sparkSession.createDataFrame(out, "column string, n long, mean double, quantile double")


def exact_quantile(df: DataFrame, value_col: str, q: float, out_col: str = "quantile") -> DataFrame:
    """One column's exact quantile, one row."""
    return exact_quantiles(df, [value_col], q).select(F.col("quantile").alias(out_col))


def column_stats_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median and mean of each column, one row with ``{c}_median``
    and ``{c}_mean``."""
    found = exact_quantiles(df, cols, 0.5)
    return found.agg(*[F.max(F.when(F.col("column") == c, F.col(v))).alias(f"{c}_{name}")
                       for c in cols for name, v in (("mean", "mean"), ("median", "quantile"))])
