"""Traffic table (B14): yearly parts appended (U2), holiday calendar joined
(J3), ordered by day (O1), masked (N6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.masking import mask_series


def traffic_table(parts: list[DataFrame], holidays: DataFrame) -> DataFrame:
    """U2 + J3 + O1.  Spark broadcasts the calendar if its size allows it."""
    allp = reduce(lambda a, b: a.unionByName(b), parts)
    return (allp.join(holidays, "period", "left")
            .select("series", "period", "traffic", "event_name")
            .orderBy(F.col("series"), F.col("period").asc_nulls_last()))


def masked_traffic(parts: list[DataFrame], holidays: DataFrame, scale: tuple[float, float],
                   seed: int) -> DataFrame:
    """The traffic table with the metric replaced by its masked series."""
    t = traffic_table(parts, holidays)
    return mask_series(t, ["series"], "period", "traffic", scale, seed, out_col="new_traffic")
