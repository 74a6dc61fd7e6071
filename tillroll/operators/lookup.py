"""Left joins of growing lines with a keyed table (one row per key), where a
few keys, or none at all, may hold most of the lines (J1, J2, J4, B3).

* Frequent keys are found by a bounded sketch over the key column alone, which
  merges on the way (``approx_top_k``, at most MAX_HOT keys of TRACKED counters
  reach the driver).  A key counts as frequent if it holds more than
  1/(HOT_SHARE · partitions) of the lines.  The sketch may report too many or
  too few: that only moves a line between the two ways below.
* Lines of a frequent key get their row from a broadcast of those keys' rows,
  at most MAX_HOT of them, as keys are unique.
* All other lines are joined by the planner's choice.  Lines with a null or a
  frequent key take part in that join under a key of their own, which matches
  nothing, so they are dealt out evenly instead of meeting in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT, TRACKED, HOT_SHARE = 512, 16_384, 4


def frequent_keys(df: DataFrame, keys: Mapping[str, Column]) -> dict[str, list]:
    """The frequent values of each of ``keys``, in one job over ``df``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(MAX_HOT, HOT_SHARE * parts)
    row = df.select(*[c.cast("string").alias(n) for n, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[F.call_function("approx_top_k", F.col(n), F.lit(k), F.lit(TRACKED)).alias(f"top_{n}") for n in keys]).first()
    least = max(row["n_lines"] / (HOT_SHARE * parts), 1)
    return {n: [x["item"] for x in row[f"top_{n}"] or [] if x["item"] is not None and x["count"] > least] for n in keys}


def lookup(lines: DataFrame, table: DataFrame, key: str, hot: Sequence | None = None) -> DataFrame:
    """``lines`` left join ``table`` on the text column ``key``; no line is lost
    or multiplied as long as the table's keys are unique.  ``hot``: the frequent
    keys, if known."""
    if hot is None:
        hot = frequent_keys(lines, {key: F.col(key)})[key]
    values = [c for c in table.columns if c != key]
    own = F.concat(F.lit("\u0000"), F.xxhash64(*lines.columns).cast("string"))
    is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False)) if hot else F.lit(False)
    rest = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_v_{c}") for c in values])
    out = (lines.withColumn("_key", F.when(F.col(key).isNull() | is_hot, own).otherwise(F.col(key)))
           .join(rest, "_key", "left").drop("_key"))
    if not hot:
        return out.withColumnsRenamed({f"_v_{c}": c for c in values})
    few = table.filter(F.col(key).isin(list(hot))).select(
        F.col(key).alias("_hot"), F.struct(*[F.col(c) for c in values]).alias("_h"))
    out = out.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left")
    return out.select(*lines.columns, *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_v_{c}")).alias(c) for c in values])
