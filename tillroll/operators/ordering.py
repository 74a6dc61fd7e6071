"""Row order at scale.

The source tables of a point-of-sale export carry an *implicit* row order (the
line order of the file).  Several operators depend on it: null runs between
neighbouring rows, "first row of a group", "keep the first duplicate".  A Spark
DataFrame has no row order, so order is made explicit:

* ``with_position`` gives every row a contiguous 1-based ``pos`` following the
  caller's (unique) order keys, without a single-partition window:
  range-partition, sort inside partitions, number rows locally, add the running
  total of the per-partition counts (one row per partition, broadcast).  The
  numbered frame is written as a table under ``spark.checkpoint.dir`` so the
  count and the numbering see the same rows, and so later stages restart from
  it when an executor is lost.
* ``with_halo_buckets`` cuts the global order into buckets of ``bucket_rows``
  rows and copies the ``halo`` rows next to each edge into the neighbouring
  bucket, so a window partitioned by bucket can look ``halo`` rows past its
  edge.  Results equal those of one global window as long as the operator
  never looks further than ``halo`` rows.
* ``fill_within_groups`` is a forward-then-backward fill inside a group along
  ``pos`` that stays balanced when one group holds a large share of all rows:
  the group is cut into blocks along ``pos``, each block is filled locally, and
  the last/first known value of earlier/later blocks is carried in from a
  per-block summary (one row per group and block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import materialize

DEFAULT_BUCKET_ROWS = 1 << 16   # rows per halo bucket (several make up a task)
DEFAULT_BLOCK_ROWS = 1 << 20    # rows of pos per block in fill_within_groups
MAX_PARTITIONS = 100_000


PARTITION_BYTES = 128 << 20     # estimated input of one range partition


def _num_partitions(df: DataFrame, requested: int | None) -> int:
    """Range partitions for ``df``: by the optimizer's size estimate, at least
    the session's shuffle partitions (the estimate of a join can be far too
    large, so it is held to MAX_PARTITIONS)."""
    if requested:
        return requested
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // PARTITION_BYTES + 1, MAX_PARTITIONS))


def with_position(df: DataFrame, order_cols: Sequence[str | Column], pos_col: str = "pos",
                  start: int = 1, num_partitions: int | None = None,
                  checkpoint: bool = True) -> DataFrame:
    """Add a contiguous position column following ``order_cols`` (ascending,
    nulls first).  The keys should be unique, otherwise ties are numbered in
    an arbitrary but fixed (checkpointed) order."""
    spark = df.sparkSession
    n = _num_partitions(df, num_partitions)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    numbered = (
        df.repartitionByRange(n, *[k.asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[k.asc_nulls_first() for k in keys])
        .withColumn("_pid", F.spark_partition_id())
        # monotonically_increasing_id = (partition index << 33) + row index
        .withColumn("_local", F.monotonically_increasing_id()
                    - F.shiftleft(F.col("_pid").cast("long"), 33))
    )
    if checkpoint:
        numbered = materialize(numbered, "positions")
    # One row per partition: its size is bounded by the partition count.
    offsets = (
        numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        .select("_pid", F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_offset"))
    )
    return (
        numbered.join(F.broadcast(offsets), "_pid")
        .withColumn(pos_col, F.col("_offset") + F.col("_local") + F.lit(start))
        .drop("_pid", "_local", "_offset")
    )


def with_halo_buckets(df: DataFrame, pos_col: str, halo: int,
                      bucket_rows: int = DEFAULT_BUCKET_ROWS, start: int = 1,
                      bucket_col: str = "_bucket", home_col: str = "_home") -> DataFrame:
    """Duplicate rows within ``halo`` of a bucket edge into the neighbouring
    bucket.  ``pos_col`` must be contiguous (``with_position``)."""
    if bucket_rows < halo:
        raise ValueError("bucket_rows must be at least halo")
    rel = F.col(pos_col) - F.lit(start)
    b = F.floor(rel / F.lit(bucket_rows)).cast("long")
    off = F.pmod(rel, F.lit(bucket_rows))
    copies = F.array(
        F.struct(b.alias("b"), F.lit(True).alias("h")),
        F.when(off < halo, F.struct((b - 1).alias("b"), F.lit(False).alias("h"))),
        F.when(off >= bucket_rows - halo, F.struct((b + 1).alias("b"), F.lit(False).alias("h"))),
    )
    # explode all three slots and drop the empty ones (no lambda: stays in
    # generated code)
    return (
        df.withColumn("_copy", F.explode(copies))
        .filter(F.col("_copy").isNotNull())
        .withColumn(bucket_col, F.col("_copy.b"))
        .withColumn(home_col, F.col("_copy.h"))
        .drop("_copy")
    )


def fill_within_groups(df: DataFrame, group_cols: Sequence[str], pos_col: str,
                       value_col: str, out_col: str,
                       block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``out = coalesce(value, previous non-null value in the group,
    next non-null value in the group)`` along ``pos_col``.

    Rows whose group key is null keep their own value (a null key is not a
    group)."""
    g = list(group_cols)
    blk = F.floor(F.col(pos_col) / F.lit(block_rows)).cast("long")
    with_blk = df.withColumn("_blk", blk)
    w = Window.partitionBy(*g, "_blk").orderBy(pos_col)
    local = (
        with_blk
        .withColumn("_lf", F.last(value_col, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_lb", F.first(value_col, ignorenulls=True).over(
            w.rowsBetween(1, Window.unboundedFollowing)))
    )
    known_pos = F.when(F.col(value_col).isNotNull(), F.col(pos_col))
    # Block summary straight from the input: max_by/min_by combine map-side,
    # so only about one row per (group, block) and input partition is
    # shuffled (the input itself is read a second time, narrowly).
    summary = (
        with_blk.groupBy(*g, "_blk").agg(
            F.max_by(value_col, known_pos).alias("_blast"),
            F.min_by(value_col, known_pos).alias("_bfirst"))
    )
    wg = Window.partitionBy(*g).orderBy("_blk")
    carry = summary.select(
        *g, "_blk",
        F.last("_blast", ignorenulls=True).over(
            wg.rowsBetween(Window.unboundedPreceding, -1)).alias("_cf"),
        F.first("_bfirst", ignorenulls=True).over(
            wg.rowsBetween(1, Window.unboundedFollowing)).alias("_cb"),
    )
    key_known = F.lit(True)
    for c in g:
        key_known = key_known & F.col(c).isNotNull()
    out = local.join(carry, [*g, "_blk"], "left")
    return out.withColumn(
        out_col,
        F.when(key_known, F.coalesce(value_col, "_lf", "_cf", "_lb", "_cb"))
        .otherwise(F.col(value_col)),
    ).drop("_blk", "_lf", "_lb", "_cf", "_cb")


def keep_first_per_key(df: DataFrame, key_cols: Sequence[str], pos_col: str) -> DataFrame:
    """Drop duplicate keys keeping the row with the smallest position.

    The smallest position per key is a hash aggregate of fixed width, combined
    in the tasks; the rows are then fetched by key and position, so that a hot
    key's rows are spread.  Rows with a null key are one key; positions are
    unique."""
    first = df.groupBy(*key_cols).agg(F.min(pos_col).alias("_pos")).select(
        *[F.col(c).alias(f"_k_{c}") for c in key_cols], "_pos")
    same = F.col(pos_col) == F.col("_pos")
    for c in key_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(first, same, "left_semi")
