"""Data-quality operators (D1-D4, H11): counts computed in single aggregate
jobs; rule results as small DataFrames (one row per rule / column)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tillroll.session import materialize


def _rows(pairs: Sequence[tuple[str, Column]], name_col: str, value_col: str) -> Column:
    """One struct per (name, value) pair, to be exploded into rows."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias(name_col), v.cast("long").alias(value_col))
                               for n, v in pairs]))


def row_digest(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row.  Hashes pass over nulls, so
    the places of the nulls are hashed too."""
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    every = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(nulls, *every), F.xxhash64(F.lit(11), nulls, *every)]


def duplicate_counts(df: DataFrame, counts: Mapping[str, Column] | None = None,
                     digest: Sequence[Column] | None = None) -> dict[str, int]:
    """``rows``, ``duplicate_rows`` (rows equal to an earlier one) and the rows
    that fulfil each condition of ``counts``, from one pass over ``df``.

    Rows are grouped by a digest of fixed width, with their counts.  Only where
    digests occur twice whole rows are compared: those rows alone are read again,
    so different rows with one digest are not taken for duplicates."""
    keys = [c.alias(f"_d{i}") for i, c in enumerate(digest or row_digest(df))]
    names = [f"_d{i}" for i in range(len(keys))]
    tests = {f"_c_{n}": F.coalesce(c, F.lit(False)).cast("int") for n, c in (counts or {}).items()}
    groups = df.select(*keys, *[c.alias(n) for n, c in tests.items()]).groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in tests])
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("twice"),
                       *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tests]).first()
    out = {"rows": total["rows"], "duplicate_rows": 0} | {n[3:]: total[n] for n in tests}
    if total["twice"]:
        again = groups.filter(F.col("_n") > 1).select(*names)
        suspects = df.select(*keys, "*").join(again, names, "left_semi")
        # equal rows of a digest are counted first, in the tasks
        whole = suspects.groupBy(*names, *[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
        out["duplicate_rows"] = whole.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).first()["n"]
    return out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The number of rows equal to an earlier row, one row."""
    n = duplicate_counts(df)["duplicate_rows"]
    return df.sparkSession.createDataFrame([(n,)], "duplicate_rows long")


def quality_report(df: DataFrame, date: Column, time: Column, qty: Column,
                   price: Column) -> DataFrame:
    """Null dates, null times, duplicate rows, null quantities and
    non-positive prices, one row."""
    found = duplicate_counts(df, {"null_dates": date.isNull(), "null_times": time.isNull(),
                                  "null_qty": qty.isNull(), "price_le_0": price <= 0})
    names = ["rows", "null_dates", "null_times", "duplicate_rows", "null_qty", "price_le_0"]
    return df.sparkSession.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


def null_columns(df: DataFrame) -> DataFrame:
    """(column, nulls) for the columns that contain nulls."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (agg.select(_rows([(c, F.col(c)) for c in df.columns], "column", "nulls").alias("r"))
            .select("r.column", "r.nulls").filter(F.col("nulls") > 0))


def quality_rules(df: DataFrame, qty: str = "qty",
                  accounted: Iterable[str] | None = None) -> DataFrame:
    """(rule, violations) for: quantity negative, quantity null, columns
    not accounted for by the given groups."""
    missing = [] if accounted is None else [c for c in df.columns if c not in set(accounted)]
    agg = df.agg(F.count_if(F.col(qty) < 0).alias("qty_negative"),
                 F.count_if(F.col(qty).isNull()).alias("qty_null"))
    pairs = [("qty_negative", F.col("qty_negative")), ("qty_null", F.col("qty_null")),
             ("unaccounted_columns", F.lit(len(missing)))]
    return agg.select(_rows(pairs, "rule", "violations").alias("r")).select("r.rule", "r.violations")


def judge_rules(rules: DataFrame) -> DataFrame:
    """(rule, violations, passed)."""
    return rules.withColumn("passed", F.col("violations") == 0)


def assert_rules(rules: DataFrame) -> None:
    """D2 as hard checks: raise when a rule has violations (one small collect)."""
    bad = [(r["rule"], r["violations"]) for r in rules.filter(F.col("violations") > 0).collect()]
    if bad:
        raise AssertionError(f"data-quality rules violated: {bad}")


def split_by_rules(df: DataFrame, rules: Mapping[str, Column], label: str = "judged"
                   ) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """D2 + D4 inside the running plan: the rows that keep all ``rules``, those
    that don't, with the names of the broken rules in ``broken_rules``, and the
    number of rows that break each rule.

    A rule is a condition that must be true; null breaks it.  All rows are
    judged once, while they are written to one table with a folder for either
    kind, and the counts are observed in that pass."""
    broken = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    judged = df.withColumn("broken_rules", F.array_compact(F.array(*broken)))
    judged = judged.withColumn("_quarantined", F.size("broken_rules") > 0)
    counts = Observation(f"rules {uuid.uuid4().hex}")
    judged = judged.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if("_quarantined").alias("quarantined"), *[
        F.count_if(F.array_contains("broken_rules", n)).alias(n) for n in rules])
    table = materialize(judged, label, partition_by="_quarantined")
    kept = table.filter(~F.col("_quarantined")).drop("_quarantined", "broken_rules")
    return kept, table.filter("_quarantined").drop("_quarantined"), counts.get


def key_validity(df: DataFrame, key: Column, name: str = "valid_pct") -> DataFrame:
    """D3: share of rows whose key is valid, in percent."""
    return df.agg((F.avg(key.isNotNull().cast("double")) * F.lit(100.0)).alias(name))
