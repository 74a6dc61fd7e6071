"""Exact order statistics, duplicate rows and rules against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tillroll.operators import quality as Q
from tillroll.operators import reports as R


def quantile(values, q):
    s = sorted(values)
    at = (len(s) - 1) * q
    return s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))


@pytest.mark.parametrize("q", [0.0, 0.15, 0.5, 0.999, 1.0])
def test_narrowing(spark, q):
    """Ties, wide ranges, few values; few blocks force several rounds."""
    r = random.Random(3)
    data = {"flat": [r.random() for _ in range(3000)], "ties": [r.choice([1.0, 2.0, 2.0, 2.0, 7.0]) for _ in range(3000)],
            "wide": [2.0 ** r.uniform(-900, 900) * r.choice([1, -1]) for _ in range(3000)],
            "mixed": [5.0 if i % 2 else 5.0 + r.random() * 1e-9 for i in range(3000)], "one": [3.0] * 3000}
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data))
    got = {x["column"]: x for x in R.exact_quantiles(df, list(data), q, blocks=5).collect()}
    for c, values in data.items():
        assert got[c]["quantile"] == pytest.approx(quantile(values, q), rel=1e-12), c
        assert got[c]["n"] == 3000 and got[c]["mean"] == pytest.approx(statistics.fmean(values), rel=1e-6, abs=1e-6)


def test_small_columns(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None)], "a double, b double, c double")
    assert {x["column"]: x["quantile"] for x in R.exact_quantiles(df, ["a", "b", "c"], 0.5).collect()} == {"a": 1.0, "c": 4.0}
    assert R.exact_quantiles(df.limit(0), ["a"], 0.5).count() == 0


def test_ten_million_distinct_values(spark):
    df = spark.range(10_000_001).select(((F.col("id") * 7_368_787) % 10_000_001).cast("double").alias("v"))
    assert R.exact_quantiles(df, ["v"], 0.5).first()["quantile"] == 5_000_000.0


def test_duplicates_and_a_forced_collision(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "a", "1"), (2, "b", "c"), (2, "b", "c"), (2, "b", "c"), (3, "", "")]
    df = spark.createDataFrame(rows, "x int, y string, `z.z` string")
    want = {"rows": 8, "duplicate_rows": 3, "twos": 3}
    assert Q.duplicate_counts(df, {"twos": F.col("x") == 2}) == want
    # one digest for all rows, and one for rows that differ
    assert Q.duplicate_counts(df, {"twos": F.col("x") == 2}, [F.lit(0)]) == want
    assert Q.duplicate_counts(df, {"twos": F.col("x") == 2}, [F.coalesce("x", F.lit(9))]) == want
    assert Q.duplicate_counts(df.limit(0)) == {"rows": 0, "duplicate_rows": 0}
    assert Q.duplicate_rows(df).first()[0] == 3


def test_rows_split_by_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (None, 1.0), (-4, -1.0)], "qty int, price double")
    kept, bad, counts = Q.split_by_rules(df, {"qty": F.col("qty") > 0, "price": F.col("price") > 0})
    assert [tuple(r) for r in kept.collect()] == [(1, 5.0)]
    assert sorted((r.qty or 0, r.broken_rules) for r in bad.collect()) == [(-4, ["qty", "price"]), (0, ["qty"]), (2, ["price"])]
    assert counts == {"rows": 4, "quarantined": 3, "qty": 2, "price": 2}
    kept, bad, _ = Q.split_by_rules(df.limit(0), {"qty": F.col("qty") > 0})
    assert kept.count() == bad.count() == 0 and kept.columns == ["qty", "price"]
    with pytest.raises(AssertionError):
        Q.assert_rules(Q.quality_rules(df))
