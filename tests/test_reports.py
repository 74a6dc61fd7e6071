"""Report operators on hand-made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import reports as R
from tillroll.operators.cleaning import recast


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(100, 20, 1001).round(2).tolist() + [None] * 7
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(6)
    data = np.array([v for v in vals if v is not None])
    for q in (0.15, 0.5, 0.9):
        got = R.exact_quantile(df, "x", q).first()[0]
        assert got == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_dense_group_summary_fills_absent_pairs(spark):
    rows = [(1, "a", 10.0, 1, "c1"), (1, "b", None, 2, "c2"), (2, "a", 5.0, 1, "c1")]
    df = spark.createDataFrame(rows, "month int, cat string, revenue double, qty int, id string")
    got = {(r["month"], r["cat"]): r for r in R.dense_group_summary(df, ["month", "cat"]).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    assert got[(2, "b")]["total_revenue"] == 0.0 and got[(2, "b")]["mean_revenue"] is None
    assert got[(2, "b")]["cust_count"] == 0 and got[(1, "b")]["total_revenue"] == 0.0


def test_rolling_mean_and_event_impact(spark):
    rows = [(f"2024-01-{d:02d}", float(d)) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "d string, v double").select(F.col("d").cast("date").alias("d"), "v")
    out = {str(r["date"]): r for r in R.event_impact(df, "d", "v", "2024-01-06", "2024-01-08").collect()}
    assert out["2024-01-07"]["rolling_7day"] == 4.0          # mean of 1..7
    assert out["2024-01-03"]["rolling_7day"] == 2.0          # mean of 1..3
    assert out["2024-01-07"]["is_after_event"] == 1 and out["2024-01-09"]["is_after_event"] == 0
    before = np.mean([1, 2, 3, 4, 5, 9, 10])
    assert out["2024-01-01"]["rbm"] == pytest.approx(round(before, 2))
    assert out["2024-01-01"]["event_increase"] == pytest.approx(round((7 / before - 1) * 100, 2))


def test_recast_rounds_half_even_to_integers(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (3.7,)], "q double")
    assert [r[0] for r in recast(df, {"q": "int"}).collect()] == [2, 4, 4]
