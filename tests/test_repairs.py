"""Inputs that the fixture tables don't hold: twins, ties, quoted text."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tillroll.operators import customers as C
from tillroll.operators import products as P
from tillroll.operators import reports as R
from tillroll.operators import revenue as RV
from tillroll.sources import csv_io


def test_ean_twins_are_one_product(spark):
    df = spark.createDataFrame([("123.0", 2, "b"), ("123", 1, "a"), ("x9", 3, "c"), (" x9 ", 4, "d"), (None, 5, "e")],
                               "ean string, pos long, name string")
    assert sorted(r.name for r in P.dedupe_products(df).collect()) == ["a", "c"]


def test_phone_twins_don_t_multiply_lines(spark):
    lines = spark.createDataFrame(
        [("0901234567", "An", "a@b.vn", 1), ("00901234567", "An Binh", None, 2), (None, "No Phone", None, 3), (None, None, None, 4)],
        "phone string, name string, email string, pos long")
    master = C.code_customers(C.customer_master(lines), 7)
    out = C.attach_customers(lines, master, 7)
    assert out.count() == 4 and master.count() == 1
    assert {r.pos: r.name for r in out.collect()} == {1: "An Binh", 2: "An Binh", 3: None, 4: None}


def test_all_discount_columns_count(spark):
    df = spark.createDataFrame([(100.0, 2, 0.1, 0.2, 5.0, 7.0)], "price double, qty int, p1 double, p2 double, a1 double, a2 double")
    plan = RV.plan_revenue(df, {"price": ["price"]}, ["p1", "p2", "a1", "a2"])
    assert plan.pct_cols == ["p1", "p2"] and plan.amt_cols == ["a1", "a2"]
    assert df.select(RV.alternate_revenue(df, None, plan)).first()[0] == pytest.approx(200 * 0.9 * 0.8 - 12)


def test_dense_report_has_no_cap(spark):
    df = spark.range(12_000).select(F.concat(F.lit("c"), "id").alias("cat"), F.lit(1).alias("month"), F.lit(1.0).alias("revenue"),
                                    F.lit(1).alias("qty"), F.lit("x").alias("id"))
    assert R.dense_group_summary(df, ["month", "cat"]).count() == 12_000


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles_with_ties(spark, q):
    r = random.Random(4)
    a = [float(r.randint(1, 6)) for _ in range(500)] + [float(r.random() * 1000) for _ in range(301)]
    b = [1.0] * 700 + [None] * 101
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double")
    got = {x["column"]: x for x in R.exact_quantiles(df, ["a", "b"], q, blocks=16).collect()}
    s = sorted(a)
    at = (len(s) - 1) * q
    want = s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))
    assert got["a"]["quantile"] == pytest.approx(want) and got["a"]["mean"] == pytest.approx(statistics.fmean(a))
    assert got["b"]["quantile"] == 1.0 and got["b"]["n"] == 700


def test_csv_keeps_quotes_breaks_and_spaces(spark, tmp_path):
    rows = [('say "hi", ok', "  a  ", "1"), ("two\nlines", "x,y", None), ("\\", '""', "3")]
    csv_io.write_csv(spark.createDataFrame(rows, "a string, b string, c string").coalesce(1), str(tmp_path / "x"))
    assert {tuple(r) for r in csv_io.read_csv_strings(spark, str(tmp_path / "x"), multiline=True).collect()} == set(rows)
    typed = csv_io.read_csv_projected(spark, str(tmp_path / "x"), {"a": None, "c": F.col("c").cast("int")}, multiline=True)
    assert sorted(r.c or 0 for r in typed.collect()) == [0, 1, 3]


def test_price_scale_file(spark, tmp_path):
    scale = {"A": {"scale": [0.5, 1.5], "mag": 10, "sfx": 9}}
    (tmp_path / "scale.json").write_text(json.dumps(scale, indent=1))
    assert csv_io.load_price_scale(spark, str(tmp_path / "scale.json")) == scale
