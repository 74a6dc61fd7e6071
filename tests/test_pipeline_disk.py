"""What the sales pipeline leaves on disk and moves: stage tables, shuffle files."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import revenue as RV
from tillroll.operators import temporal as TM
from tillroll.plans import queries as Q
from tillroll.plans.sales import SalesConfig, sales_pipeline
from tillroll.session import WRITE_CONF, discard, ensure_checkpoint_dir, materialize

SF = "/root/testdata/sf0.001"


def tables(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{base}/tables/*") + glob.glob(f"{base}/exports-*")}


@pytest.fixture
def fresh(spark, tmp_path):
    """A checkpoint folder of its own."""
    old = ensure_checkpoint_dir(spark)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    yield spark
    spark.sparkContext.setCheckpointDir(old)


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum("shuffle_" in f and f.endswith(".data") for f in files.split("\n"))


@pytest.mark.parametrize("query", ["sales_pipeline", "sales_event_impact"])
def test_lines_are_kept_in_one_stage_table(fresh, query):
    df = Q.QUERIES[query](fresh, SF)
    assert {x for x in tables(fresh) if x.startswith(("exports", "file-", "sales-", "found-"))} == {
        "sales-customers", "sales-eans", "found-dates"}
    assert df.count() > 0


def test_raw_lines_are_dropped_when_the_pipeline_wrote_them(fresh):
    from tillroll.sources.fixtures import sales_view

    lines = materialize(sales_view(fresh, SF, with_pos=True), "given")
    out, _ = sales_pipeline(lines, Q._product_master(fresh, SF), SalesConfig(cust_salt=1, serial_key=2))
    assert "sales-raw" not in tables(fresh) and "given" in tables(fresh)
    assert out.count() == lines.count()


def test_lean_writes_leave_no_shuffle_files(fresh):
    before, conf = shuffle_files(fresh), {k: fresh.conf.get(k) for k in WRITE_CONF}
    df = fresh.range(10_000).repartition(5).groupBy((F.col("id") % 100).alias("k")).count()
    assert materialize(df, "lean", compact=True).agg(F.sum("count")).first()[0] == 10_000
    fresh.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffle_files(fresh) <= before + 1  # of the sum, but none of the write
    assert {k: fresh.conf.get(k) for k in WRITE_CONF} == conf


def test_discard_takes_stage_tables_only(fresh, tmp_path):
    fresh.range(3).write.parquet(str(tmp_path / "own"))
    a, b = materialize(fresh.range(5), "a"), materialize(fresh.range(5), "b")
    discard(a.join(fresh.read.parquet(str(tmp_path / "own")), "id"))
    assert tables(fresh) == {"b"} and fresh.read.parquet(str(tmp_path / "own")).count() == 3
    assert b.count() == 5


@pytest.mark.parametrize("anchor", ["invoice", None])
def test_dates_apart_are_the_dates_of_whole_lines(spark, anchor):
    rng, rows = random.Random(5), []
    for pos in range(1, 1501):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=pos // 30 + rng.choice([0, 0, 0, 5]))
        text = rng.choice([day.isoformat(), day.isoformat(), f"{day:%d-%m-%Y}", None, "", "soon", f"{day:%d.}", f"{day.day} {day.year}"])
        rows.append((pos, rng.choice([None, pos // 4, pos // 4, 7]), text, f"other {pos}"))
    df = spark.createDataFrame(rows, "pos long, invoice long, date string, other string")
    for out_col in ("date", "day"):
        args = dict(anchor_col=anchor, out_col=out_col, bucket_rows=64, block_rows=200)
        want, got = TM.recover_dates(df, **args), TM.recover_dates_apart(df, **args)
        assert sorted(want.columns) == sorted(got.columns)
        cols = ["pos", *sorted(set(want.columns) - {"pos"})]
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
        assert got.count() == 1500


def test_ratios_of_texts(spark):
    """Methods that are text: no number, no ratio."""
    df = spark.createDataFrame([(10.0, 5.0, "unknown", "2.5"), (10.0, None, "", None)], "revenue double, cash double, mkt string, vnpay string")
    got = RV.payment_ratios(df).select("cash", "card", "qr_code", "count").collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0, 0.25, 2), (0.0, 0.0, 0.0, 0)]
