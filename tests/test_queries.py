"""Every registered query against its DuckDB oracle on the smallest tables,
plus the driver entry point."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows  # noqa: E402
from tillroll.sources.tables import TABLES, table_path  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "event_increase" in df.columns


def test_every_query_has_an_oracle():
    """But for the corpus operators, which are tested against brute force."""
    no_oracle = set(E.queries()) - set(E.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in no_oracle)


def test_the_pipeline_keeps_every_line(spark, con):
    assert E.queries()["sales_pipeline"](spark, SF).count() == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = con.sql(E.oracle_sql()[name]).df()
    sc, sr = rows(sdf)
    oc, orr = rows(odf)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


def test_pipeline_runs(spark):
    df = E.queries()["sales_pipeline"](spark, SF)
    cols = set(df.columns)
    assert {"date", "invoice", "sku", "imei_sn", "id", "price", "revenue", "cash", "card",
            "qr_code", "no_payment", "date_status"} <= cols
    assert not {"phone", "email_raw", "payoo", "vnpay", "new_price"} & cols
    assert df.count() > 0


def test_pipeline_counters(spark):
    from tillroll.plans.queries import CUST_SALT, SERIAL_KEY, _product_master
    from tillroll.plans.sales import SalesConfig, sales_pipeline
    from tillroll.sources.fixtures import sales_view
    out, metrics = sales_pipeline(sales_view(spark, SF, with_pos=True), _product_master(spark, SF),
                                  SalesConfig(cust_salt=CUST_SALT, serial_key=SERIAL_KEY))
    n = out.count()
    got = metrics["counters"].get
    assert got["rows"] == n and got["dates_pending"] >= 0
    assert metrics["pockets"]["date_col"] == ["date"]
