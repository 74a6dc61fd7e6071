"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame whose
columns match the DuckDB oracle of the same name (``tillroll.plans.oracles``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dates as D
from tillroll.functions import pseudonym as N
from tillroll.functions import text as X
from tillroll.operators import reports as R
from tillroll.plans.oracles import ANALYSIS_END, EVENT_START
from tillroll.sources.fixtures import sales_view
from tillroll.session import delete_folder, discard, ensure_checkpoint_dir, materialize
from tillroll.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

CUST_SALT = 7919
PROD_SALT = 104729
SEED = 42
SERIAL_KEY = 7919


def q_event_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    return R.event_impact(orders, "o_orderdate", "o_totalprice", EVENT_START, ANALYSIS_END)


def q_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "date")
    d1 = D.parse_date("date")
    d2 = D.parse_date_lenient("date")
    return s.select("invoice", F.col("date").alias("date_raw"), d1.alias("date_ymd_dmy"),
                    d2.alias("date_lenient"), F.month(d2).alias("month"), F.year(d2).alias("year"))


def q_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "time")
    t = D.parse_time("time")
    return s.select("invoice", F.col("time").alias("time_raw"), t.alias("time"),
                    D.time_of_day(t).alias("time_of_day"))


def q_phone_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "phone")
    return s.select("invoice", F.col("phone").alias("phone_raw"),
                    X.clean_phone(X.normalize_ws("phone")).alias("phone"))


def q_email_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "email")
    return s.select("invoice", F.col("email").alias("email_raw"),
                    X.valid_email(X.normalize_ws("email")).alias("email"))


def q_name_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "name")
    return s.select("invoice", F.col("name").alias("name_raw"),
                    X.title_name(X.normalize_ws("name")).alias("name"))


def q_email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "email")
    e = X.valid_email(X.normalize_ws("email"))
    return s.select("invoice", e.alias("email"), X.mask_email(e).alias("email_masked"))


def q_serial_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "imei_sn")
    return s.select("invoice", F.col("imei_sn").alias("imei_raw"),
                    N.serial_hash("imei_sn", SERIAL_KEY).alias("imei_sn"))


def q_phone_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "phone")
    p = X.clean_phone(X.normalize_ws("phone"))
    code = N.phone_code(p, CUST_SALT)
    return s.select("invoice", p.alias("phone"), code.alias("phone_code"),
                    N.customer_id(code).alias("id"))


def q_date_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1b with a vote per column: one writes the month first, one the day,
    both mixed with years first."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).select(
        k.alias("invoice"),
        F.when(k % 3 == 0, F.date_format(day, "M/d/yyyy")).when(k % 3 == 1, F.date_format(day, " MM-dd-yyyy")).otherwise(
            F.date_format(day, "yyyy-MM-dd")).alias("us"),
        F.when(k % 5 == 0, F.date_format(day, "MM-dd-yyyy")).when(k % 5 == 1, F.lit("pending")).otherwise(
            F.date_format(day, "d/M/yyyy")).alias("eu"))
    votes = D.layout_votes(rows, ["us", "eu"])
    return rows.select("invoice", *[D.parse_date_voted(c, first).alias(f"{c}_date") for c, first in votes.items()],
                       *[F.lit(first).alias(f"{c}_month_first") for c, first in votes.items()])


QUERIES: dict[str, Query] = {
    "date_layout": q_date_layout,
    "event_impact": q_event_impact,
    "date_parse": q_date_parse,
    "time_parse": q_time_parse,
    "phone_clean": q_phone_clean,
    "email_clean": q_email_clean,
    "name_title": q_name_title,
    "email_mask": q_email_mask,
    "serial_hash": q_serial_hash,
    "phone_code": q_phone_code,
}


# --- customers -------------------------------------------------------------
from tillroll.functions import numeric as M  # noqa: E402
from tillroll.operators import cleaning as CL  # noqa: E402
from tillroll.operators import customers as C  # noqa: E402
from tillroll.operators import products as P  # noqa: E402
from tillroll.operators.lookup import lookup  # noqa: E402
from tillroll.operators import profile as PR  # noqa: E402
from tillroll.operators import revenue as RV  # noqa: E402
from tillroll.sources.fixtures import (  # noqa: E402
    DISC_COLS, FIXTURE_OWN_BRAND, PAYMENT_COLS, nameless_view, product_view)

# Price-scale configuration for the fixture categories (SMALL and DEMO are
# deliberately not configured).
PRICE_SCALE = {
    "PROMO": {"scale": [0.8, 1.2], "mag": 10, "sfx": 9},
    "ECONOMY": {"scale": [0.9, 1.1], "mag": 10, "sfx": 9},
    "STANDARD": {"scale": [1.0, 1.5], "mag": 100, "sfx": 90},
    "MEDIUM": {"scale": [0.7, 0.9], "mag": 10, "sfx": 5},
    "LARGE": {"scale": [1.1, 1.3], "mag": 50, "sfx": 0},
}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir, with_pos=True).select("pos", "invoice", "phone", "name", "email")
    return C.normalize_customers(s)


def q_customer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "phone", "name", "email")
    return C.normalize_customers(s)


def q_customer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    # equal spellings become one row before the texts are cleaned: cleaning is row by row, the first position is kept
    raw = C.distinct_spellings(sales_view(spark, sf_dir, with_pos=True))
    return C.code_customers(C.customer_master(C.normalize_customers(raw)), CUST_SALT)


def q_customer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(_customers(spark, sf_dir), "customer-lines")
    master = C.code_customers(C.customer_master(lines), CUST_SALT)
    return C.attach_customers(lines, master, CUST_SALT).select(
        "pos", "invoice", "phone", "id", "name", "email")


# --- products --------------------------------------------------------------

def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.dedupe_products(product_view(spark, sf_dir))
    return P.product_attributes(p, PROD_SALT, FIXTURE_OWN_BRAND)


def q_colour_size_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select(
        "pos", "ean", "cat", "master_sku", "color", "memory_size", "product_name")


def q_colour_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 in both modes, over texts with keywords inside other words."""
    k, text = F.col("pos"), F.col("sap_description")
    text = F.when(k % 6 == 0, F.concat_ws(" ", F.col("cat"), F.lit("powered organizer"))).when(
        k % 6 == 1, F.concat(F.col("detail_sub_lob"), F.lit("/ink-jet"))).otherwise(text)
    p = product_view(spark, sf_dir).select("pos", F.when(k % 6 != 0, F.col("product_name")).alias("name"), text.alias("text"))
    return p.select("pos", X.extract_color("name", "text").alias("color"),
                    X.extract_color("name", "text", whole_word=True).alias("whole_word"))


def q_customer_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2 with keyed ids, and with codes so short that many phones share one;
    N1's numbers that fit."""
    s = sales_view(spark, sf_dir).select(X.clean_phone(X.normalize_ws("phone")).alias("phone"))
    short = C.keyed_customers(s, SERIAL_KEY, n_chars=2).withColumnRenamed("id", "short_id")
    return C.keyed_customers(s, SERIAL_KEY).join(short, "phone").withColumn("fits", N.fits_phone_code("phone", CUST_SALT, 4))


def q_price_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = P.price_scale_config(spark, PRICE_SCALE)
    p = P.mask_prices(_products(spark, sf_dir), cfg, SEED, key_col="master_sku")
    return p.select("master_sku", "cat", "price", "new_price")


def q_price_mask_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + N5: the scales come from a file in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/price-scale-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(json.dumps(PRICE_SCALE, indent=1)).alias("value")).coalesce(1).write.text(path)
    cfg = P.price_scale_config(spark, load_price_scale(spark, path))
    p = P.mask_prices(_products(spark, sf_dir), cfg, SEED, key_col="master_sku")
    return p.select("master_sku", "cat", "price", "new_price")


def q_sku_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + J5: SKU of each sales line from the product master by EAN."""
    prod = _products(spark, sf_dir).select(
        X.normalize_key(F.col("ean")).alias("ean"), F.col("master_sku").alias("sku"))
    lines = materialize(sales_view(spark, sf_dir).select("invoice", X.normalize_key("ean").alias("ean")), "lookup-lines")
    return lookup(lines, prod, "ean")


def q_sku_lookup_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 with one EAN on most of the lines and lines without any."""
    prod = _products(spark, sf_dir).select(
        X.normalize_key(F.col("ean")).alias("ean"), F.col("master_sku").alias("sku"))
    h = F.col("invoice") % 20
    lines = sales_view(spark, sf_dir).select("invoice", F.when(h == 0, F.lit(None).cast("string")).when(
        h < 18, F.lit("8930000000007")).otherwise(X.normalize_key("ean")).alias("ean"))
    return lookup(materialize(lines, "lookup-lines"), prod, "ean")


# --- reports ---------------------------------------------------------------

def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("date", "cat", "sa", "qty", "revenue", "phone")
    code = N.phone_code(X.clean_phone(X.normalize_ws("phone")), CUST_SALT)
    return s.select(D.parse_date("date").alias("date"), "cat", "sa", "qty", "revenue",
                    N.customer_id(code).alias("id"))


def q_category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_numeric(R.category_summary(_report_lines(spark, sf_dir), "cat"), 2)


def q_month_category_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _report_lines(spark, sf_dir).withColumn("month", F.month("date"))
    return R.round_numeric(R.dense_group_summary(s, ["month", "cat"]), 2)


def q_salesperson_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_numeric(R.group_sum(_report_lines(spark, sf_dir), "sa", "revenue", "revenue"), 2)


def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_counts(_report_lines(spark, sf_dir), "cat", "n")


def q_second_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("cat", "price")
    return R.second_smallest_and_largest(s, ["cat"], "price", "second_lowest", "highest")


# --- revenue, prices, payments ----------------------------------------------

REVENUE_POCKETS = {"price": ["price"], "revenue": ["revenue"]}


REVENUE_COLS = ["qty", "price", *DISC_COLS, "revenue", *PAYMENT_COLS]


def _revenue_lines(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """The lines that the revenue is decided and repaired from, written once:
    each decision, and what follows, reads them again."""
    return materialize(sales_view(spark, sf_dir, with_pos="pos" in keys).select(*keys, *REVENUE_COLS), "revenue-lines")


def _filled_revenue(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    out, _ = RV.repair_revenue(_revenue_lines(spark, sf_dir, *keys), REVENUE_POCKETS, PAYMENT_COLS, DISC_COLS)
    return out


def q_revenue_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _revenue_lines(spark, sf_dir, "invoice")
    plan = RV.plan_revenue(s, REVENUE_POCKETS, DISC_COLS)
    alt = RV.alternate_revenue(s, PAYMENT_COLS, plan)
    return s.select("invoice", M.round_half_even(alt, 2).alias("revenue_alternate"))


def q_revenue_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _filled_revenue(spark, sf_dir, "invoice")
    return out.select("invoice", "qty", M.round_half_even("revenue", 2).alias("revenue"))


def q_revenue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _revenue_lines(spark, sf_dir, "invoice")
    out, plan = RV.repair_revenue(s, REVENUE_POCKETS, PAYMENT_COLS, DISC_COLS)
    alt = RV.alternate_revenue(s, PAYMENT_COLS, plan)
    m = RV.revenue_metrics(out.withColumn("_alt", alt), F.col("revenue"), F.col("_alt"))
    return R.round_numeric(m, 4)


def q_origin_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the written lines feed the per-EAN lookups and the join back to them
    out = RV.fill_origin_price(_filled_revenue(spark, sf_dir, "pos", "ean"))
    return R.round_numeric(out.select("pos", "ean", "price", "price_ratio"), 4)


def q_payment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "revenue", *PAYMENT_COLS)
    out = RV.payment_ratios(s)
    return R.round_numeric(out, 4)


def q_payment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _revenue_lines(spark, sf_dir, "invoice")
    ratios = RV.payment_ratios(s).drop("revenue")
    out, _ = RV.repair_revenue(ratios, {"price": ["price"]}, None, DISC_COLS)
    out = RV.mask_inconsistent(RV.resplit_payments(out))
    return R.round_numeric(out.select("invoice", "qty", "revenue", "cash", "card", "qr_code",
                                      "no_payment"), 4)


# --- profiling and cleaning ------------------------------------------------

def q_profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # profiling reads a table: on top of the fixture's joins its expressions
    # would share one generated method with them, too long to be compiled
    s = materialize(sales_view(spark, sf_dir), "profile-lines")
    _, rows = PR.classify_columns(s)
    return spark.createDataFrame(rows, "column string, pocket string, stage string")


def q_profile_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, C4-C9 on columns whose names tell nothing."""
    s = materialize(nameless_view(spark, sf_dir), "nameless-lines")
    _, rows = PR.classify_columns(s)
    return spark.createDataFrame(rows, "column string, pocket string, stage string")


def q_typed_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read twice, by the profile and by the projection
    s = materialize(sales_view(spark, sf_dir), "typed-lines")
    pockets, _ = PR.classify_columns(s)
    return R.round_numeric(CL.typed_clean(s, pockets), 4)


def q_generic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "date", "time", "sa", "ean", "imei_sn",
                                         "cat", "qty", "price", "disc_percent", "disc_amount",
                                         "revenue", "name")
    out = CL.generic_clean(s, drop_cols=["disc_percent", "disc_amount"],
                           special_cols=["date", "time", "qty"],
                           types={"invoice": "bigint", "qty": "int", "ean": "string"})
    return R.round_numeric(out, 4)


def q_money_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("invoice", "shelf_label", "sa", "ean")
    money = PR.find_money_columns(s)
    return s.select("invoice", *[M.comma_to_number(c).alias(f"{c}_value") for c in money])


QUERIES.update({
    "customer_normalize": q_customer_normalize,
    "customer_master": q_customer_master,
    "customer_join": q_customer_join,
    "colour_size_name": q_colour_size_name,
    "colour_whole_word": q_colour_whole_word,
    "customer_keyed": q_customer_keyed,
    "price_mask": q_price_mask,
    "price_mask_file": q_price_mask_file,
    "sku_lookup": q_sku_lookup,
    "sku_lookup_hot": q_sku_lookup_hot,
    "category_report": q_category_report,
    "month_category_dense": q_month_category_dense,
    "salesperson_revenue": q_salesperson_revenue,
    "value_counts": q_value_counts,
    "second_min_max": q_second_min_max,
    "revenue_alternate": q_revenue_alternate,
    "revenue_fill": q_revenue_fill,
    "revenue_metrics": q_revenue_metrics,
    "origin_price": q_origin_price,
    "payment_groups": q_payment_groups,
    "payment_check": q_payment_check,
    "profile_columns": q_profile_columns,
    "profile_content": q_profile_content,
    "typed_clean": q_typed_clean,
    "generic_clean": q_generic_clean,
    "money_cast": q_money_cast,
})


# --- dates -----------------------------------------------------------------
from tillroll.operators import temporal as TM  # noqa: E402


def q_date_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (sales_view(spark, sf_dir, with_pos=True).select("pos", "invoice", "date")
         .withColumnRenamed("date", "date_raw"))
    return TM.recover_dates(s, raw_col="date_raw", anchor_col="invoice", out_col="date")


def q_null_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir, with_pos=True).select("pos", "invoice", "date")
    a = TM.anchored_dates(s, "date", "invoice", "pos", "date_filled")
    return TM.null_runs(a, "pos", "date_filled")


QUERIES.update({"date_recover": q_date_recover, "null_runs": q_null_runs})


# --- traffic, interpolation, series masking -------------------------------------
from tillroll.operators.interpolate import pchip_fill  # noqa: E402
from tillroll.plans.traffic import masked_traffic, traffic_table  # noqa: E402
from tillroll.sources.fixtures import holiday_calendar, traffic_parts, traffic_view  # noqa: E402

TRAFFIC_SCALE = (0.6, 1.4)


def q_traffic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_table(traffic_parts(spark, sf_dir), holiday_calendar(spark))


def q_traffic_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masked_traffic(traffic_parts(spark, sf_dir), holiday_calendar(spark), TRAFFIC_SCALE, SEED)
    return out.select("series", "period", "event_name", "new_traffic")


def q_pchip_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traffic_view(spark, sf_dir)
    holes = t.withColumn("traffic", F.when(F.dayofmonth("period") % 5 != 0, F.col("traffic")))
    out = pchip_fill(holes, ["series"], "period", "traffic", "traffic_filled")
    return R.round_numeric(out.select("series", "period", "traffic", "traffic_filled"), 4)


def q_low_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traffic_view(spark, sf_dir)
    return R.round_numeric(t.groupBy("series").agg(
        F.percentile(F.col("traffic").cast("double"), 0.15).alias("q15")), 4)


QUERIES.update({
    "traffic_table": q_traffic_table,
    "traffic_mask": q_traffic_mask,
    "pchip_fill": q_pchip_fill,
    "low_quantile": q_low_quantile,
})


# --- quality, statistics, sources, pipelines -----------------------------------
import uuid  # noqa: E402

from tillroll.functions.names import normalize_headers  # noqa: E402
from tillroll.operators import quality as Q  # noqa: E402
from tillroll.plans.product_master import product_master  # noqa: E402
from tillroll.plans.sales import SalesConfig, load_exports, sales_pipeline  # noqa: E402
from tillroll.sources.fixtures import YEAR_SPLIT_INVOICE, write_yearly_exports  # noqa: E402
from tillroll.session import ensure_checkpoint_dir  # noqa: E402
from tillroll.functions.names import find_column, insert_column, reorder  # noqa: E402
from tillroll.sources.csv_io import load_price_scale, read_csv_projected, read_csv_strings, write_csv  # noqa: E402


def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir)
    return Q.quality_report(s, D.parse_date("date"), D.parse_time("time"), F.col("qty"),
                            F.col("price"))


def q_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.null_columns(sales_view(spark, sf_dir))


def q_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir)
    pockets, _ = PR.classify_by_name(s.columns)
    return Q.quality_rules(s, "qty", [c for cs in pockets.values() for c in cs])


def q_ean_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_numeric(Q.key_validity(product_view(spark, sf_dir), M.to_number("ean")), 4)


def q_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir).select("price", "qty")
    return R.round_numeric(R.column_stats_exact(s, ["price", "qty"]), 4)


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 then S1 + H1: write a CSV with untidy headers into the shared
    checkpoint folder, read it back as text with normalised headers."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/csv-{uuid.uuid4().hex}"
    s = sales_view(spark, sf_dir).select(
        F.col("invoice").alias("Invoice No"), F.col("date").alias(" Date"),
        F.col("name").alias("Customer  Name"))
    write_csv(s, path)
    return read_csv_strings(spark, path)


def _product_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_master(spark, product_view(spark, sf_dir), PROD_SALT, SEED, PRICE_SCALE,
                          FIXTURE_OWN_BRAND)


def q_product_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_master(spark, sf_dir)


def _sales_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    return load_exports(spark, write_yearly_exports(spark, sf_dir, folder))


def q_sales_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + H2 + U1 + P11 + O1: two yearly CSV files written, read, aligned,
    appended, incomplete rows dropped, rows numbered in file order."""
    return _sales_files(spark, sf_dir)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = SalesConfig(cust_salt=CUST_SALT, serial_key=SERIAL_KEY)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    rows = load_exports(spark, write_yearly_exports(spark, sf_dir, folder)).drop("source_id")
    delete_folder(spark, folder)  # made for this query; all rows stand in a table now
    out, _ = sales_pipeline(rows, _product_master(spark, sf_dir), cfg, stage_raw=False)
    discard(rows)  # the pipeline has written what it made from them
    return out


def q_sales_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_numeric(_pipeline(spark, sf_dir), 4)


def q_sales_event_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.event_impact(_pipeline(spark, sf_dir), "date", "revenue", "2024-06-01", "2024-12-31")


QUERIES.update({
    "quality_report": q_quality_report,
    "null_columns": q_null_columns,
    "quality_rules": q_quality_rules,
    "ean_validity": q_ean_validity,
    "column_stats": q_column_stats,
    "csv_roundtrip": q_csv_roundtrip,
    "product_master": q_product_master,
    "sales_files": q_sales_files,
    "sales_pipeline": q_sales_pipeline,
    "sales_event_impact": q_sales_event_impact,
})


# --- SQL over named frames, appended yearly files --------------------------------
from tillroll.sources.csv_io import append_aligned  # noqa: E402


def q_event_impact_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P8: the event report as SQL text over frames registered by name:
    a daily frame, a one-row frame of the two means, and one projection."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    CL.recast(orders.selectExpr("o_orderdate AS day", "o_totalprice AS amount"),
              {"day": "date"}).createOrReplaceTempView("tillroll_amounts")
    spark.sql(f"""
        SELECT day, sum(amount) AS total,
               coalesce(day BETWEEN DATE'{EVENT_START}' AND DATE'{ANALYSIS_END}', false) AS launched
        FROM tillroll_amounts GROUP BY day""").createOrReplaceTempView("tillroll_days")
    spark.sql("""
        SELECT avg(total) FILTER (WHERE NOT launched) AS calm, avg(total) FILTER (WHERE launched) AS busy
        FROM tillroll_days""").createOrReplaceTempView("tillroll_means")
    # the ordered window sees one row per day
    out = spark.sql("""
        SELECT day AS date, total AS revenue_by_date, week AS rolling_7day,
               round(sqrt(total), 0) AS sqrt_revenue, round(sqrt(week), 0) AS sqrt_rolling,
               if(launched, round(sqrt(week), 0), NULL) AS sqrt_event_launching,
               int(launched) AS is_after_event, calm AS rbm, busy AS ram,
               if(launched, NULL, calm) AS raw_before_event_mean, if(launched, busy, NULL) AS raw_after_event_mean,
               if(launched, NULL, sqrt(calm)) AS sqrt_before_event_mean, if(launched, sqrt(busy), NULL) AS sqrt_after_event_mean,
               100 * try_divide(busy - calm, calm) AS event_increase
        FROM (
            SELECT *, round(avg(total) OVER back, 0) AS week,
                   (SELECT calm FROM tillroll_means) AS calm, (SELECT busy FROM tillroll_means) AS busy
            FROM tillroll_days WINDOW back AS (ORDER BY day NULLS LAST ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
        )""")
    return R.round_numeric(out, 2)



def q_sales_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + H2 + H1 + P11: two yearly exports, the older with its own header
    spelling, aligned by position, appended, headers normalised, rows without
    the first four fields dropped."""
    s = sales_view(spark, sf_dir).select("invoice", "date", "time", "sa", "ean", "qty", "revenue")
    older = s.filter(F.col("invoice") < YEAR_SPLIT_INVOICE).toDF(
        "Invoice", "Date ", " Time", "SA", "EAN", "Qty", "Revenue")
    newer = s.filter(F.col("invoice") >= YEAR_SPLIT_INVOICE)
    both = normalize_headers(append_aligned([older, newer], "source_id"))
    return both.dropna(how="any", subset=both.columns[:4])


QUERIES.update({"event_impact_sql": q_event_impact_sql, "sales_append": q_sales_append})


def q_reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked catalogue price moved by each line's price ratio."""
    lines = _filled_revenue(spark, sf_dir, "pos", "ean")
    priced = RV.fill_origin_price(lines).select("pos", "ean", "price_ratio")
    masked = _product_master(spark, sf_dir).select(
        X.normalize_key(F.col("ean").cast("string")).alias("ean"), "new_price")
    out = priced.join(masked, "ean", "left")
    return out.select("pos", "ean", M.round_half_even(
        RV.reprice(F.col("new_price"), F.col("price_ratio")), 4).alias("price"))


QUERIES["reprice"] = q_reprice


def q_reprice_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 from each row's own origin price, then B5."""
    lines = _filled_revenue(spark, sf_dir, "pos", "ean")
    priced = RV.fill_origin_price(lines, ratio_from="row").select("pos", "ean", "price_ratio")
    masked = _product_master(spark, sf_dir).select(
        X.normalize_key(F.col("ean").cast("string")).alias("ean"), "new_price")
    out = priced.join(masked, "ean", "left").select(
        "pos", "ean", "price_ratio", RV.reprice(F.col("new_price"), F.col("price_ratio")).alias("price"))
    return R.round_numeric(out, 4)


def q_payment_groups_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 with the reference's rounding."""
    s = sales_view(spark, sf_dir).select("invoice", "revenue", *PAYMENT_COLS)
    return R.round_numeric(RV.payment_ratios(s, literal_rounding=True), 4)


def q_header_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1b (crlf, raw), H4-H6, H8, H9 on lines with untidy headers."""
    s = sales_view(spark, sf_dir)
    df = normalize_headers(s.select(
        F.col("invoice").alias(" Invoice No"), F.col("qty").alias("Qty\r\nSold"),
        F.col("price").alias("Unit  Price"), "sa"), "crlf")
    price, qty = find_column(df.columns, "PRICE"), find_column(df.columns, "^qty", "error")
    none = find_column(df.columns, "^(sa|qty)", "none")
    df = insert_column(df, 1, "amount", F.col(price) * F.col(qty))
    df = reorder(df, ["sa", "absent"]).withColumn("ambiguous", F.lit(none is None))
    return normalize_headers(R.round_numeric(df.withColumnRenamed("sa", " Sold By"), 4), "raw")


def q_csv_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 then S2: typed projection of a CSV."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(sales_view(spark, sf_dir).select("invoice", "date", "qty", "price", "name"), path)
    return read_csv_projected(spark, path, {
        "invoice": F.col("invoice").cast("long"), "qty": F.col("qty").cast("int"),
        "price": M.to_number("price"), "name": None})


def q_rules_asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 as pass or fail over all lines."""
    return Q.judge_rules(Q.quality_rules(sales_view(spark, sf_dir)))


def _line_rules() -> dict:
    return {"qty_positive": F.col("qty") > 0, "revenue_known": F.col("revenue").isNotNull(),
            "price_covers_revenue": F.col("revenue") <= F.col("price") * F.col("qty"),
            "phone_known": X.clean_phone(X.normalize_ws("phone")).isNotNull()}


def q_rules_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 + D4: the quarantined lines with the rules that they break."""
    _, bad, _ = Q.split_by_rules(sales_view(spark, sf_dir), _line_rules())
    return R.round_numeric(bad.select("invoice", "ean", "qty", "price", "revenue", F.array_join("broken_rules", " ").alias("broken")), 4)


def q_rules_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 + D4: the lines that keep every rule, counted with the lines and the
    breaches that the pass observed."""
    kept, _, counts = Q.split_by_rules(sales_view(spark, sf_dir), _line_rules())
    return kept.agg(F.count(F.lit(1)).alias("kept")).select("kept", *[F.lit(n).cast("long").alias(k) for k, n in counts.items()])


QUERIES.update({"reprice_row": q_reprice_row, "payment_groups_literal": q_payment_groups_literal,
                "header_tools": q_header_tools, "csv_projected": q_csv_projected,
                "rules_asserted": q_rules_asserted, "rules_quarantine": q_rules_quarantine,
                "rules_kept": q_rules_kept})
