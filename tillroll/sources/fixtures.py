"""Derived "dirty" inputs built from the provided tables.

The reference consumes point-of-sale CSV exports (sales lines, a product list,
store traffic and a holiday calendar) that are not shipped.  These views derive
inputs with the same shape and the same kinds of defects from the TPC-H-like
tables, deterministically, so every operator can run on data that grows with
the scale factor.  The same formulas are written in DuckDB SQL in
``tillroll.plans.oracles`` for the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.ordering import with_position
from tillroll.session import lean_writes
from tillroll.sources.csv_io import write_csv
from tillroll.sources.tables import read_table, spread

PAYMENT_COLS = ["cash", "card", "payoo", "banking", "mkt", "vnpay", "trade_in"]
DISC_COLS = ["disc_percent", "disc_amount"]
# Categories treated as the own-brand group in the fixtures.
FIXTURE_OWN_BRAND = ["PROMO", "ECONOMY"]

SALES_ORDER_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_discount"]


def _h() -> Column:
    return (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % 100


def sales_lines(spark: SparkSession, sf_dir: str, with_pos: bool = False) -> DataFrame:
    """lineitem ⋈ part ⋈ (orders ⋈ customer) with the raw columns needed.

    Fact-to-fact joins: no broadcast hints; AQE turns a side into a broadcast
    only when its measured size is under the threshold.  Customers meet the
    orders, not the lines, so the lines move twice, before names widen them.  ``with_pos`` numbers
    the lineitem rows *before* the joins, while they are still narrow (seven
    numeric columns), so the ordering shuffle moves as few bytes as possible."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount"])
    li = with_position(li, SALES_ORDER_KEYS, pos_col="pos") if with_pos else spread(li)
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    buyers = o.join(c, F.col("o_custkey") == c.c_custkey)
    return (li.join(p, F.col("l_partkey") == p.p_partkey)
            .join(buyers, F.col("l_orderkey") == F.col("o_orderkey")))


def sales_view(spark: SparkSession, sf_dir: str, with_pos: bool = False,
               keep_keys: bool = False) -> DataFrame:
    """Sales lines as a messy export would hold them (see FIXTURES.md §3.1).

    ``with_pos`` adds the contiguous file-order position ``pos``
    (rank by l_orderkey, l_linenumber, l_partkey, l_suppkey)."""
    out = _export_columns(sales_lines(spark, sf_dir, with_pos=with_pos), ["pos"] if with_pos else [])
    return out if keep_keys else out.drop(*SALES_ORDER_KEYS)


def _export_columns(j: DataFrame, extra: list[str]) -> DataFrame:
    """The export's columns of ``sales_lines``, after ``extra`` and the order keys."""
    # derived keys first, in a narrow projection, so the wide projection below
    # refers to them instead of repeating their expressions
    j = j.select(
        *extra, *SALES_ORDER_KEYS, "l_quantity", "l_extendedprice", "l_discount", "c_name", "p_type",
        "c_custkey", _h().alias("_h"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("_z"),
        F.date_add(F.lit("2024-01-01").cast("date"),
                   F.expr("l_orderkey div 40").cast("int")).alias("_d0"),
        (F.floor(F.col("l_extendedprice") * 100.0 / F.col("l_quantity")) / 100.0).alias("_price"),
    )
    j = j.select("*", F.when(F.col("_h") % 37 == 0, F.lit(0))
                 .otherwise(F.col("l_quantity").cast("int")).alias("_qty"),
                 F.when(F.col("_h") % 9 == 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("_amt"))
    j = j.select("*", (F.col("_price") * F.col("_qty") * (1 - F.col("l_discount"))
                       - F.col("_amt")).alias("_r"))
    h, k, z, d0 = F.col("_h"), F.col("c_custkey"), F.col("_z"), F.col("_d0")
    qty, price, amt, r = F.col("_qty"), F.col("_price"), F.col("_amt"), F.col("_r")
    hp = h % 5
    cols = [
        F.col("l_orderkey").alias("invoice"),
        F.when(F.col("l_linenumber") % 5 == 4, F.lit(None).cast("string"))
        .when(F.col("l_orderkey") % 23 == 5, F.lit(""))
        .when(F.col("l_orderkey") % 29 == 7, F.date_format(d0, "yyyy/MM/dd"))
        .when(F.col("l_orderkey") % 3 == 1, F.date_format(d0, "dd-MM-yyyy"))
        .otherwise(F.date_format(d0, "yyyy-MM-dd")).alias("date"),
        F.when(h % 4 == 0, F.lit("8:05am")).when(h % 4 == 1, F.lit("20:30:00"))
        .when(h % 4 == 2, F.lit("16:20")).otherwise(F.lit("n/a")).alias("time"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("sa"),
        F.concat((F.lit(8930000000000) + F.col("l_partkey")).cast("string"),
                 F.when(h % 4 == 0, F.lit(".0")).otherwise(F.lit(""))).alias("ean"),
        F.when(h % 10 == 0, F.lit("unknown")).otherwise(
            (F.lit(350000000000000) + F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
            .cast("string")).alias("imei_sn"),
        F.col("p_type").alias("cat"),
        qty.alias("qty"),
        price.alias("price"),
        F.format_number(price, 2).alias("shelf_label"),
        F.col("l_discount").alias("disc_percent"),
        amt.alias("disc_amount"),
        F.when(h % 13 == 0, F.lit(None).cast("double"))
        .when(h % 17 == 0, F.lit(0.0)).otherwise(r).alias("revenue"),
        F.when(hp == 0, r).when(hp == 2, r * 0.3).alias("cash"),
        F.when(hp == 1, r * 0.6).alias("card"),
        F.lit(None).cast("double").alias("payoo"),
        F.when(hp == 1, r * 0.4).alias("banking"),
        F.lit(None).cast("double").alias("mkt"),
        F.when(hp == 2, r * 0.7).alias("vnpay"),
        F.when(hp == 3, r).alias("trade_in"),
        F.when(k % 7 == 0, F.concat(F.lit("+84 9"), z))
        .when(k % 7 == 1, F.concat(F.lit("09"), z))
        .when(k % 7 == 2, F.concat(F.lit("9"), z))
        .when(k % 7 == 3, F.concat(F.lit("0"), z))
        .when(k % 7 == 4, F.lit("123"))
        .when(k % 7 == 5, F.concat(F.lit("0084 9"), z))
        .otherwise(F.lit("unknown")).alias("phone"),
        F.when(k % 11 == 0, F.lit("unknown")).otherwise(
            F.concat(F.lit("  "), F.col("c_name"),
                     F.repeat(F.lit("x"), (F.col("l_linenumber") % 3).cast("int")))).alias("name"),
        F.when(k % 6 == 0, F.lit("bad.address")).when(k % 9 == 0, F.lit("a@d.vn"))
        .otherwise(F.concat(F.lit("User"), k.cast("string"), F.lit("@Shop.vn"))).alias("email"),
    ]
    keys = [F.col(c) for c in SALES_ORDER_KEYS]
    return j.select(*extra, *keys, *cols)


#: Invoices below stand in the older yearly file.
YEAR_SPLIT_INVOICE = 40 * 366
#: The columns of the yearly files, the four that a full line always has first.
EXPORT_COLUMNS = ["invoice", "ean", "sa", "cat", "date", "time", "imei_sn", "qty", "price", "shelf_label", "disc_percent",
                  "disc_amount", "revenue", *PAYMENT_COLS, "phone", "name", "email", "vat", "note"]


def write_yearly_exports(spark: SparkSession, sf_dir: str, folder: str) -> list[str]:
    """The sales lines as two yearly CSV files in row order, the older with its
    own header spelling.  Every invoice that ends in 7 has a subtotal line,
    without the first four fields, after its first line.

    Lines are put in order while they are narrow, and get their texts on the way
    into the files, which are compressed."""
    keys = [F.col(c) for c in SALES_ORDER_KEYS]
    lines = sales_lines(spark, sf_dir).select(*SALES_ORDER_KEYS, "c_custkey", "c_name", "p_type")
    subtotal = F.when((F.col("l_orderkey") % 10 == 7) & (F.col("l_linenumber") == 1), F.lit(1))
    lines = lines.withColumn("_sub", F.explode(F.array_compact(F.array(F.lit(0), subtotal))))
    full = F.col("_sub") == 0
    paths = []
    for older in (True, False):
        path = f"{folder.rstrip('/')}/sales-{'older' if older else 'newer'}"
        in_older = F.col("l_orderkey") < YEAR_SPLIT_INVOICE
        part = lines.filter(in_older if older else ~in_older)
        part = part.repartitionByRange(*keys, "_sub").sortWithinPartitions(*keys, "_sub")
        part = _export_columns(part, ["_sub"]).withColumns({"vat": F.lit("10%"), "note": F.lit(None).cast("string")})
        part = part.withColumns({c: F.when(full, F.col(c)) for c in EXPORT_COLUMNS[:4]}
                                | {"note": F.when(~full, F.lit("subtotal")), "name": F.when(full, F.col("name"))})
        part = part.select(*EXPORT_COLUMNS)
        with lean_writes(spark):
            write_csv(part.toDF(*[f" {c.replace('_', '  ').title()} " if older else c for c in EXPORT_COLUMNS]), path, compression="gzip")
        paths.append(path)
    return paths


def nameless_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under names that no name rule knows, so that content decides:
    each detector has a column that it accepts, and one that misses it by little."""
    li = spread(read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]))
    k, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    h = (k * 7 + p * 3 + n) % 100
    day = F.date_add(F.lit("2023-01-01").cast("date"), (k % 700).cast("int"))
    null = F.lit(None).cast("string")
    digits = F.lpad((k * 13 + p).cast("string"), 8, "0")
    text = lambda c: c.cast("string")
    return li.select(
        # boolean: two words in any case, blanks around; one in ten missing, 8 % other text
        F.when(h % 10 == 9, null).when(h % 2 == 0, F.lit(" YES")).otherwise(F.lit("no ")).alias("aa"),
        F.when(h < 8, F.lit("yes?")).when(h % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("ab"),
        F.when(h % 3 == 0, F.lit("yes")).when(h % 3 == 1, F.lit("no")).otherwise(F.lit("true")).alias("ac"),
        (h % 2 == 0).alias("ad"),
        # phones: 9 to 11 digits with hyphens and blanks; one digit too many on average
        F.when(h < 9, F.lit("1-000")).otherwise(F.concat(F.lit("09"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4))).alias("ba"),
        F.concat(F.lit("0912"), digits).alias("bb"),
        # dates in three spellings; eleven in a hundred don't parse; a date column
        F.when(h % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(h % 3 == 1, F.date_format(day, "d/M/yyyy"))
        .otherwise(F.date_format(day, "yyyy/M/d H:m")).alias("ca"),
        F.when(h < 11, F.lit("in - week 9")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("cb"),
        F.date_format(day, "yyyyMMdd").alias("cc"),
        day.alias("cd"),
        # numbers: grouped money, plain, nine in a hundred words; eleven in a hundred
        F.format_number(F.col("l_extendedprice"), 2).alias("da"),
        F.when(h < 9, F.lit("free")).otherwise(F.concat(F.lit(" -"), text(F.col("l_quantity").cast("int")), F.lit("e1"))).alias("db"),
        F.when(h < 11, F.lit("free")).otherwise(F.concat(F.lit("6"), text(p))).alias("dc"),
        # categories of 2, 33 and 34 values, of texts that differ by a blank only, one value
        F.concat(F.lit("x"), text(h % 2)).alias("ea"), F.concat(F.lit("x"), text(p % 33)).alias("eb"),
        F.concat(F.lit("x"), text(p % 34)).alias("ec"), F.concat(F.repeat(F.lit(" "), (p % 40).cast("int")), F.lit("x")).alias("ed"),
        F.lit("same").alias("ee"), F.concat(F.lit("x"), text(k), F.lit("/"), text(n)).alias("ef"), null.alias("eg"))


def product_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product list (FIXTURES.md §3.2) with ``pos`` = file order; parts with
    p_partkey < 100 appear a second time, later, with price + 1."""
    p = read_table(spark, sf_dir, "part",
                   ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    pk = F.col("p_partkey")
    base = p.select(
        pk.alias("pos"),
        F.concat((F.lit(8930000000000) + pk).cast("string"),
                 F.when(pk % 4 == 0, F.lit(".0")).otherwise(F.lit(""))).alias("ean"),
        F.when(pk % 50 == 0, F.lit("DEMO")).otherwise(F.col("p_type")).alias("cat"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("GB"),
                 F.when(pk % 7 == 0, F.lit("-blk")).otherwise(F.lit(""))).alias("product_name"),
        F.concat(F.lit("A"), pk.cast("string")).alias("sap_article"),
        F.when(pk % 3 == 0, F.lit(None).cast("string"))
        .when(pk % 5 == 0, F.concat(F.lit("space grey/"), F.col("p_name")))
        .otherwise(F.col("p_brand")).alias("sap_description"),
        F.when(pk % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("detail_sub_lob"),
        F.col("p_retailprice").alias("price"),
    )
    dups = (base.filter(F.col("pos") < 100)
            .withColumn("pos", F.col("pos") + F.lit(1 << 40))
            .withColumn("price", F.col("price") + 1.0))
    return base.unionByName(dups)


def traffic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily store traffic per series: (series, period, traffic) from events."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type"])
    return (ev.groupBy(F.col("event_type").alias("series"),
                       F.to_date("ts").alias("period"))
            .agg(F.count(F.lit(1)).alias("traffic")))


def traffic_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The traffic table split in three "yearly" files (thirds of the month)."""
    t = traffic_view(spark, sf_dir)
    d = F.dayofmonth("period")
    return [t.filter(d <= 10), t.filter((d > 10) & (d <= 20)), t.filter(d > 20)]


# Fixed calendar rows for the holiday lookup (one row matches no day).
HOLIDAYS = [("2024-01-01", "New Year"), ("2024-01-15", "Mid Month Sale"),
            ("2024-03-08", "Women Day")]


def holiday_calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "period string, event_name string").select(
        F.col("period").cast("date").alias("period"), "event_name")
