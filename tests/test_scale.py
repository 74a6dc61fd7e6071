"""Steps that were rewritten to grow with the input: same results, less work."""

from pyspark.sql import functions as F

from tillroll.functions import dates as D
from tillroll.operators import customers as C
from tillroll.operators import profile as PR
from tillroll.operators import reports as R
from tillroll.operators.ordering import DEFAULT_BUCKET_ROWS
from tillroll.plans.queries import QUERIES
from tillroll.plans.sales import load_exports
from tillroll.sources.fixtures import sales_lines, write_yearly_exports


def test_date_predicates_equal_the_parsers(spark):
    texts = ["2024-01-05", " 5/1/2024 ", "20240105", "20241399", "2024/1/5 7:08", "5-1-2024 7:08:09", "5 jan 2024", "Jan 5, 2024",
             "5 January 2024", "may 1 2020", "in - week 9", "x12/3", "yes", " ", "", None, "nan", "8:05am", "20:30:00", " 16:20 ",
             "25:61", "n/a", ":", "20240105\n", "1-1-2020\n", "0x1 5", "12345678 9", "2024-01-05T07:08", "31/12/1999", "١/٢/2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", D.parse_date_lenient("t").isNotNull().alias("a"), D.reads_as_date("t").alias("b"),
        D.parse_time("t").isNotNull().alias("c"), D.reads_as_time("t").alias("d")).collect()
    assert [r for r in rows if (r.a, r.c) != (r.b, r.d)] == []
    assert sum(r.a for r in rows) >= 10 and sum(r.c for r in rows) == 3


def test_profile_evidence(spark):
    rows = [("a-b,c d", "2024-01-05", 12), ("\t1,234.50", "8:05am", -3), ("0912 345-678", "none", None), (None, " 20240105 ", 7)]
    text, when, number = PR.profile_columns(spark.createDataFrame(rows, "x string, y string, z int"), ["x", "y", "z"])
    assert (text.n, text.phone_len, text.date_sep, text.money) == (3, (4 + 7 + 10) / 3, 2 / 3, 1 / 3)
    assert (when.date_parse, when.date_sep, when.distinct) == (0.75, 0.75, 4)
    assert (number.n, number.numeric, number.date_parse, number.phone_len) == (3, 1.0, 0.0, (2 + 1 + 1) / 3)


def _counted(spark, df):
    """``df`` with a counter of the rows that the runs over it read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, folder):
    """Orders of three customers, 60 lines; one order has no customer."""
    spark.range(20).selectExpr("id AS o_orderkey", "if(id = 19, 99, id % 3) AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(3).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").write.parquet(f"{folder}/customer.parquet")
    spark.range(4).selectExpr("id AS p_partkey", "'PROMO' AS p_type").write.parquet(f"{folder}/part.parquet")
    spark.range(60).selectExpr(
        "id div 3 AS l_orderkey", "id % 4 AS l_partkey", "id % 5 AS l_suppkey", "int(id % 3 + 1) AS l_linenumber",
        "double(id % 7 + 1) AS l_quantity", "double(id * 10) AS l_extendedprice", "0.1D AS l_discount").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_quantiles_read_their_input_once(spark):
    df, seen = _counted(spark, spark.range(5000).selectExpr("double(id * 37 % 5000) AS v", "double(id % 3) AS w"))
    found = {r.column: (r.n, r.mean, r.quantile) for r in R.exact_quantiles(df, ["v", "w"], 0.5).collect()}
    assert found["v"] == (5000, 2499.5, 2499.5) and found["w"][2] == 1.0
    assert seen.value == 5000


def test_customer_master_reads_its_input_once(spark):
    lines = spark.range(100).selectExpr("id AS pos", "concat('090000000', id % 10) AS phone", "repeat('n', int(id % 4)) AS name", "'a@b.vn' AS email")
    df, seen = _counted(spark, lines)
    assert C.code_customers(C.customer_master(df), 7).count() == 10
    assert seen.value == 100
    # combined before they are cleaned: the same winners
    dirty = lines.withColumns({"phone": F.concat(F.lit(" "), "phone"), "name": F.upper("name")})
    a, b = C.customer_master(C.normalize_customers(dirty)), C.customer_master(C.normalize_customers(C.distinct_spellings(dirty)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 10


def test_numbering_does_not_move_the_lines(spark, tmp_path):
    paths = write_yearly_exports(spark, _tables(spark, tmp_path / "in"), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*/part-*.csv.gz")) and not list((tmp_path / "out").glob("*/part-*.csv"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = load_exports(spark, paths)
        assert "SortMergeJoin" not in _plan(df)
        rows = df.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [r.pos for r in rows] == list(range(1, 58)) and [r.invoice for r in rows] == [i // 3 for i in range(57)]


def test_lines_are_joined_once_for_the_revenue(spark, tmp_path):
    folder = _tables(spark, tmp_path / "in")
    for name in ("revenue_fill", "revenue_alternate", "payment_check"):
        df = QUERIES[name](spark, folder)
        assert "Join" not in _plan(df) and df.count() == 57
    # customers meet the orders, not the lines
    plan = sales_lines(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("l_partkey") < plan.index("p_type") < plan.index("o_custkey")


def test_small_buckets_for_neighbours():
    assert DEFAULT_BUCKET_ROWS <= 1 << 16
