"""Lookups against a plain left join; a key on nine tenths of the lines, null
keys, and how evenly the lines are dealt out."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators.lookup import frequent_keys, lookup


def lines(spark, n=40_000):
    i = F.col("id")
    return spark.range(0, n, 1, 6).select(
        i.alias("line"), F.when(i % 10 < 7, F.lit("hot")).when(i % 10 == 7, F.lit(None).cast("string"))
        .when(i % 100 == 8, F.lit("no such key")).otherwise(F.concat(F.lit("k"), (i % 997).cast("string"))).alias("k"),
        F.lit("same").alias("v"))


def table(spark):
    rows = [(f"k{i}", i, None if i % 5 else "x") for i in range(500)] + [("hot", -1, None), ("unused", 0, "y")]
    return spark.createDataFrame(rows, "k string, a int, b string")


@pytest.fixture
def shuffled_joins(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def rows(df):
    return sorted(map(tuple, df.select("line", "k", "v", "a", "b").collect()))


def test_equals_a_left_join(spark):
    left, right = lines(spark), table(spark)
    assert frequent_keys(left, {"k": F.col("k")})["k"] == ["hot"]
    want = rows(left.join(right, "k", "left"))
    for hot in (None, [], ["hot"], ["hot", "k1", "unused", "absent"]):
        assert rows(lookup(left, right, "k", hot)) == want


def test_no_task_has_twice_the_median(spark, shuffled_joins):
    out = lookup(lines(spark), table(spark), "k")
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plain = lines(spark).join(table(spark).hint("merge"), "k", "left")
    assert plain.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] > 0.6 * 40_000


def test_odd_lines(spark):
    left, right = lines(spark, 30), table(spark)
    none = left.withColumn("k", F.lit(None).cast("string"))
    assert [r[3:] for r in rows(lookup(none, right, "k"))] == [(None, None)] * 30
    assert lookup(left.limit(0), right, "k").count() == 0
    assert rows(lookup(left, right.limit(0), "k")) == rows(left.join(right.limit(0), "k", "left"))
    same = left.select(F.lit(1).alias("line"), F.lit("hot").alias("k"), "v")  # equal lines
    assert rows(lookup(same, right, "k")) == [(1, "hot", "same", -1, None)] * 30
