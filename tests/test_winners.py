"""Winners per key against plain Python, and their plans."""

import random

from tillroll.operators.customers import code_customers, customer_master
from tillroll.operators.ordering import keep_first_per_key


def people(n=600, seed=9):
    r = random.Random(seed)
    names = [None, "", "An", "Binh", "Cuc Hoa", "Dung Anh", "Étienne", "x" * 300]
    mails = [None, "a@b.vn", "long.address@shop.vn", "same@len.vn", "emas@len.vn"]
    phones = ["0912345678", "912345678", "00912345678", "0900000000", "0900000000", "0900000000", None, "12", "abc"]
    return [(pos * 3 - 500, r.choice(phones), r.choice(names), r.choice(mails)) for pos in r.sample(range(10 * n), n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pos long, phone string, name string, email string").repartition(3)


def test_customer_master(spark):
    rows = people()
    best = {}
    for pos, phone, name, mail in rows:
        rank = (len(name or ""), len(mail or ""), -pos)
        if phone is not None and rank > best.get(phone, ((-1, 0, 0),))[0]:
            best[phone] = (rank, name, mail)
    got = {r.phone: (r.name, r.email) for r in customer_master(frame(spark, rows)).collect()}
    assert got == {p: b[1:] for p, b in best.items()}
    assert customer_master(frame(spark, rows).limit(0)).count() == 0


def test_numbers_with_one_code_become_one_row(spark):
    master = spark.createDataFrame([("0912345678", "An", "a@b.vn"), ("912345678", "Bo", "a@b.vn"), ("00912345678", "Bo", None),
                                    ("0900000000", None, None), ("abc", "no number", None)], "phone string, name string, email string")
    got = {r.id: r.name for r in code_customers(master, 5).collect()}
    assert sorted(got.values()) == ["", "Bo"]


def test_first_per_key(spark):
    rows = people()
    first = {}
    for r in rows:
        k = r[1], r[2]
        if k not in first or r[0] < first[k][0]:
            first[k] = r
    got = keep_first_per_key(frame(spark, rows), ["phone", "name"], "pos").collect()
    assert sorted(map(tuple, got)) == sorted(first.values())


def test_no_sort_aggregates(spark):
    from tillroll.plans.queries import QUERIES
    for name in ("customer_master", "product_master"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString(), name
