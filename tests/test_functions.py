"""Row-local functions against hand-computed values and stdlib brute force."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tillroll.functions import dates as D
from tillroll.functions import numeric as M
from tillroll.functions import pseudonym as N
from tillroll.functions import text as X


def _col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_phone(spark):
    vals = ["1234567", "12345678", "012345678", "912345678", "0912345678", "09123456789",
            "091234567890", "84912345678", "+84 912 345 678", "0084 912345678", None, "unknown"]
    got = _col(spark, vals, lambda c: X.clean_phone(X.normalize_ws(c)))
    assert got == [None, None, None, "0912345678", "0912345678", "09123456789", None,
                   "0912345678", "0912345678", None, None, None]


def test_email_valid_and_mask(spark):
    vals = ["  User12@Shop.VN ", "bad.address", "ab@x.vn", "a@x.vn", "abc@x.vn", None]
    valid = _col(spark, vals, lambda c: X.valid_email(X.normalize_ws(c)))
    assert valid == ["user12@shop.vn", None, "ab@x.vn", "a@x.vn", "abc@x.vn", None]
    masked = _col(spark, valid, X.mask_email)
    assert masked == ["u****2@shop.vn", "", "a*@x.vn", "a@x.vn", "a*c@x.vn", ""]


def test_title_name(spark):
    got = _col(spark, ["  john   SMITH ", "unknown", None], lambda c: X.title_name(X.normalize_ws(c)))
    assert got == ["John Smith", None, None]


def test_base32_codes_match_stdlib(spark):
    vals = [0, 1, 912345678, 99999999999, (1 << 40) - 1]
    got = _col(spark, vals, lambda c: N.base32_of_int(c, 5), "bigint")
    want = [base64.b32encode(v.to_bytes(5, "big")).decode().rstrip("=") for v in vals]
    assert got == want
    eans = [8930000000001, 8930000000777, 123]
    got7 = _col(spark, eans, lambda c: N.base32_of_int(c, 7), "bigint")
    assert got7 == [base64.b32encode(v.to_bytes(7, "big")).decode().rstrip("=") for v in eans]
    assert _col(spark, [1 << 40], lambda c: N.base32_of_int(c, 5), "bigint") == [None]


def test_serial_hash_matches_stdlib(spark):
    vals = ["350000000001001", "abc", "unknown", None]
    got = _col(spark, vals, lambda c: N.serial_hash(c, 7919))

    def ref(s):
        if s is None or s == "unknown":
            return "unknown"
        h = hashlib.sha256(s.encode() + b"7919").digest()
        return base64.b32encode(h).decode()[0:50:5]

    assert got == [ref(v) for v in vals]


def test_customer_id(spark):
    assert _col(spark, ["abcdefgh"], N.customer_id) == ["CUS-ABCD-EFGH"]


def test_keyed_gaussian_is_standard_normal(spark):
    df = spark.range(20000).select(N.keyed_gaussian(F.col("id"), 42).alias("z"))
    r = df.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(r["m"]) < 0.05 and abs(r["s"] - 1) < 0.05
    again = spark.range(20000).repartition(7).select(
        F.col("id"), N.keyed_gaussian(F.col("id"), 42).alias("z"))
    a = dict(again.collect())
    b = dict(spark.range(20000).select(F.col("id"), N.keyed_gaussian(F.col("id"), 42)).collect())
    assert a == b   # independent of partitioning


def test_parse_date_and_time(spark):
    vals = ["2024-01-05", "2024-1-5", "05-01-2024", "5-1-2024", "2024/01/05", "2024-01-05x", "", None]
    got = [str(x) if x else None for x in _col(spark, vals, D.parse_date)]
    assert got == ["2024-01-05", "2024-01-05", "2024-01-05", "2024-01-05", None, None, None, None]
    lenient = [str(x) if x else None for x in _col(spark, vals, D.parse_date_lenient)]
    assert lenient[4] == "2024-01-05" and lenient[6] is None
    times = _col(spark, ["8:05am", "20:30:00", "16:20", "n/a", "8:05 pm"], D.parse_time)
    assert [t.strftime("%H:%M:%S") if t else None for t in times] == [
        "08:05:00", "20:30:00", "16:20:00", None, None]
    assert all(t.year == 1900 for t in times if t)


def test_date_tokens(spark):
    got = _col(spark, ["2024/01/05", "05-01-2024 10", "abc", "1 1 2024"], D.date_tokens)
    assert [sorted(x) for x in got] == [[1, 5, 2024], [1, 5, 10, 2024], [], [1, 2024]]


def test_numbers(spark):
    vals = ["12", " 12.5 ", "5d", "NaN", "1e3", "abc", "-3", None]
    assert _col(spark, vals, M.to_number) == [12.0, 12.5, None, None, 1000.0, None, -3.0, None]
    assert _col(spark, ["1,234.50", "12"], M.comma_to_number) == [1234.5, 12.0]
    import numpy as np
    vals2 = [2.675, 0.005, 0.015, 2.5, 12.345, -0.125]
    # same as the array library's binary-scaled rounding
    assert _col(spark, vals2, lambda c: M.round_half_even(c, 2), "double") == [
        float(x) for x in np.round(np.array(vals2), 2)]
    assert _col(spark, [1235.0, 1245.0, 1251.0], lambda c: M.round_half_even(c, -1), "double") == [
        1240.0, 1240.0, 1250.0]


def test_clamp_interp_equal_bounds(spark):
    df = spark.createDataFrame([(5.0,), (1.0,), (9.0,)], "x double")
    got = [r[0] for r in df.select(M.clamp_interp("x", F.lit(5.0), F.lit(5.0), F.lit(0.8),
                                                 F.lit(1.2))).collect()]
    assert got == [1.2, 0.8, 1.2]


def test_colour_and_size(spark):
    df = spark.createDataFrame([
        ("iPhone 15 256GB", "space grey/titanium"), ("case-blk", None), ("powered hub", "x"),
        ("watch 45 mm", "Starlight"), ("nothing", None)], "n string, d string")
    rows = df.select(X.extract_color("n", "d").alias("c"),
                     X.extract_size("n", F.lit("IPHONE")).alias("s")).collect()
    assert [r["c"] for r in rows] == ["Space Grey", "Black", "Red", "Starlight", None]
    assert [r["s"] for r in rows] == ["256GB", None, None, "45mm", None]
    demo = df.select(X.extract_size("n", F.lit("demo unit")).alias("s")).collect()
    assert all(r["s"] is None for r in demo)


def test_commas_must_group_thousands(spark):
    assert _col(spark, ["1,234", "12,5", "1,2,3", "-1,234,567.25", "7", None], M.comma_to_number) == [
        1234.0, None, None, -1234567.25, 7.0, None]


def test_unpadded_times_and_typed_dates(spark):
    from pyspark.sql import functions as F

    from tillroll.functions import dates as D
    df = spark.createDataFrame([("20:5",), ("8:5am",), ("20:30:0",), ("7",)], "t string")
    assert [r[0] for r in df.select(D.time_of_day(D.parse_time("t"))).collect()] == ["20:05:00", "08:05:00", "20:30:00", None]
    day = spark.sql("SELECT timestamp'2024-03-05 10:11:12' AS a, timestamp_ntz'2024-03-05 10:11:12' AS b, date'2024-03-05' AS c, '5-3-2024' AS d, 'x' AS e")
    got = day.select(*[D.parse_date(c).cast("string").alias(c) for c in "abcde"]).first()
    assert list(got) == ["2024-03-05"] * 4 + [None]
    assert F is not None


def test_whole_word_colours(spark):
    rows = [("powered red-hub", None, "Red"), ("powered organizer", "ink/jet", "Ink"), ("blue fogs", "", "Blue"),
            ("winter blue", "blue jay", "Winter Blue"), ("skyline", "reddish", None), ("blk", "wht", "Black"),
            ("đred", "red2", None), (None, None, None), ("", "red", "Red")]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, d string")
    got = df.select(X.extract_color("n", "d", whole_word=True).alias("w"), X.extract_color("n", "d").alias("s")).collect()
    assert [r["w"] for r in got] == [r[2] for r in rows]
    texts = [" ".join(f"{r[0] or ''} {r[1] or ''}".replace("/", " ").replace("-", " ").split(" ")) for r in rows]
    want = [next((k for k in X.sorted_color_keywords() if k in t), None) for t in texts]
    assert [r["s"] for r in got] == [None if k is None else X.COLOR_NAMES.get(k, k.title()) for k in want]


def test_keyword_pattern():
    import re
    pattern = re.compile(f"(?=({X.keyword_pattern(X.COLOR_KEYWORDS)}))")
    assert [m[1] for m in pattern.finditer("pinkish blue fog")] == ["pink", "ink", "blue fog"]
    assert all(pattern.match(k)[1] == k for k in X.COLOR_KEYWORDS)


def test_phone_numbers_that_do_not_fit(spark):
    df = spark.createDataFrame([("0912345678",), ("9" * 13,), ("no number",), (None,)], "p string")
    assert [r[0] for r in df.select(N.fits_phone_code("p", 5)).collect()] == [True, False, False, None]
    assert [r[0] is None for r in df.select(N.phone_code("p", 5)).collect()] == [False, True, True, True]
    with pytest.raises(Exception, match="does not fit"):
        df.select(N.phone_code("p", 5, strict=True)).collect()
    good = df.filter("p is null or p like '09%'")
    assert [r[0] is None for r in good.select(N.phone_code("p", 5, strict=True)).collect()] == [False, True]


def test_keyed_ids_with_collisions(spark):
    import hashlib

    from tillroll.operators.customers import keyed_customers
    phones = [f"09{i:08d}" for i in range(200)]
    df = spark.createDataFrame([(p,) for p in phones * 2] + [(None,)], "phone string")
    got = {r["phone"]: r["id"] for r in keyed_customers(df.repartition(5), 7, n_chars=1).collect()}
    assert sorted(got) == phones and len(set(got.values())) == 200
    groups = {}
    for p in phones:
        digest = hashlib.sha256(f"{p}7".encode()).digest()
        groups.setdefault("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[digest[0] >> 3], []).append((digest.hex(), p))
    want = {p: f"CUS-{code}-" + (f"-{n}" if n > 1 else "") for code, g in groups.items() for n, (_, p) in enumerate(sorted(g), 1)}
    assert got == want
    assert {r["phone"]: r["id"] for r in keyed_customers(df.repartition(2), 7, n_chars=1).collect()} == got
    assert keyed_customers(df.limit(0), 7).count() == 0


def test_date_layout_votes(spark):
    from tillroll.functions import dates as D
    rows = [("3/4/2020", "3/4/2020", "1/2/2020", None), ("4-25-2020", "25-4-2020", "x", None), ("2020-01-02", "13/13/2020", "", None),
            ("25/4/2020", "4/25/2020", "2020-13-01", None), (" 12/31/2020 ", "31/12/2020", "99-99-2020", None)]
    df = spark.createDataFrame(rows, "us string, eu string, few string, none string")
    votes = D.layout_votes(df, df.columns)
    assert votes == {"us": True, "eu": False, "few": False, "none": False}
    got = [list(map(str, r)) for r in df.select(*[D.parse_date_voted(c, v) for c, v in votes.items()]).collect()]
    assert [r[0] for r in got] == ["2020-03-04", "2020-04-25", "2020-01-02", "2020-04-25", "2020-12-31"]
    assert [r[1] for r in got] == ["2020-04-03", "2020-04-25", "None", "2020-04-25", "2020-12-31"]
    assert [r[2] for r in got] == ["2020-02-01"] + ["None"] * 4 and {r[3] for r in got} == {"None"}
    assert D.layout_votes(df.limit(0), ["us"]) == {"us": False}
