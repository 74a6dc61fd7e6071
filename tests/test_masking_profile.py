"""Price masking (N5), PCHIP (W7), series masking (N6) and name rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import products as P
from tillroll.operators.interpolate import pchip_fill
from tillroll.operators.masking import mask_series
from tillroll.operators.profile import classify_by_name


def _pchip_ref(x, y, xs):
    """Fritsch–Carlson PCHIP written from the published formulas."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    h = np.diff(x)
    m = np.diff(y) / h
    n = len(x)
    d = np.zeros(n)
    if n == 2:
        d[:] = m[0]
    else:
        for k in range(1, n - 1):
            if m[k - 1] * m[k] <= 0:
                d[k] = 0.0
            else:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (w1 + w2) / (w1 / m[k - 1] + w2 / m[k])

        def edge(h0, h1, m0, m1):
            e = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
            if np.sign(e) != np.sign(m0):
                return 0.0
            if np.sign(m0) != np.sign(m1) and abs(e) > 3 * abs(m0):
                return 3 * m0
            return e

        d[0] = edge(h[0], h[1], m[0], m[1])
        d[-1] = edge(h[-1], h[-2], m[-1], m[-2])
    out = []
    for t in xs:
        k = np.searchsorted(x, t) - 1
        k = min(max(k, 0), n - 2)
        hk = x[k + 1] - x[k]
        s = (t - x[k]) / hk
        h00, h10 = 2 * s**3 - 3 * s**2 + 1, s**3 - 2 * s**2 + s
        h01, h11 = -2 * s**3 + 3 * s**2, s**3 - s**2
        out.append(h00 * y[k] + h10 * hk * d[k] + h01 * y[k + 1] + h11 * hk * d[k + 1])
    return out


def test_pchip_matches_reference_formulas(spark):
    vals = [None, 3.0, None, 5.0, 9.0, None, None, 4.0, 4.5, None, 10.0, None]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "s string, t int, v double")
    got = {r["t"]: r["f"] for r in pchip_fill(df, ["s"], "t", "v", "f", extrapolate=False).collect()}
    kx = [i for i, v in enumerate(vals) if v is not None]
    ky = [vals[i] for i in kx]
    inner = [i for i, v in enumerate(vals) if v is None and kx[0] < i < kx[-1]]
    ref = dict(zip(inner, _pchip_ref(kx, ky, inner)))
    for i in inner:
        assert got[i] == pytest.approx(ref[i], rel=1e-12)
    assert got[0] is None and got[11] is None           # leading / trailing stay null
    assert got[1] == 3.0                                 # known values kept
    ext = {r["t"]: r["f"] for r in pchip_fill(df, ["s"], "t", "v", "f").collect()}
    assert ext[11] is not None and ext[0] is None


def test_pchip_two_points_is_linear(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, None), ("a", 3, 4.0)],
                               "s string, t int, v double")
    got = {r["t"]: r["f"] for r in pchip_fill(df, ["s"], "t", "v", "f").collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == pytest.approx(3.0)


def test_price_mask_rules(spark):
    cfg = P.price_scale_config(spark, {"A": {"scale": [0.5, 1.5], "mag": 10, "sfx": 9},
                                       "ONE": {"scale": [0.8, 1.2], "mag": 10, "sfx": 9},
                                       "EQ": {"scale": [0.9, 1.1], "mag": 1, "sfx": 0}})
    rows = [("a1", "A", 100.0), ("a2", "A", 200.0), ("a3", "A", 300.0), ("a4", "A", 50.0),
            ("o1", "ONE", 100.0), ("e1", "EQ", 10.0), ("e2", "EQ", 10.0), ("x1", "NOCFG", 10.0)]
    df = spark.createDataFrame(rows, "k string, cat string, price double")
    out = {r["k"]: r["new_price"] for r in P.mask_prices(df, cfg, 42, "k", noise_sd=0.0).collect()}
    # 2nd lowest of A is 100, highest 300: 50 and 100 get 0.5, 300 gets 1.5, 200 gets 1.0
    assert out["a4"] == 29.0 and out["a1"] == 59.0 and out["a2"] == 209.0 and out["a3"] == 459.0
    assert out["o1"] == 129.0           # one row: lo = hi -> rate_max
    assert out["e1"] == 11.0 and out["e2"] == 11.0
    assert out["x1"] is None            # category without configuration


def test_mask_series_shape(spark):
    rows = [("s", i, float(100 + 10 * i + (i % 3) * 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, day int, traffic double")
    out = mask_series(df, ["series"], "day", "traffic", (0.6, 1.4), 42).orderBy("day").collect()
    vals = [r["new_traffic"] for r in out]
    assert "traffic" not in out[0].asDict()
    known = [v for v in vals if v is not None]
    assert all(v % 10 == 0 for v in known)
    assert len(known) >= 30


def test_classify_by_name():
    pockets, pending = classify_by_name([
        "Order_Date", "created_time", "unit_price", "disc_amount", "total_amount", "amount",
        "ship_amount", "is_member", "status", "cat", "invoice_no", "sku", "phone", "xyz"])
    flat = {c: p for p, cs in pockets.items() for c in cs}
    assert flat["Order_Date"] == "date_col" and flat["created_time"] == "date_col"
    assert flat["unit_price"] == "price"
    assert flat["disc_amount"] == "numeric_col"
    assert flat["total_amount"] == "revenue" and flat["amount"] == "revenue"
    assert "ship_amount" in pending
    assert flat["is_member"] == "boolean_col" and flat["status"] == "boolean_col"
    assert flat["cat"] == "category_col"
    assert flat["invoice_no"] == "string_col" and flat["sku"] == "string_col"
    assert set(pending) == {"ship_amount", "phone", "xyz"}


def test_content_decisions(spark):
    """Boolean, date, phone, number, category and text by content; padded and
    differently written values count as they should."""
    from tillroll.operators.profile import classify_columns
    rows = [("Yes " if i % 3 else " no", f"{1 + i % 28}/{1 + i % 12}/2024", f"09{i:08d}", f"{i},{i:03d}.5" if i else "0",
             f"group {i % 30}", f"text {i}", str(i % 3), "  " * (i % 40) + "same", None, 1.5 * i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "flag string, when_x string, contact string, worth string, kindx string, note string, "
                                     "few string, padded string, empty string, amt double")
    pockets, _ = classify_columns(df)
    flat = {c: p for p, cs in pockets.items() for c in cs}
    assert flat == {"flag": "boolean_col", "when_x": "date_col", "contact": "phone_col", "worth": "numeric_col",
                    "kindx": "category_col", "note": "string_col", "few": "numeric_col", "padded": "string_col",
                    "empty": "string_col", "amt": "numeric_col"}
