"""Numeric column builders (casts, row-wise sums, rounding, small math)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number: what a coercing numeric parse accepts.  Spark's own
# string -> double cast also accepts '5d', '1f', 'NaN' and 'Infinity'; the guard
# keeps those null, as a coercing parse in the reference does.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUMBER_FIRST_CHARS = list("0123456789+-.\t\n\r\f\x0b")
# Thousands in groups of three.
GROUPED_PATTERN = r"^\s*[+-]?\d{1,3}(,\d{3})+(\.\d*)?\s*$"
# Whole-value sentinels that mean "missing" (fixed values).
SENTINELS_BASIC = ["", "N/A", "na", "n/a", "NaN"]
SENTINELS_DATE = ["", "nan", "nat", "none"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, is_string: bool = True) -> Column:
    """Coercing cast to double, bad text -> null."""
    c = _col(c)
    if not is_string:
        return c.cast("double")
    # cheap first-character test before the regular expression: most text
    # that is not a number is rejected without running the regex
    first = F.substring(F.ltrim(c), 1, 1)
    plausible = first.isin(*NUMBER_FIRST_CHARS)
    return F.when(plausible & c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def comma_to_number(c: str | Column) -> Column:
    """P2: '1,234.50' -> 1234.5; commas that don't group thousands ('12,5')
    are not a number."""
    text = _col(c).cast("string")
    grouped = text.rlike(GROUPED_PATTERN)
    return to_number(F.when(grouped, F.translate(text, ",", "")).otherwise(text))


def sentinel_to_null(c: str | Column, words: Sequence[str] = SENTINELS_BASIC) -> Column:
    """Whole-value sentinels -> null."""
    c = _col(c)
    return F.when(~c.isin(list(words)) | c.isNull(), c)


def finite_or_null(c: str | Column) -> Column:
    """NaN and +/-infinity -> null."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Row-wise sum, nulls count as 0 (an all-null row sums to 0)."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0.0)) for c in cols])


def count_nonzero(cols: Sequence[str | Column]) -> Column:
    """Number of columns whose value is not 0 (null counts as not 0)."""
    return reduce(lambda a, b: a + b,
                  [F.when(_col(c) == 0, F.lit(0)).otherwise(F.lit(1)) for c in cols])


def isclose(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|; null on either side -> false."""
    a, b = _col(a), _col(b)
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """scale, round half to even, unscale — the binary-scaled rounding of
    array libraries (2.675 * 100 is exactly 267.5 in binary, so 2.675 -> 2.68
    there and here)."""
    c = _col(c)
    if digits == 0:
        return F.bround(c, 0)
    if digits > 0:
        s = float(10 ** digits)
        return F.bround(c * F.lit(s), 0) / F.lit(s)
    s = float(10 ** (-digits))
    return F.bround(c / F.lit(s), 0) * F.lit(s)


def pct_change(after: str | Column, before: str | Column) -> Column:
    """(after / before - 1) * 100, null when before is 0 or null."""
    return (F.try_divide(_col(after), _col(before)) - F.lit(1.0)) * F.lit(100.0)


def floor_to_magnitude(x: str | Column, mag: str | Column | float,
                       sfx: str | Column | float) -> Column:
    """floor(x / mag) * mag + sfx (e.g. 1_234_567 -> 1_200_000 + 90_000)."""
    mag_c = _col(mag) if isinstance(mag, (str, Column)) else F.lit(float(mag))
    sfx_c = _col(sfx) if isinstance(sfx, (str, Column)) else F.lit(float(sfx))
    return F.floor(_col(x) / mag_c) * mag_c + sfx_c


def clamp_interp(x: str | Column, lo: str | Column, hi: str | Column,
                 r_lo: str | Column, r_hi: str | Column) -> Column:
    """Piecewise-linear map of [lo, hi] onto [r_lo, r_hi], clamped.

    ``x >= hi`` is tested first so ``lo == hi`` yields ``r_hi``."""
    x, lo, hi, r_lo, r_hi = map(_col, (x, lo, hi, r_lo, r_hi))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(x >= hi, r_hi)
            .when(x <= lo, r_lo)
            .otherwise(r_lo + (x - lo) * (r_hi - r_lo) / (hi - lo)))


# sin((pi / 2) ** 0.2): constant factor of the series masking (fixed value).
SERIES_SIN_FACTOR = math.sin((math.pi / 2) ** 0.2)
