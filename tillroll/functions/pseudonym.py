"""Pseudonymous codes and keyed noise, all as native expressions.

Base32 here is an *encoding* of (value + salt): whoever knows the salt can
recover the value.  ``serial_hash`` is a keyed SHA-256 and is not reversible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit alphabet of conv(..., 32) and the RFC 4648 base32 alphabet.
CONV32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CUSTOMER_PREFIX = "CUS-"
OWN_BRAND_PREFIX = "APP-"
THIRD_PARTY_PREFIX = "3RD-"
UNKNOWN = "unknown"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base32_of_int(v: str | Column, nbytes: int) -> Column:
    """Unpadded base32 of ``v`` written as ``nbytes`` big-endian bytes
    (null when ``v`` does not fit).  nbytes <= 7."""
    if not 1 <= nbytes <= 7:
        raise ValueError("nbytes must be in 1..7")
    v = _col(v).cast("long")
    chars = math.ceil(8 * nbytes / 5)
    pad_bits = 5 * chars - 8 * nbytes
    fits = (v >= 0) & (v < F.lit(1 << (8 * nbytes)))
    digits = F.lpad(F.conv(F.shiftleft(v, pad_bits).cast("string"), 10, 32), chars, "0")
    return F.when(fits, F.translate(digits, CONV32_DIGITS, BASE32_ALPHABET))


def fits_phone_code(phone: str | Column, salt: int, nbytes: int = 5) -> Column:
    """Whether ``phone_code`` has a code for a number; null for a null."""
    v = _col(phone).try_cast("long") + F.lit(salt)
    return F.when(_col(phone).isNotNull(), F.coalesce((v >= 0) & (v < F.lit(1 << (8 * nbytes))), F.lit(False)))


def phone_code(phone: str | Column, salt: int, nbytes: int = 5, strict: bool = False) -> Column:
    """8-character code of (phone number + salt).  A text that is no number,
    or one that doesn't fit, has no code (``fits_phone_code`` tells which, to be
    counted); with ``strict`` it stops the query."""
    code = base32_of_int(_col(phone).try_cast("long") + F.lit(salt), nbytes)
    if not strict:
        return code
    return F.when(F.coalesce(fits_phone_code(phone, salt, nbytes), F.lit(True)), code).otherwise(
        F.raise_error(F.lit("phone_code: a number does not fit its code")).cast("string"))


def customer_id(code: str | Column) -> Column:
    """N2: 'CUS-' + first 4 + '-' + rest, upper case."""
    c = _col(code)
    return F.upper(F.concat(F.lit(CUSTOMER_PREFIX), F.substring(c, 1, 4), F.lit("-"),
                            F.substr(c, F.lit(5))))


def sku_code(ean_number: str | Column, salt: int, own_brand: str | Column) -> Column:
    """12-character base32 of (EAN + salt) in 7 bytes; prefix by brand
    group, then characters 3-7, '-', characters 8-12."""
    code = base32_of_int(F.floor(_col(ean_number) + F.lit(salt)), 7)
    prefix = F.when(_col(own_brand), F.lit(OWN_BRAND_PREFIX)).otherwise(F.lit(THIRD_PARTY_PREFIX))
    return F.concat(prefix, F.substring(code, 3, 5), F.lit("-"), F.substr(code, F.lit(8)))


def serial_hash(serial: str | Column, key: str | int, n_chars: int = 10,
                step: int = 5) -> Column:
    """SHA-256(serial || key) as base32, every ``step``-th character,
    ``n_chars`` characters; null or 'unknown' -> 'unknown'.

    Character j of the base32 text is bits 5j..5j+4 of the digest; it is cut
    from the two hex digits that contain it."""
    s = _col(serial).cast("string")
    hx = F.sha2(F.concat(s, F.lit(str(key))), 256)
    chars = []
    for i in range(n_chars):
        bit = 5 * step * i
        byte_pair = F.conv(F.substring(hx, bit // 4 + 1, 2), 16, 10).cast("int")
        val = F.shiftright(byte_pair, 3 - bit % 4).bitwiseAND(F.lit(31))
        chars.append(F.substring(F.lit(BASE32_ALPHABET), val + 1, 1))
    code = F.concat(*chars)
    return F.when(s.isNull() | (s == UNKNOWN), F.lit(UNKNOWN)).otherwise(code)


def keyed_code(value: str | Column, key: str | int, n_chars: int = 8) -> Column:
    """The first ``n_chars`` base32 characters of SHA-256(value || key); null
    for a null.  Unlike ``phone_code`` it can't be decoded; values may share it."""
    v = _col(value).cast("string")
    return F.when(v.isNotNull(), serial_hash(v, key, n_chars, step=1))


def keyed_gaussian(key: str | Column, seed: int, salt: str = "") -> Column:
    """Standard normal draw that depends only on (seed, key), not on
    partitioning or row order: two uniforms from md5, Box-Muller, rounded to
    6 decimals."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), _col(key).cast("string")))
    two52 = float(1 << 52)
    u1 = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / two52
    u2 = (F.conv(F.substring(h, 14, 13), 16, 10).cast("double") + 0.5) / two52
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.round(z, 6)
