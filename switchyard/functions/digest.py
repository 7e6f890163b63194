"""Exact modulus of a 128-bit md5 digest.

The hex digest is read as two 60-bit parts and one byte:
``digest = (hi * 2^60 + lo) * 256 + last``.  Each part fits a bigint and is
reduced before it is combined, so no step overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_part(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def digest_mod(digest: Column, modulus: int) -> Column:
    """int(digest, 16) mod ``modulus``."""
    if 256 % modulus == 0:
        return _hex_part(digest, 31, 2) % modulus
    return (digest_high_mod(digest, modulus) * 256 + _hex_part(digest, 31, 2)) % modulus


def digest_high_mod(digest: Column, modulus: int) -> Column:
    """(int(digest, 16) >> 8) mod ``modulus``."""
    if not 0 < modulus < 2**31:
        raise ValueError("modulus must be positive and below 2^31")
    high = _hex_part(digest, 1, 15) % modulus
    low = _hex_part(digest, 16, 15) % modulus
    return (high * (2**60 % modulus) + low) % modulus


def digest_fraction(text: Column) -> Column:
    """A uniform number in [0, 1) from the first 8 hex digits of md5(text)."""
    return _hex_part(F.md5(text), 1, 8) / float(2**32)
