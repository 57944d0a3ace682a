"""Reproducible ranks, coins and draws from md5, equal on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COIN_DIGITS = 15  # 60 bits: fits a signed bigint
COIN_RANGE = float(2**60)


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """Hex md5 of the parts joined with ':'."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def digest_int(*parts) -> Column:
    """Non-negative bigint below 2^60."""
    return F.conv(F.substring(digest(*parts), 1, COIN_DIGITS), 16, 10).cast("bigint")


def coin(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return digest_int(*parts) / F.lit(COIN_RANGE)


def draw_index(n: Column, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return digest_int(*parts) % n
