"""Integer exchange encodings: degrees, lengths, bearings and elevations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._base import ColumnLike, clamp, col, half_even, half_up, whole


def to_e7(degrees: ColumnLike) -> Column:
    return half_even(col(degrees) * 1e7)


def to_dm(metres: ColumnLike) -> Column:
    return half_even(col(metres) * 10)


def to_cdeg(degrees: ColumnLike) -> Column:
    return F.pmod(half_even(col(degrees) * 100), F.lit(36000).cast("bigint"))


def from_e7(value: ColumnLike) -> Column:
    return col(value) / 1e7


def from_dm(value: ColumnLike) -> Column:
    return col(value) / 10.0


def from_cdeg(value: ColumnLike) -> Column:
    return col(value) / 100.0


def terrarium_encode(metres: ColumnLike) -> Column:
    """Struct r, g, b of an elevation offset by 32768 m."""
    v = col(metres) + 32768.0
    byte = lambda x: clamp(whole(x), F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))
    return F.struct(byte(v / 256.0).alias("r"),
                    byte(F.pmod(v, F.lit(256.0))).alias("g"),
                    byte((v - F.floor(v)) * 256.0).alias("b"))


def terrarium_decode(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    return col(r) * 256.0 + col(g) + col(b) / 256.0 - 32768.0


def elevation_int16_dm(metres: ColumnLike) -> Column:
    """Decimetres clamped to the 16-bit range."""
    return clamp(half_up(col(metres) * 10), F.lit(-32768).cast("bigint"), F.lit(32767).cast("bigint"))
