"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    """Accept a column name or a Column."""
    return F.col(value) if isinstance(value, str) else value


def num(value) -> Column:
    """Accept a column name, a Column or a Python number."""
    return col(value) if isinstance(value, (str, Column)) else F.lit(value)


def clamp(value, low, high) -> Column:
    return F.greatest(F.least(num(value), num(high)), num(low))


def whole(value: Column) -> Column:
    """Floor to bigint, the same in every engine (a bare cast is not)."""
    return F.floor(value).cast("bigint")


def half_even(value: Column) -> Column:
    """Round half to even, the rounding of the baked integer formats."""
    return F.bround(value, 0).cast("bigint")


def half_up(value: Column) -> Column:
    """Round half towards +infinity, the rounding used by the map client."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def explode_items(df: DataFrame, columns, array: Column, pos: str, item: str) -> DataFrame:
    """One row per array element with its position.

    The outer form is used and empty rows are dropped afterwards: for the plain form the
    optimizer infers a filter on the array, which would evaluate a costly array twice.
    """
    return (df.select(*columns, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull()))
