"""Seeded scatter: a 32-bit linear recurrence and the instance rules built on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ._base import ColumnLike, clamp, col

# Fixed values of the recurrence s -> s * A + C (mod 2^32).
SEED_A, SEED_C, MASK32 = 0x27D4EB2D, 0x9E3779B9, 0xFFFFFFFF
INSTANCE_METRES, INSTANCE_MIN, INSTANCE_MAX = 4.4, 0.4, 3.2
CONIFER_BELOW = 100


def next_seed(seed: Column) -> Column:
    """One step. The multiplier is split so no product leaves 63 bits."""
    low = F.lit(SEED_A & 0xFFFF) * seed
    high = F.shiftleft((F.lit(SEED_A >> 16) * seed).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high + F.lit(SEED_C)).bitwiseAND(F.lit(MASK32))


def seed_sequence(seed: ColumnLike, n) -> Column:
    """The next n seeds as an array."""
    start = col(seed).cast("bigint")
    step = lambda acc, _: F.concat(acc, F.array(next_seed(F.coalesce(F.try_element_at(acc, F.lit(-1)), start))))
    empty = F.slice(F.array(start), F.lit(1), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n) if isinstance(n, int) else n), empty, step)


def unit(seed: Column) -> Column:
    """Seed to [0, 1)."""
    return seed / 4294967296.0


def instance_scale(metres: ColumnLike) -> Column:
    return clamp(col(metres) / INSTANCE_METRES, INSTANCE_MIN, INSTANCE_MAX)


def is_conifer(seed: ColumnLike) -> Column:
    return col(seed).bitwiseAND(F.lit(255)) < CONIFER_BELOW


def instance_yaw(seed: ColumnLike) -> Column:
    return unit(col(seed)) * (2 * math.pi)


def instance_tint(seed: ColumnLike) -> Column:
    """Brightness offset within 7 %."""
    return (F.shiftrightunsigned(col(seed), 8) / 16777216.0 - 0.5) * 0.14
