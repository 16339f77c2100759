"""Exact percentiles per key by radix refinement: no window holds the values of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bins per octave in the first pass and, inside each of them, in the second one (powers of two).
COARSE_BITS, FINE_BITS = 4, 16


def scale_of(value: Column) -> Column:
    """A double that never falls as `value` rises and grows evenly with its magnitude: exponent plus mantissa, mirrored for negatives.

    Outliers therefore cost a few bins and do not widen the others.
    """
    v = value.cast("double")
    size = F.greatest(F.abs(v), F.lit(2.0 ** -1000))
    exponent = F.floor(F.log2(size))
    scale = exponent + (size / F.pow(F.lit(2.0), exponent) - 1) + 1001
    scale = F.when(size == float("inf"), F.lit(2100.0)).otherwise(scale)
    return F.when(F.abs(v) <= 2.0 ** -1000, 0.0).when(v < 0, -scale).otherwise(scale)


def _holding(bins: DataFrame, group: Sequence[str], by: str, ranks: Sequence[str]) -> DataFrame:
    """Bins that hold wanted ranks, with each rank counted from the bin's own start (NULL where it lies elsewhere)."""
    before = F.sum("_w").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    own = {r: F.when((F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_w")), F.col(r) - F.col("_before")) for r in ranks}
    return bins.withColumn("_before", before).withColumns(own).filter(F.coalesce(*ranks).isNotNull()).drop("_before", "_w")


def percentiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], value: str = "h", weight: str = "n") -> DataFrame:
    """(keys, `<weight>_total`, one column per wanted share): linearly interpolated percentiles of weighted values.

    Values are counted in bins of their leading digits; bins that hold a wanted rank are
    counted again by the next digits, and only the values of the few bins left are looked
    at themselves. The first window has at most some thousand bins of a key, the second
    65,536 bins of one bin, the last the distinct values within a millionth of each other.
    Equal values are one, so copies do not count. Values that are null or NaN take no part;
    keys must not be null. `rows` is read twice: cut its lineage where it is costly.
    """
    keys, names = list(keys), list(wanted)
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    coded = known.select(*keys, F.col(value).alias("_v"), F.col(weight).cast("bigint").alias("_w"),
                         F.floor(scale_of(F.col(value)) * 2 ** (COARSE_BITS + FINE_BITS)).alias("_fine"))
    fine = coded.groupBy(*keys, "_fine").agg(F.sum("_w").alias("_w")).withColumn("_coarse", F.shiftright("_fine", FINE_BITS))
    coarse = fine.groupBy(*keys, "_coarse").agg(F.sum("_w").alias("_w")).withColumn("_total", F.sum("_w").over(Window.partitionBy(*keys)))
    place = {n: (F.col("_total") - 1) * float(wanted[n]) for n in names}
    ranks = [f"_r{k}" for k in range(2 * len(names))]
    asked = {f"_r{2 * i + side}": end(place[n]) for i, n in enumerate(names) for side, end in enumerate((F.floor, F.ceil))}
    first = _holding(coarse.withColumns(asked), keys, "_coarse", ranks)
    second = _holding(fine.join(first, [*keys, "_coarse"]), [*keys, "_coarse"], "_fine", ranks).drop("_coarse")
    kept = [F.first(c).alias(c) for c in ("_total", *ranks)]
    values = coded.join(second, [*keys, "_fine"]).groupBy(*keys, "_fine", "_v").agg(F.sum("_w").alias("_w"), *kept)
    found = _holding(values, [*keys, "_fine"], "_v", ranks)
    at = found.groupBy(*keys).agg(F.first("_total").alias("_total"), *[F.max(F.when(F.col(r).isNotNull(), F.col("_v"))).alias(r) for r in ranks])
    low, high = (lambda i: F.col(f"_r{2 * i}")), (lambda i: F.col(f"_r{2 * i + 1}"))
    mixed = [(low(i) + (high(i) - low(i)) * (place[n] - F.floor(place[n]))).alias(n) for i, n in enumerate(names)]
    return at.select(*keys, F.col("_total").alias(f"{weight}_total"), *mixed)


def with_percentiles(hist: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], value: str = "h", weight: str = "n") -> DataFrame:
    """`hist` with its keys' percentiles and `<weight>_total` added by a join on the keys."""
    return hist.join(percentiles(hist, keys, wanted, value, weight), list(keys))
