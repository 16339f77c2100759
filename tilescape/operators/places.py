"""Pins, presets and geocoder results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilescape.functions.classify import PIN_MAX_VISIBLE, PIN_RANGE_M, pin_range

from . import cells, nearest

BAY = {"west": -123.1, "south": 37.2, "east": -121.6, "north": 38.2}


def pins_in_range(probes: DataFrame, pins: DataFrame, probe_id: str, x="x", z="z", cell: float | None = None) -> DataFrame:
    """Probe and pin pairs within the pin's tier range (closed), with squared distance `d2`.

    Pins are spread over the cells of their range box, probes have one cell.
    """
    size = cell or max(PIN_RANGE_M.values()) / 2
    reach = pin_range("tier")
    boxed = pins.withColumn("_range", reach).withColumns({
        "_x0": F.col(x) - F.col("_range"), "_x1": F.col(x) + F.col("_range"), "_z0": F.col(z) - F.col("_range"), "_z1": F.col(z) + F.col("_range")})
    boxed = boxed.withColumnsRenamed({x: "_px", z: "_pz"})
    dx, dz = F.col("_px") - F.col(x), F.col("_pz") - F.col(z)
    near = cells.points_in_boxes(probes.select(probe_id, x, z), boxed, size, x, z, ("_x0", "_z0", "_x1", "_z1"),
                                 exact=dx * dx + dz * dz <= F.col("_range") * F.col("_range"))
    return near.withColumn("d2", dx * dx + dz * dz).drop("_range", "_x0", "_x1", "_z0", "_z1", "_px", "_pz")


def nearest_pins(probes: DataFrame, pins: DataFrame, probe_id: str, pin_id: str, x="x", z="z", k: int = PIN_MAX_VISIBLE) -> DataFrame:
    """The k nearest pins in range (closed, by tier) of each probe, with `d2` and `rank`; equal distances take the lower id.

    Only pins that can be among a tier's k nearest are joined with a probe, however many are in range.
    """
    tiers = pins.withColumn("_tier", F.when(F.col("tier").isin(*PIN_RANGE_M), F.col("tier").cast("int")).otherwise(0))  # an unknown tier has range 0
    placed = tiers.withColumnsRenamed({x: "_px", z: "_pz"})
    near = nearest.nearest_points(probes.select(probe_id, x, z), placed, probe_id, pin_id, k, (x, z), ("_px", "_pz"), "_tier", {0: 0.0, **PIN_RANGE_M})
    return near.drop("_px", "_pz", "_tier")


def nearest_k(pairs: DataFrame, by: Sequence[str], order: Sequence[str], k: int = PIN_MAX_VISIBLE, rank="rank") -> DataFrame:
    """The k nearest rows per probe. The row-number limit is applied before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pairs.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def nearest_within(clicks: DataFrame, presets: DataFrame, click_id: str, preset_id: str, radius: float, x="x", y="y") -> DataFrame:
    """The preset nearest to each click, strictly within the radius; equal distances take the lower id."""
    left = cells.with_point_cell(clicks.select(click_id, x, y), x, y, radius)
    right = cells.with_neighbour_cells(presets.select(F.col(preset_id), F.col(x).alias("_px"), F.col(y).alias("_py")), "_px", "_py", radius)
    d = F.hypot(F.col("_px") - F.col(x), F.col("_py") - F.col(y))
    best = F.min(F.struct(F.col("d"), F.col(preset_id)))
    return (left.join(right, [cells.CELL_X, cells.CELL_Y]).withColumn("d", d).filter(F.col("d") < radius)
            .groupBy(click_id).agg(best.alias("_b")).select(click_id, F.col(f"_b.{preset_id}").alias(preset_id), F.col("_b.d").alias("distance")))


def in_bounds(places: DataFrame, query: str, lon="lon", lat="lat", box: dict = BAY) -> DataFrame:
    """Results inside the search box; a blank query has none."""
    return places.filter((F.trim(F.col(query).cast("string")) != "") & F.col(lon).between(box["west"], box["east"])
                         & F.col(lat).between(box["south"], box["north"]))


def first_per_label(results: DataFrame, query: str, label: str, rank: str) -> DataFrame:
    """The first result of each label within a query, by a partial aggregate."""
    rest = [c for c in results.columns if c not in (query, label, rank)]
    return (results.groupBy(query, label).agg(F.min(F.struct(rank, *rest)).alias("_f"))
            .select(query, label, *[F.col(f"_f.{c}").alias(c) for c in (rank, *rest)]))


def first_k(results: DataFrame, query: str, rank: str, k: int = 5) -> DataFrame:
    return nearest_k(results, [query], [rank], k, "_k").drop("_k")
