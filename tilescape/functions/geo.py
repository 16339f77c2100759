"""Projections, slippy tiles, tile units and local frames as Column expressions.

Everything here is a projection-stage expression: no UDF, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._base import ColumnLike, clamp, col, num, whole

# Fixed values of the coordinate frames.
EARTH_RADIUS_M = 6378137.0
HALF_WORLD_M = 20037508.342789244
M_PER_DEG_LAT = 111319.49079327357


# -- Web Mercator metres ------------------------------------------------------

def mercator_x(lon: ColumnLike) -> Column:
    return F.radians(col(lon)) * EARTH_RADIUS_M


def mercator_y(lat: ColumnLike) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(col(lat)) / 2)) * EARTH_RADIUS_M


def mercator_lon(x: ColumnLike) -> Column:
    return F.degrees(col(x) / EARTH_RADIUS_M)


def mercator_lat(y: ColumnLike) -> Column:
    return F.degrees(2 * F.atan(F.exp(col(y) / EARTH_RADIUS_M)) - math.pi / 2)


def mercator_scale(lat: ColumnLike) -> Column:
    """Mercator metres per ground metre at a latitude."""
    return F.lit(1.0) / F.cos(F.radians(col(lat)))


def _box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"),
                    max_x.alias("max_x"), max_y.alias("max_y"))


def mercator_box(min_lon, min_lat, max_lon, max_lat) -> Column:
    """Lon/lat box to a struct of four Mercator bounds."""
    return _box(mercator_x(min_lon), mercator_y(min_lat), mercator_x(max_lon), mercator_y(max_lat))


def ground_square(lon: ColumnLike, lat: ColumnLike, side_m) -> Column:
    """Mercator box of a square given in ground metres about a centre."""
    half = num(side_m) * mercator_scale(lat) / 2
    x, y = mercator_x(lon), mercator_y(lat)
    return _box(x - half, y - half, x + half, y + half)


# -- Slippy tiles -------------------------------------------------------------

def tile_x(lon: ColumnLike, zoom: int) -> Column:
    """Tile column of a longitude, clamped to the world."""
    n = 1 << zoom
    return clamp(whole((col(lon) + 180.0) / 360.0 * n), F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def tile_y(lat: ColumnLike, zoom: int) -> Column:
    """Tile row of a latitude (grows south), clamped to the world."""
    n = 1 << zoom
    share = (1.0 - F.asinh(F.tan(F.radians(col(lat)))) / math.pi) / 2.0
    return clamp(whole(share * n), F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def tile_frac_x(lon: ColumnLike, zoom: int) -> Column:
    """Fractional tile column, not clamped."""
    return (col(lon) + 180.0) / 360.0 * (1 << zoom)


def tile_frac_y(lat: ColumnLike, zoom: int) -> Column:
    """Fractional tile row, not clamped (logarithmic form)."""
    s = F.sin(F.radians(col(lat)))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * (1 << zoom)


def tile_lon(x, zoom: int) -> Column:
    """Longitude of a (fractional) tile column."""
    return num(x) / float(1 << zoom) * 360.0 - 180.0


def tile_lat(y, zoom: int) -> Column:
    """Latitude of a (fractional) tile row."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - num(y) * 2.0 / float(1 << zoom)))))


def tile_bounds(x: ColumnLike, y: ColumnLike, zoom: int) -> Column:
    """Struct west/south/east/north of a tile in degrees."""
    x, y = col(x), col(y)
    return F.struct(tile_lon(x, zoom).alias("west"), tile_lat(y + 1, zoom).alias("south"),
                    tile_lon(x + 1, zoom).alias("east"), tile_lat(y, zoom).alias("north"))


def tile_mercator_bounds(x: ColumnLike, y: ColumnLike, zoom: int) -> Column:
    side = 2 * HALF_WORLD_M / (1 << zoom)
    x0 = col(x) * side - HALF_WORLD_M
    y1 = HALF_WORLD_M - col(y) * side
    return _box(x0, y1 - side, x0 + side, y1)


def tiles_covering(boxes: DataFrame, zoom: int, min_lon="min_lon", min_lat="min_lat",
                   max_lon="max_lon", max_lat="max_lat", tx="tx", ty="ty") -> DataFrame:
    """One row per tile touched by each box: two `explode(sequence)` calls, no UDTF."""
    return (boxes
            .withColumn(tx, F.explode(F.sequence(tile_x(min_lon, zoom), tile_x(max_lon, zoom))))
            .withColumn(ty, F.explode(F.sequence(tile_y(max_lat, zoom), tile_y(min_lat, zoom)))))


def tile_parent(v: ColumnLike, levels: int) -> Column:
    return F.shiftright(col(v), levels)


def tile_children(df: DataFrame, levels: int, x="tx", y="ty", cx="child_x", cy="child_y") -> DataFrame:
    """All descendants `levels` zooms below: a 2^levels square window."""
    span = F.sequence(F.lit(0), F.lit((1 << levels) - 1))
    return (df.withColumn(cx, F.explode(span)).withColumn(cx, F.shiftleft(col(x), levels) + F.col(cx))
              .withColumn(cy, F.explode(span)).withColumn(cy, F.shiftleft(col(y), levels) + F.col(cy)))


# -- Local east / south frame about an origin ---------------------------------

def enu_x(lon: ColumnLike, origin_lon, origin_lat) -> Column:
    return (col(lon) - num(origin_lon)) * M_PER_DEG_LAT * F.cos(F.radians(num(origin_lat)))


def enu_z(lat: ColumnLike, origin_lat) -> Column:
    """South-positive metres."""
    return (num(origin_lat) - col(lat)) * M_PER_DEG_LAT


def enu_lon(x: ColumnLike, origin_lon, origin_lat) -> Column:
    """Rounded to 12 decimals, so that degrees with as many come back from `enu_x` as they went in."""
    return F.round(num(origin_lon) + col(x) / (M_PER_DEG_LAT * F.cos(F.radians(num(origin_lat)))), 12)


def enu_lat(z: ColumnLike, origin_lat) -> Column:
    return F.round(num(origin_lat) - col(z) / M_PER_DEG_LAT, 12)


def units_to_enu(u, v, tx: ColumnLike, ty: ColumnLike, zoom: int, extent, origin_lon, origin_lat) -> Column:
    """Tile units (u east, v south, 0..extent) to a struct x, z."""
    lon = tile_lon(col(tx) + num(u) / num(extent), zoom)
    lat = tile_lat(col(ty) + num(v) / num(extent), zoom)
    return F.struct(enu_x(lon, origin_lon, origin_lat).alias("x"), enu_z(lat, origin_lat).alias("z"))


def ring_units_to_enu(ring: ColumnLike, tx: ColumnLike, ty: ColumnLike, zoom: int, extent,
                      origin_lon, origin_lat) -> Column:
    """The same for an array of struct(u, v)."""
    return F.transform(col(ring), lambda p: units_to_enu(
        p["u"], p["v"], tx, ty, zoom, extent, origin_lon, origin_lat))


# -- Map windows and octree cells ---------------------------------------------

def map_fraction_x(lon: ColumnLike, west: float, east: float) -> Column:
    return (col(lon) - west) / (east - west)


def map_fraction_y(lat: ColumnLike, south: float, north: float) -> Column:
    return (north - col(lat)) / (north - south)


def octree_bounds(depth: ColumnLike, nx: ColumnLike, ny: ColumnLike, nz: ColumnLike, root) -> Column:
    """Struct of a cell's six bounds; `root` = (x0, y0, z0, x1, y1, z1)."""
    n = F.pow(F.lit(2.0), col(depth))
    fields = []
    for axis, cell in enumerate((nx, ny, nz)):
        side = F.lit(float(root[axis + 3] - root[axis])) / n
        low = F.lit(float(root[axis])) + col(cell) * side
        fields += [low.alias(f"min_{'xyz'[axis]}"), (low + side).alias(f"max_{'xyz'[axis]}")]
    return F.struct(*fields)


def boxes_touch_xy(a: Column, b: Column, pad: float = 0.0) -> Column:
    """Closed overlap of two structs with min_x..max_y."""
    return ((a["max_x"] >= b["min_x"] - pad) & (a["min_x"] <= b["max_x"] + pad)
            & (a["max_y"] >= b["min_y"] - pad) & (a["min_y"] <= b["max_y"] + pad))
