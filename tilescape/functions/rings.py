"""Polygon rings as arrays of struct(x, y): areas, bounds, winding, containment.

A feature's ring travels inside its row, so these are narrow expressions; nothing
is exploded or regrouped to measure a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._base import ColumnLike, col, explode_items, num


def ring_of(*xy) -> Column:
    """Build a ring literal from (x, y) pairs of columns."""
    return F.array(*[F.struct(num(x).cast("double").alias("x"), num(y).cast("double").alias("y")) for x, y in xy])


def _next(ring: Column) -> Column:
    """Ring rotated by one: the successor of every vertex, last wraps to first."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))


def ring_edges(ring: ColumnLike) -> Column:
    """Array of struct(a, b), one per edge including the closing one."""
    ring = col(ring)
    return F.zip_with(ring, _next(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: ColumnLike) -> Column:
    """Trapezoid area: negative of the textbook shoelace sign in (x, y)."""
    ring = col(ring)
    return _sum(F.zip_with(ring, _next(ring), lambda a, b: (a["x"] + b["x"]) * (a["y"] - b["y"]))) * 0.5


def ring_area(ring: ColumnLike) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: ColumnLike) -> Column:
    """Vertex mean (not the area centroid)."""
    ring = col(ring)
    n = F.size(ring)
    return F.struct((_sum(F.transform(ring, lambda p: p["x"])) / n).alias("x"),
                    (_sum(F.transform(ring, lambda p: p["y"])) / n).alias("y"))


def ring_bounds(ring: ColumnLike) -> Column:
    ring = col(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
                    F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def short_side(bounds: Column) -> Column:
    return F.least(bounds["max_x"] - bounds["min_x"], bounds["max_y"] - bounds["min_y"])


def wind_outer(ring: ColumnLike) -> Column:
    """Outer rings have non-negative signed area."""
    ring = col(ring)
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def wind_hole(ring: ColumnLike) -> Column:
    """Holes have non-positive signed area."""
    ring = col(ring)
    return F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)


def assemble_polygons(rings: ColumnLike) -> Column:
    """Rings of one feature to an array of struct(outer, holes).

    A ring starts a polygon when its area is negative or when it is the first
    one; every other ring is a hole of the polygon before it.
    """
    rings = col(rings)
    starts = F.filter(F.sequence(F.lit(0), F.size(rings) - 1),
                      lambda i: (i == 0) | (signed_area(F.get(rings, i)) < 0))
    bounds = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(rings))),
                        lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    polygons = F.transform(bounds, lambda b: F.struct(
        wind_outer(F.get(rings, b["s"])).alias("outer"),
        F.transform(F.slice(rings, b["s"] + 2, b["e"] - b["s"] - 1), wind_hole).alias("holes")))
    return F.when(F.size(rings) > 0, polygons).otherwise(F.slice(polygons, F.lit(1), F.lit(0)))


def anchor_in_tile(rings: ColumnLike, extent) -> Column:
    """Does the first vertex of the first ring lie in [0, extent)?"""
    first = F.get(F.get(col(rings), F.lit(0)), F.lit(0))
    return F.coalesce((first["x"] >= 0) & (first["x"] < num(extent))
                      & (first["y"] >= 0) & (first["y"] < num(extent)), F.lit(False))


def flat_edges(ring: ColumnLike) -> Column:
    """Edges as struct(x0, y0, x1, y1). Compute this once per ring, before joining points to it."""
    ring = col(ring)
    return F.zip_with(ring, _next(ring), lambda a, b: F.struct(
        a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def inside_edges(x: ColumnLike, y: ColumnLike, edges: ColumnLike) -> Column:
    """Even-odd containment from `flat_edges`."""
    x, y = col(x).cast("double"), col(y).cast("double")
    crosses = lambda e: (((e["y0"] > y) != (e["y1"] > y))
                         & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    return F.aggregate(col(edges), F.lit(False), lambda odd, e: odd != crosses(e))


def near_edges(x: ColumnLike, y: ColumnLike, edges: ColumnLike, pad: float) -> Column:
    """Is the point within `pad` of any edge? Compared without divisions, so exact on integers."""
    x, y = col(x).cast("double"), col(y).cast("double")

    def close(e: Column) -> Column:
        ex, ey, px, py = e["x1"] - e["x0"], e["y1"] - e["y0"], x - e["x0"], y - e["y0"]
        qx, qy = x - e["x1"], y - e["y1"]
        cross = px * ey - py * ex
        return (F.when(px * ex + py * ey <= 0, px * px + py * py <= pad * pad)
                .when(qx * ex + qy * ey >= 0, qx * qx + qy * qy <= pad * pad)
                .otherwise(cross * cross <= (ex * ex + ey * ey) * (pad * pad)))

    return F.exists(col(edges), close)


def point_in_ring(x: ColumnLike, y: ColumnLike, ring: ColumnLike) -> Column:
    """Even-odd containment."""
    return inside_edges(x, y, flat_edges(ring))


def point_near_ring(x: ColumnLike, y: ColumnLike, ring: ColumnLike, pad: float) -> Column:
    """Is the point within `pad` of the ring?"""
    return near_edges(x, y, flat_edges(ring), pad)


def point_in_polygon(x: ColumnLike, y: ColumnLike, outer: ColumnLike, holes: ColumnLike) -> Column:
    """Inside the outer ring and in none of the holes."""
    return point_in_ring(x, y, outer) & ~F.exists(col(holes), lambda h: point_in_ring(x, y, h))


def explode_polygons(features: DataFrame, rings="rings") -> DataFrame:
    """One row per polygon of a multi-polygon feature."""
    return (explode_items(features, ["*"], assemble_polygons(rings), "polygon_no", "_p")
            .select(*features.columns, "polygon_no", F.col("_p.outer").alias("outer"), F.col("_p.holes").alias("holes")))
