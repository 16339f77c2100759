"""Painted ground: ribbons, polygons and crossing decals from map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilescape.functions import classify, geo

from . import lines


def select_elements(elements: DataFrame, box=None, buildings: bool = False) -> DataFrame:
    """Elements the extract asks for; `box` = (south, west, north, east) keeps those with a vertex inside."""
    rule = classify.selected_as_building if buildings else classify.selected_for_paint
    out = elements.filter(rule("tags", "type"))
    if box:
        south, west, north, east = box
        out = out.filter(F.exists("geometry", lambda p: p["lon"].between(west, east) & p["lat"].between(south, north)))
    return out


def way_features(elements: DataFrame) -> DataFrame:
    """Painted ways with kind, `polygon` flag, width and path (at least two vertices)."""
    ways = elements.filter((F.col("type") == "way") & (F.size("geometry") >= 2)).withColumn("kind", classify.footway_kind("tags"))
    return (ways.filter(F.col("kind").isNotNull())
            .select("id", "kind", classify.painted_as_polygon("kind", "geometry").alias("polygon"),
                    classify.paint_width("kind").alias("width_m"), F.col("geometry").alias("path")))


def roads(elements: DataFrame) -> DataFrame:
    return (elements.filter((F.col("type") == "way") & classify.tag("tags", "highway").isin(*classify.ROAD_HIGHWAYS))
            .select(F.col("id").alias("road_id"), F.col("geometry").alias("path")))


def crossings(elements: DataFrame) -> DataFrame:
    """Marked crossing nodes with default size."""
    nodes = elements.filter((F.col("type") == "node") & classify.is_marked_crossing("tags"))
    return nodes.select("id", F.col("geometry")[0]["lon"].alias("lon"), F.col("geometry")[0]["lat"].alias("lat"),
                        F.lit(classify.CROSSWALK_LENGTH_M).alias("len_m"), F.lit(classify.CROSSWALK_WIDTH_M).alias("width_m"))


def crosswalk_decals(elements: DataFrame) -> DataFrame:
    """Crossings with the bearing of the nearest road."""
    nodes = crossings(elements)
    bearings = lines.nearest_road_bearing(nodes, roads(elements), "id", "road_id")
    return nodes.join(bearings.select("id", F.col("bearing").alias("bearing_deg")), "id")


def usable_ribbons(ribbons: DataFrame, width="width_dm", path="path") -> DataFrame:
    return ribbons.filter((F.size(path) >= 2) & (F.col(width) > 0) & ~F.isnan(F.col(width).cast("double")))


def usable_polygons(polygons: DataFrame, ring="ring") -> DataFrame:
    return polygons.filter(F.size(ring) >= 3)


def usable_decals(decals: DataFrame) -> DataFrame:
    return decals.filter(F.col("bearing_cdeg").isNotNull() & (F.col("len_dm") > 0) & (F.col("width_dm") > 0))


def owner_tile(features: DataFrame, zoom: int = 14, path="path") -> DataFrame:
    """Add the tile of the first vertex; every feature belongs to one tile."""
    first = F.get(path, F.lit(0))
    return features.withColumns({"tx": geo.tile_x(first["lon"], zoom), "ty": geo.tile_y(first["lat"], zoom)})
