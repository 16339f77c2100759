"""Whole bakes: from classified points to the documents of a layer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tilescape.functions import fixedpoint, geo
from tilescape.sinks import tree_documents

from . import raster, trees

#: Points a tile needs to be baked.
TREE_MINIMUM = 200_000


def baked_trees(points: DataFrame, nx: int, ny: int, size, place: Callable[[], tuple[Column, Column]], mask: DataFrame | None = None,
                minimum: int = TREE_MINIMUM, rules: trees.TreeRules = trees.RULES, metre: float = 1.0, zoom: int = 14,
                tile: Sequence[str] = ("tx", "ty"), x="x", y="y", z="z", cls="cls") -> DataFrame:
    """(tile, lon_e7, lat_e7, height_dm, crown_dm) of the trees in the tiles that have enough points.

    Noise is dropped, thin tiles are left out, ground is filled to the nearest known cell,
    and stems come from `trees.extract_trees` outside the `mask` cells. `place` gives the
    longitude and latitude of a cell's centre; a stem belongs to the tile that holds it
    (half-open), so seams are counted once. `metre` is the length of a metre in the height unit.
    """
    tile = list(tile)
    dense = raster.density_gate(raster.drop_noise(points, cls), minimum, tile)
    cells = raster.fill_gaps(raster.elevation_cells(dense, nx, ny, size, tile, x, y, z, cls), nx, tile=tile)
    canopy = raster.canopy_cells(cells).filter("dsm is not null").select(*tile, "cx", "cy", "chm")
    found = trees.extract_trees(canopy, nx, ny, mask, rules, tile)
    lon, lat = place()
    placed = found.withColumns({"lon": lon, "lat": lat})
    own = placed.filter((geo.tile_x("lon", zoom) == F.col(tile[0])) & (geo.tile_y("lat", zoom) == F.col(tile[1])))
    return own.select(*tile, fixedpoint.to_e7("lon").alias("lon_e7"), fixedpoint.to_e7("lat").alias("lat_e7"),
                      fixedpoint.to_dm(F.col("chm") / metre).alias("height_dm"), fixedpoint.to_dm("crown_r").alias("crown_dm"))


def bake_tree_documents(points: DataFrame, tiles: DataFrame | None, nx: int, ny: int, size, place: Callable[[], tuple[Column, Column]], **settings) -> DataFrame:
    """Tree documents of `baked_trees`; every tile of `tiles` gets one, empty ones too."""
    rows = baked_trees(points, nx, ny, size, place, **settings)
    return tree_documents(rows, tiles, settings.get("tile", ("tx", "ty")))
