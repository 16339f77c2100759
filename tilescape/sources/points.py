"""Classified points from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilescape.operators.raster import drop_noise


def clip_points(points: DataFrame, box, x="x", y="y", cls="cls") -> DataFrame:
    """Half-open box clip and noise filter; both reach the Parquet scan as pushed filters."""
    x0, y0, x1, y1 = box
    return drop_noise(points.filter((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1)), cls)


def read_points(spark: SparkSession, path: str, box=None, intensity: bool = False) -> DataFrame:
    """Points of a Parquet table; `intensity` is read only when asked for."""
    columns = ["x", "y", "z", "cls"] + (["intensity"] if intensity else [])
    table = spark.read.parquet(path)
    keys = [c for c in ("node_key", "z_tile", "tx", "ty") if c in table.columns]
    points = table.select(*keys, *columns)
    return clip_points(points, box) if box else drop_noise(points)


def nodes_for_boxes(nodes: DataFrame, boxes: DataFrame, root, pad: float = 1.0, cell: float | None = None) -> DataFrame:
    """Octree nodes (`node_key` = depth-x-y-z) whose cell touches any box; unreadable names are kept.

    Node and box extents meet in cells of a quarter of the root, so the pruning is an equi-join.
    """
    from tilescape.functions.geo import octree_bounds
    from tilescape.operators import cells

    part = lambda i: F.get(F.split("node_key", "-"), i).try_cast("bigint")
    named = nodes.withColumns({"_d": part(0), "_x": part(1), "_y": part(2), "_z": part(3)})
    readable = F.col("_d").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_z").isNotNull()
    b = F.col("_b")
    known = named.filter(readable).withColumn("_b", octree_bounds("_d", "_x", "_y", "_z", root)).select(
        "node_key", *[b[n].alias(f"_n_{n}") for n in ("min_x", "min_y", "max_x", "max_y")])
    size = cell or (root[3] - root[0]) / 4
    left = cells.with_box_cells(known, "_n_min_x", "_n_min_y", "_n_max_x", "_n_max_y", size, pad)
    right = cells.with_box_cells(boxes.select("min_x", "min_y", "max_x", "max_y"), "min_x", "min_y", "max_x", "max_y", size)
    c = F.col
    touches = ((c("_n_max_x") >= c("min_x") - pad) & (c("_n_min_x") <= c("max_x") + pad)
               & (c("_n_max_y") >= c("min_y") - pad) & (c("_n_min_y") <= c("max_y") + pad))
    # A node asks for one box only, so crowded cells leave no pairs.
    here = touches & (c(f"l.{cells.CELL_X}") == c(f"r.{cells.CELL_X}")) & (c(f"l.{cells.CELL_Y}") == c(f"r.{cells.CELL_Y}"))
    hit = left.alias("l").join(right.alias("r"), here, "left_semi").select("node_key").distinct()
    keep = hit.unionByName(named.filter(~readable).select("node_key"))
    return nodes.join(keep, "node_key", "left_semi")
