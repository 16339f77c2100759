"""The shared spatial join: items spread over square cells, then an equi-join on the cell.

An item box is exploded to the cells it touches; a point has exactly one cell. The join
is then an ordinary sort-merge join on (tile..., cell_x, cell_y), so Spark shuffles on the
cell and AQE splits a hot cell; exploded boxes are never broadcast, as their planned size
is that of the boxes. No pair is produced outside a shared cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tilescape.functions._base import ColumnLike, col, num, whole
from tilescape.session import by_keys

CELL_X, CELL_Y = "_cell_x", "_cell_y"


def cell(value: ColumnLike, size) -> Column:
    return whole(col(value) / num(size))


def with_point_cell(df: DataFrame, x: ColumnLike, y: ColumnLike, size) -> DataFrame:
    return df.withColumns({CELL_X: cell(x, size), CELL_Y: cell(y, size)})


def with_box_cells(df: DataFrame, min_x: ColumnLike, min_y: ColumnLike, max_x: ColumnLike,
                   max_y: ColumnLike, size, pad=0.0) -> DataFrame:
    """One row per cell touched by the padded box."""
    low = lambda v: cell(col(v) - num(pad), size)
    high = lambda v: cell(col(v) + num(pad), size)
    return (df.withColumn(CELL_X, F.explode(F.sequence(low(min_x), high(max_x))))
              .withColumn(CELL_Y, F.explode(F.sequence(low(min_y), high(max_y)))))


def with_path_cells(df: DataFrame, start: tuple, end: tuple, size, slack) -> DataFrame:
    """One row per cell that the straight path from `start` to `end` comes near, up to `slack` along each axis.

    The path is followed column by column, so the cells of a long diagonal are as many as it
    is long, and not those of its bounding box.
    """
    (x0, y0), (x1, y1) = ([F.col(c).cast("double") for c in p] for p in (start, end))
    pad, dx = slack + 1e-6, x1 - x0
    low, high = (lambda v: cell(v - pad, size)), (lambda v: cell(v + pad, size))
    columns = df.withColumn(CELL_X, F.explode(F.sequence(low(F.least(x0, x1)), high(F.greatest(x0, x1)))))
    at = lambda edge: F.when(dx != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - x0) / F.nullif(dx, F.lit(0.0)))))
    west, east = at(F.col(CELL_X) * num(size) - pad), at((F.col(CELL_X) + 1) * num(size) + pad)
    here = columns.withColumns({"_y_in": y0 + (y1 - y0) * F.coalesce(west, F.lit(0.0)), "_y_out": y0 + (y1 - y0) * F.coalesce(east, F.lit(1.0))})
    span = F.sequence(low(F.least("_y_in", "_y_out")), high(F.greatest("_y_in", "_y_out")))
    return here.withColumn(CELL_Y, F.explode(span)).drop("_y_in", "_y_out")


def with_neighbour_cells(df: DataFrame, x: ColumnLike, y: ColumnLike, size, reach: int = 1) -> DataFrame:
    """One row per cell within `reach` cells of the point."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return (df.withColumn(CELL_X, F.explode(span)).withColumn(CELL_X, cell(x, size) + F.col(CELL_X))
              .withColumn(CELL_Y, F.explode(span)).withColumn(CELL_Y, cell(y, size) + F.col(CELL_Y)))


def tile_grid_cells(df: DataFrame, min_x: ColumnLike, min_y: ColumnLike, max_x: ColumnLike, max_y: ColumnLike,
                    tile_min: tuple, tile_max: tuple, n: int = 16) -> DataFrame:
    """Items to the cells of one tile's n x n grid, clamped to the border cells."""
    def span(low, high, axis):
        size = (num(tile_max[axis]) - num(tile_min[axis])) / n
        clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), whole((col(v) - num(tile_min[axis])) / size)))
        return F.explode(F.sequence(clip(low), clip(high)))
    return df.withColumn("grid_col", span(min_x, max_x, 0)).withColumn("grid_row", span(min_y, max_y, 1))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size, x="x", y="y",
                    box=("min_x", "min_y", "max_x", "max_y"), on: Sequence[str] = (), pad=0.0,
                    exact: Column | None = None) -> DataFrame:
    """Points joined to the boxes whose padded extent holds them (closed).

    A point has one cell and a box lists each cell once, so no pair repeats. `exact` is a
    costlier test on the pair, evaluated only for pairs that pass the box test.
    """
    left = with_point_cell(points, x, y, size).alias("p")
    right = by_keys(with_box_cells(boxes, *box, size, pad)).alias("b")
    keys = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in (*on, CELL_X, CELL_Y)]
    inside = (F.col(f"p.{x}").between(F.col(f"b.{box[0]}") - num(pad), F.col(f"b.{box[2]}") + num(pad))
              & F.col(f"p.{y}").between(F.col(f"b.{box[1]}") - num(pad), F.col(f"b.{box[3]}") + num(pad)))
    condition = inside if exact is None else F.when(inside, exact).otherwise(False)
    for k in keys:
        condition = condition & k
    joined = left.join(right, condition)
    extra = [F.col(f"b.{c}") for c in boxes.columns if c not in on and c not in points.columns]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)
