"""Elevation tiles as Terrarium rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tilescape.functions.fixedpoint import terrarium_encode


def terrain_rows(grid: DataFrame, elev="elev", tile: Sequence[str] = ("z", "tx", "ty")) -> DataFrame:
    """One r, g, b row per pixel of a dense grid."""
    return (grid.withColumn("_c", terrarium_encode(elev))
            .select(*tile, F.col("cx").alias("px"), F.col("cy").alias("py"), "_c.r", "_c.g", "_c.b"))


def write_terrain(rows: DataFrame, path: str, tile: Sequence[str] = ("z", "tx", "ty")) -> None:
    """Parquet partitioned by tile. Rows are already evenly spread by pixel; AQE rebalances them by tile."""
    rows.hint("rebalance", *tile).write.mode("overwrite").partitionBy(*tile).parquet(path)
