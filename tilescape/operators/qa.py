"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tilescape.functions import fixedpoint
from tilescape.functions._base import half_up


def implausible_counts(records: DataFrame, limit: int, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Records per tile, flagged above a limit."""
    return records.groupBy(*tile).agg(F.count("*").alias("n")).withColumn("implausible", F.col("n") > limit)


def class_histogram(points: DataFrame, tile: str = "tx", cls: str = "cls") -> DataFrame:
    """Points per tile and class with totals, and the share that survives the noise filter."""
    counts = points.groupBy(tile, cls).agg(F.count("*").alias("n"))
    label = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c).cast("string"))
    kept = F.sum(F.when(~F.col(cls).isin(7, 18), F.col("n")).otherwise(0))
    return (counts.rollup(tile, cls)
            .agg(label(tile).alias("tile"), label(cls).alias("_cls"), F.sum("n").alias("_n"), F.round(kept / F.sum("n"), 6).alias("kept"))
            .select("tile", F.col("_cls").alias("cls"), F.col("_n").alias("n"), "kept"))


def terrarium_round_trip(pixels: DataFrame, elev: str, tile: Sequence[str]) -> DataFrame:
    """Range after encode and decode, and whether the error stays within one step."""
    back = pixels.withColumn("_c", fixedpoint.terrarium_encode(elev)).withColumn(
        "_back", fixedpoint.terrarium_decode("_c.r", "_c.g", "_c.b"))
    return back.groupBy(*tile).agg(F.round(F.min("_back"), 6).alias("low"), F.round(F.max("_back"), 6).alias("high"),
                                   (F.max(F.abs(F.col("_back") - F.col(elev))) <= 1 / 256).alias("within"))


def tile_totals(documents: DataFrame, tile: Sequence[str] = ("tx",), json="json", count="n") -> DataFrame:
    """Documents, features and bytes per tile and layer."""
    return documents.groupBy("layer", *tile).agg(F.count("*").alias("documents"), F.sum(count).alias("features"),
                                                 F.sum(F.octet_length(json)).alias("bytes"))


def triangle_audit(triangles: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of roof triangles facing up and of normals agreeing with the winding.

    `triangles` has structs a, b, c, normal with x, y, z. Degenerate ones are skipped.
    """
    d = lambda p, q, k: F.col(f"{q}.{k}") - F.col(f"{p}.{k}")
    ux, uy, uz = (d("a", "b", k) for k in "xyz")
    vx, vy, vz = (d("a", "c", k) for k in "xyz")
    faces = triangles.select(*group, "normal", (uy * vz - uz * vy).alias("gx"), (uz * vx - ux * vz).alias("gy"), (ux * vy - uy * vx).alias("gz"))
    size2 = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")
    faces = faces.filter(size2 >= 1e-10)
    up = F.col("gy") / F.sqrt(size2)
    dot = F.col("gx") * F.col("normal.x") + F.col("gy") * F.col("normal.y") + F.col("gz") * F.col("normal.z")
    roof = (F.abs(up) > 0.7) | (F.abs(F.col("normal.y")) > 0.7)
    share = lambda hit, of: F.coalesce(F.sum(F.when(of & hit, 1).otherwise(0)) / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0)), F.lit(0.0))
    every = F.lit(True)
    return faces.groupBy(*group).agg(F.count("*").alias("triangles"), F.sum(F.when(roof, 1).otherwise(0)).alias("roof_triangles"),
                                     share(up > 0, roof).alias("roof_up"), share(dot > 0, every).alias("normals_agree"))


def duplicate_share(quads: DataFrame, keys: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Share of quads whose 0.25 m rounded key repeats an earlier one."""
    named = [half_up(k * 4).alias(f"_k{i}") for i, k in enumerate(keys)]
    counts = quads.groupBy(*group, *named).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.sum("n").alias("quads"), F.sum(F.col("n") - 1).alias("duplicates"),
                                      (F.sum(F.col("n") - 1) / F.sum("n")).alias("share"))
