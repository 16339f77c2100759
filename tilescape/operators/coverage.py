"""Tile coverage: completeness, lookups, readiness, manifest differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

LAYERS = {"trees": 14, "terrain": 16, "paint": 14, "roofs": 14, "wash": 14}
OPTIONAL_LAYERS = ("roofs", "wash")


def missing(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys that are not present."""
    return required.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def require_complete(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> None:
    """Raise when any required key is absent, with a few examples."""
    gap = missing(required, present, keys)
    some = gap.take(3)
    if some:
        raise ValueError(f"incomplete input: {gap.count()} keys missing, e.g. {[tuple(r) for r in some]}")


def covered(tiles: DataFrame, coverage: DataFrame, layer: str) -> DataFrame:
    """Tiles listed for a layer."""
    return tiles.join(coverage.filter(F.col("layer") == layer).select("tx", "ty"), ["tx", "ty"], "left_semi")


def covered_parents(tiles: DataFrame, coverage: DataFrame, layer: str, levels: int) -> DataFrame:
    """Add `covered`: is any descendant `levels` below listed? The children are reduced to parents first."""
    parents = (coverage.filter(F.col("layer") == layer)
               .select(F.shiftright("tx", levels).alias("tx"), F.shiftright("ty", levels).alias("ty")).distinct()
               .withColumn("_hit", F.lit(True)))
    return tiles.join(parents, ["tx", "ty"], "left").withColumn("covered", F.coalesce("_hit", F.lit(False))).drop("_hit")


def ready_parents(tiles: DataFrame, listed: DataFrame, loaded: DataFrame, levels: int, px="px", py="py") -> DataFrame:
    """Add `ready`: no listed descendant is still unloaded (no coverage counts as ready)."""
    waiting = (listed.select("tx", "ty").join(loaded.select("tx", "ty"), ["tx", "ty"], "left_anti")
               .select(F.shiftright("tx", levels).alias(px), F.shiftright("ty", levels).alias(py)).distinct()
               .withColumn("_wait", F.lit(True)))
    return tiles.join(waiting, [px, py], "left").withColumn("ready", F.col("_wait").isNull()).drop("_wait")


def prefer_baked(baked: DataFrame, made: DataFrame, tile: Sequence[str]) -> DataFrame:
    """Baked rows, plus generated rows of tiles that have none."""
    return baked.unionByName(made.join(baked.select(*tile).distinct(), list(tile), "left_anti"))


def union_all(parts: Sequence[DataFrame], unique_by: str | None = None) -> DataFrame:
    """Union of extracts. Overlaps stay doubled unless a key is given."""
    out = reduce(DataFrame.unionByName, parts)
    return out.dropDuplicates([unique_by]) if unique_by else out


def distinct_tiles(rows: DataFrame, tile: Sequence[str]) -> DataFrame:
    return rows.select(*tile).distinct()


def manifest_difference(listed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Entries of either side that the other lacks."""
    key = ["layer", "tx", "ty"]
    a, b = listed.select(*key), on_disk.select(*key)
    return (a.exceptAll(b).withColumn("finding", F.lit("not on disk"))
            .unionByName(b.exceptAll(a).withColumn("finding", F.lit("not listed"))))
