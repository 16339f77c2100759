"""Tree crowns from canopy cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tilescape.session import cut

from . import graph, raster


@dataclass(frozen=True)
class TreeRules:
    """Thresholds in the unit of the height column (defaults: metres) and in cells."""

    min_height: float = 3.0
    max_height: float = 35.0
    separation: int = 3
    noise_area: int = 3
    small_area: int = 150
    medium_area: int = 2000
    medium_span: float = 4.0
    large_span: float = 8.0
    floor_radius: int = 2
    floor_share: float = 0.5
    plateau_span: float = 1.5
    crown_min: float = 1.5
    crown_max: int = 10
    crown_share: float = 0.5


RULES = TreeRules()


def local_stems(cells: DataFrame, nx: int, ny: int, rules: TreeRules = RULES, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Cells equal to the maximum of their window and within the height limits (ties all kept)."""
    peaks = raster.focal(cells, "chm", nx, ny, {"local_max": ("max", rules.separation)}, tile)
    return peaks.filter((F.col("chm") == F.col("local_max"))
                        & F.col("chm").between(rules.min_height, rules.max_height))


def rejected(stats: DataFrame, rules: TreeRules = RULES) -> DataFrame:
    """Components that are noise, or too flat for their size."""
    area, span = F.col("area"), F.col("span")
    return stats.filter((area < rules.noise_area)
                        | ((area > rules.small_area) & (area <= rules.medium_area) & (span < rules.medium_span))
                        | ((area > rules.medium_area) & (span < rules.large_span)))


def vegetation_cells(cells: DataFrame, rules: TreeRules = RULES, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Canopy cells without those of rejected components (an absent cell counts as 0)."""
    labelled = graph.label_components(cells.filter(F.col("chm") >= rules.min_height), ["cy", "cx"], tile)
    bad = rejected(graph.component_stats(labelled, "chm", tile), rules).select(*tile, "component")
    dropped = labelled.join(bad, [*tile, "component"], "left_semi").select(*tile, "cx", "cy")
    return cells.join(dropped, [*tile, "cx", "cy"], "left_anti")


def continuous_stems(cells: DataFrame, nx: int, ny: int, rules: TreeRules = RULES, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Stems whose close surroundings are canopy (no deep gap) and not a plateau."""
    around = raster.focal(cells, "chm", nx, ny, {
        "local_max": ("max", rules.separation), "near_max": ("max", rules.floor_radius),
        "near_min": ("min", rules.floor_radius)}, tile)
    return around.filter((F.col("chm") == F.col("local_max")) & (F.col("chm") > 0)
                         & F.col("chm").between(rules.min_height, rules.max_height)
                         & (F.col("near_min") >= F.col("chm") * rules.floor_share)
                         & (F.col("near_max") - F.col("near_min") >= rules.plateau_span))


def ring_offsets(radius: int) -> list[tuple[int, int, int]]:
    """(ring, dx, dy) of every cell at a rounded distance of 1..radius; fixed by the radius."""
    out = []
    for dy in range(-radius - 1, radius + 2):
        for dx in range(-radius - 1, radius + 2):
            ring = math.floor(math.hypot(dx, dy) + 0.5)
            if 1 <= ring <= radius:
                out.append((ring, dx, dy))
    return out


def _row_sums(cells: DataFrame, width: int, tile: Sequence[str]) -> DataFrame:
    """Raster rows in strips of `width` cells: `_sums`, the running sums from the strip's start (0 first)."""
    at = F.col("cx") - F.col("_strip") * width
    sums = [F.sum(F.when(at < i, F.col("chm")).otherwise(0)).alias(f"_s{i}") for i in range(width + 1)]
    strips = cells.filter("chm <> 0").withColumn("_strip", F.expr(f"cx div {width}")).groupBy(*tile, "cy", "_strip").agg(*sums)
    return strips.select(*tile, "cy", "_strip", F.array(*[f"_s{i}" for i in range(width + 1)]).alias("_sums"))


def with_crowns(stems: DataFrame, cells: DataFrame, nx: int, ny: int, rules: TreeRules = RULES,
                tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Add `crown_r`: the first ring whose mean height falls below half of the stem's, in cells.

    Ring cells inside the tile count, absent ones as 0. A ring is the difference of two discs
    and a disc one span per raster row, read from running sums, so a stem meets the rows
    around it (two strips each) instead of every cell of its rings. Stems are one per cell.
    """
    tile, reach = list(tile), rules.crown_max
    width = 2 * reach + 1
    rings = ring_offsets(reach)
    # Half widths of discs 0..reach in the row `dy` away; -1 where the disc does not meet the row.
    half = [[max([dx for r, dx, y in rings if r <= disc and y == dy] + ([0] if dy == 0 else []), default=-1) for disc in range(reach + 1)] for dy in range(reach + 1)]
    own = stems.select(*tile, F.col("cx").cast("bigint").alias("sx"), F.col("cy").cast("bigint").alias("sy"))
    looks = (own.select(*tile, "sx", "sy", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("sy") - reach), F.least(F.lit(ny - 1).cast("bigint"), F.col("sy") + reach))).alias("cy"))
             .withColumn("_strip", F.explode(F.sequence(F.expr(f"greatest(0L, sx - {reach}) div {width}"), F.expr(f"least({nx - 1}L, sx + {reach}) div {width}")))))
    spans = F.get(F.array(*[F.array(*[F.lit(w) for w in row]) for row in half]), F.abs(F.col("cy") - F.col("sy")).cast("int"))
    met = (looks.join(_row_sums(cells, width, tile), [*tile, "cy", "_strip"])
           .select(*tile, "sx", "sy", "_sums", spans.alias("_half"), (F.col("sx") - F.col("_strip") * width).cast("int").alias("_o")))
    place = lambda v: F.get("_sums", F.greatest(F.lit(0), F.least(F.lit(width), v)))
    w = lambda disc: F.get("_half", F.lit(disc))
    discs = [F.sum(F.when(w(d) >= 0, place(F.col("_o") + w(d) + 1) - place(F.col("_o") - w(d))).otherwise(0)).alias(f"_d{d}") for d in range(reach + 1)]
    sums = met.groupBy(*tile, F.col("sx").alias("cx"), F.col("sy").alias("cy")).agg(*discs)
    # Cells of each ring inside the tile: a constant, but near its edges.
    free = F.col("cx").between(reach, nx - 1 - reach) & F.col("cy").between(reach, ny - 1 - reach)
    inside = lambda o: (F.col("cx") + o["dx"]).between(0, nx - 1) & (F.col("cy") + o["dy"]).between(0, ny - 1)
    counts = []
    for ring in range(1, reach + 1):
        offsets = [(dx, dy) for r, dx, dy in rings if r == ring]
        listed = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
        counts.append(F.nullif(F.when(free, F.lit(len(offsets))).otherwise(F.size(F.filter(listed, inside))), F.lit(0)).alias(f"_n{ring}"))
    total = lambda d: F.coalesce(F.col(f"_d{d}"), F.lit(0))
    edges = [F.when((total(r) - total(r - 1)) / F.col(f"_n{r}") < F.col("chm") * rules.crown_share, F.lit(r)) for r in range(1, reach + 1)]
    crown = F.greatest(F.lit(rules.crown_min), F.coalesce(*edges, F.lit(reach)).cast("double"))
    return (stems.join(sums, [*tile, "cx", "cy"], "left").select("*", *counts)
            .select(*tile, "cx", "cy", *[c for c in stems.columns if c not in (*tile, "cx", "cy")], crown.alias("crown_r")))


def building_mask(cells_inside: DataFrame, steps: int = 2, nx: int | None = None, ny: int | None = None,
                  tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Mask cells grown by `steps` 4-neighbour dilations (a diamond), clipped to the tile."""
    diamond = [(dx, dy) for dx in range(-steps, steps + 1) for dy in range(-steps, steps + 1) if abs(dx) + abs(dy) <= steps]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in diamond])
    grown = (cells_inside.select(*tile, "cx", "cy", F.explode(offsets).alias("_o"))
             .select(*tile, (F.col("cx") + F.col("_o.dx")).alias("cx"), (F.col("cy") + F.col("_o.dy")).alias("cy")))
    if nx is not None:
        grown = grown.filter(F.col("cx").between(0, nx - 1) & F.col("cy").between(0, ny - 1))
    return grown.distinct()


def extract_trees(canopy: DataFrame, nx: int, ny: int, mask: DataFrame | None = None, rules: TreeRules = RULES,
                  tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Canopy cells to stems with height and crown radius."""
    canopy = cut(canopy)
    veg = cut(vegetation_cells(canopy, rules, tile))
    stems = continuous_stems(veg, nx, ny, rules, tile).select(*tile, "cx", "cy", "chm")
    if mask is not None:
        stems = stems.join(mask, [*tile, "cx", "cy"], "left_anti")
    return with_crowns(stems, veg, nx, ny, rules, tile)
