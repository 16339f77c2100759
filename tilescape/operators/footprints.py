"""Building footprints: points inside, roof shapes, record matching, base and top heights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilescape.functions import rings
from tilescape.functions._base import ColumnLike, col, num, whole
from tilescape.functions.classify import eave_trusted, sane_height
from tilescape.session import by_keys, cut

from . import cells, graph
from .percentiles import percentiles, with_percentiles

BASE_SINK_M, WATER_BUILDING_M, WATER_GREEN_M = 3.0, 0.4, 0.6
FLAT, GABLE, HIP = 0, 1, 2
#: Points that one task takes for one footprint.
WHOLE_POINTS = 1_000_000


@dataclass(frozen=True)
class RoofRules:
    """Thresholds in the unit of the coordinates (defaults: metres)."""

    min_area: float = 25.0
    pad: float = 0.5
    min_points: int = 20
    above_ground: float = 2.0
    min_structure: int = 30
    min_eave: float = 2.0
    max_rise: float = 12.0
    rise_share: float = 0.5
    flat_rise: float = 1.0
    flat_ratio: float = 0.06
    gable_elongation: float = 2.2
    gable_width: float = 0.4


RULES = RoofRules()


def candidates(footprints: DataFrame, ring="ring", rules: RoofRules = RULES) -> DataFrame:
    """Rings of at least three vertices and the minimum area."""
    return footprints.filter((F.size(ring) >= 3) & (rings.ring_area(ring) >= rules.min_area))


def points_in_rings(points: DataFrame, footprints: DataFrame, cell: float, pad: float = 0.0, on: Sequence[str] = ("tx",),
                    x="x", y="y", ring="ring") -> DataFrame:
    """Points joined to the padded rings that hold them: cell equi-join, box test, then the exact test."""
    return _points_in(points, footprints, cell, pad, on, x, y, ring, None)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, on: Sequence[str] = ("tx",), x="x", y="y",
                       outer="outer", holes="holes") -> DataFrame:
    """The same for polygons with holes."""
    return _points_in(points, polygons, cell, 0.0, on, x, y, outer, holes)


def _points_in(points, shapes, cell, pad, on, x, y, ring, holes) -> DataFrame:
    """Edges are laid out once per shape; each pair then folds over them."""
    b = F.col("_b")
    boxed = shapes.withColumns({"_b": rings.ring_bounds(ring), "_edges": rings.flat_edges(ring)}).withColumns(
        {f"_{n}": b[n] for n in ("min_x", "min_y", "max_x", "max_y")}).drop("_b")
    inside = rings.inside_edges(x, y, "_edges")
    if pad:
        inside = inside | rings.near_edges(x, y, "_edges", pad)
    if holes:
        boxed = boxed.withColumn("_hole_edges", F.transform(holes, rings.flat_edges))
        inside = inside & ~F.exists("_hole_edges", lambda h: rings.inside_edges(x, y, h))
    near = cells.points_in_boxes(points, boxed, cell, x, y, ("_min_x", "_min_y", "_max_x", "_max_y"), on, pad, inside)
    return near.drop("_edges", "_hole_edges", "_min_x", "_min_y", "_max_x", "_max_y")


# -- Roof shapes --------------------------------------------------------------

def height_histogram(hits: DataFrame, keys: Sequence[str], x="x", y="y", z="z", ox="ox", oy="oy") -> DataFrame:
    """Per footprint and height: count and position moments about the footprint's own origin.

    However many points a footprint has, it leaves at most one row per distinct height; the
    partial aggregate does that before the shuffle. Later steps never see points again.
    """
    dx, dy = (F.col(x) - F.col(ox)).cast("double"), (F.col(y) - F.col(oy)).cast("double")
    return (hits.groupBy(*keys, F.col(z).alias("h"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(dx).alias("sx"), F.sum(dy).alias("sy"),
                 F.sum(dx * dx).alias("sxx"), F.sum(dy * dy).alias("syy"), F.sum(dx * dy).alias("sxy")))


def _known(hist: DataFrame) -> DataFrame:
    """Heights that are null or NaN are no part of a roof."""
    return hist.filter(F.col("h").isNotNull() & ~F.isnan(F.col("h").cast("double")))


def roof_profiles(hist: DataFrame, keys: Sequence[str], rules: RoofRules = RULES) -> DataFrame:
    """Ground, eave, ridge height and ridge-point moments per footprint.

    Ground is the 5th percentile; structure lies well above it; eave is its 15th percentile;
    the ridge is the median above its 95th (90th when fewer than five points remain).
    """
    keys, hist = list(keys), cut(_known(hist))
    ground = with_percentiles(hist, keys, {"ground": 0.05}).filter(F.col("n_total") >= rules.min_points)
    body = cut(ground.drop("n_total").filter(F.col("h") > F.col("ground") + rules.above_ground))
    eaves = percentiles(body, keys, {"eave": 0.15, "_p95": 0.95, "_p90": 0.90}).filter(F.col("n_total") >= rules.min_structure)
    body = body.join(eaves.withColumnRenamed("n_total", "structure"), keys)
    # Both cutoffs are counted before one is chosen; the lower one keeps every height the upper one keeps.
    body = cut(body.filter(F.col("h") >= F.col("_p90")))
    above = body.groupBy(*keys).agg((F.sum(F.when(F.col("h") >= F.col("_p95"), F.col("n")).otherwise(0)) >= 5).alias("_enough"))
    top = body.join(above, keys).filter(~F.col("_enough") | (F.col("h") >= F.col("_p95")))
    moments = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    sums = top.groupBy(*keys, "ground", "eave", "structure").agg(*moments)
    return (sums.join(percentiles(top, keys, {"ridge": 0.5}).select(*keys, "ridge"), keys)
            .select(*keys, "ground", "eave", "ridge", "structure", "n", "sx", "sy", "sxx", "syy", "sxy").withColumnsRenamed({"n": "top"}))


def crowded(points: DataFrame, footprints: DataFrame, keys: Sequence[str], cell: float, pad: float = 0.0, on: Sequence[str] = ("tx",),
            x="x", y="y", ring="ring", limit: int | None = None) -> DataFrame:
    """Keys of footprints whose cells hold more than `limit` (WHOLE_POINTS) points: only these may meet so many."""
    counts = cells.with_point_cell(points.select(*on, x, y), x, y, cell).groupBy(*on, cells.CELL_X, cells.CELL_Y).agg(F.count(F.lit(1)).alias("_n"))
    boxes = footprints.select(*keys, rings.ring_bounds(ring).alias("_b")).select(*keys, "_b.*")
    touched = cells.with_box_cells(boxes, "min_x", "min_y", "max_x", "max_y", cell, pad)
    return (touched.join(by_keys(counts), [*on, cells.CELL_X, cells.CELL_Y]).groupBy(*keys).agg(F.sum("_n").alias("_n"))
            .filter(F.col("_n") > (limit or WHOLE_POINTS)).select(*keys))


def _ranked(hist: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], total: str) -> DataFrame:
    """`hist` (one row per key and height) with percentiles and the total of its key, all by windows along the key's heights."""
    w = Window.partitionBy(*keys).orderBy("h")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = hist.withColumns({"_cum": F.sum("n").over(upto), total: F.sum("n").over(whole)})
    at = lambda rank: F.max(F.when((rank >= F.col("_cum") - F.col("n")) & (rank < F.col("_cum")), F.col("h"))).over(whole)
    place = {name: (F.col(total) - 1) * float(share) for name, share in wanted.items()}
    ends = cum.withColumns({f"_{side}_{name}": at(end(p)) for name, p in place.items() for side, end in (("low", F.floor), ("high", F.ceil))})
    mixed = {name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (p - F.floor(p)) for name, p in place.items()}
    return ends.withColumns(mixed).drop("_cum", *[f"_{side}_{name}" for side in ("low", "high") for name in wanted])


def roof_profiles_whole(hits: DataFrame, keys: Sequence[str], rules: RoofRules = RULES, parts: int | None = None, x="x", y="y", z="z", ox="ox", oy="oy") -> DataFrame:
    """`roof_profiles` of the `height_histogram` of `hits`, for footprints that are not `crowded`.

    Hits are shuffled once, by footprint (to `parts` tasks), with their height and place alone; heights
    are counted and ranked where the footprint is.
    """
    keys = list(keys)
    slim = hits.select(*keys, F.col(z).alias("_z"), (F.col(x) - F.col(ox)).alias("_dx"), (F.col(y) - F.col(oy)).alias("_dy"))
    zero = F.lit(0)
    dealt = slim.repartition(parts, *keys) if parts else slim.repartition(*keys)
    hist = height_histogram(dealt.withColumns({"_ox": zero, "_oy": zero}), keys, "_dx", "_dy", "_z", "_ox", "_oy")
    ground = _ranked(_known(hist), keys, {"ground": 0.05}, "_all").filter(F.col("_all") >= rules.min_points).drop("_all")
    body = ground.filter(F.col("h") > F.col("ground") + rules.above_ground)
    body = _ranked(body, keys, {"eave": 0.15, "_p95": 0.95, "_p90": 0.90}, "structure").filter(F.col("structure") >= rules.min_structure)
    body = body.filter(F.col("h") >= F.col("_p90"))
    high = F.sum(F.when(F.col("h") >= F.col("_p95"), F.col("n")).otherwise(0)).over(Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = body.withColumn("_enough", high >= 5).filter(~F.col("_enough") | (F.col("h") >= F.col("_p95")))
    top = _ranked(top, keys, {"ridge": 0.5}, "_top")
    moments = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    sums = top.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("ground", "eave", "structure", "ridge")], *moments)
    return sums.select(*keys, "ground", "eave", "ridge", "structure", "n", "sx", "sy", "sxx", "syy", "sxy").withColumnsRenamed({"n": "top"})


def principal_axis(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Struct long, short, azimuth of the 2 x 2 sample covariance, in closed form."""
    scale = n * (n - 1)
    a, c, b = (n * sxx - sx * sx) / scale, (n * syy - sy * sy) / scale, (n * sxy - sx * sy) / scale
    half, root = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    theta = F.atan2(b * 2, a - c) / 2
    azimuth = F.pmod(F.degrees(F.atan2(F.cos(theta), F.sin(theta))), F.lit(180.0))
    return F.struct((half + root).alias("long"), (half - root).alias("short"), azimuth.alias("azimuth"))


def roof_shapes(profiles: DataFrame, short_side: str, scale: float = 1.0, rules: RoofRules = RULES) -> DataFrame:
    """Add shape, eave and clamped rise, and ridge bearing. `scale` turns map lengths into ground lengths."""
    side = F.col(short_side) * scale
    staged = profiles.withColumns({
        "eave_h": F.greatest(F.col("eave") - F.col("ground"), F.lit(0.0)),
        "rise": F.greatest(F.col("ridge") - F.col("eave"), F.lit(0.0)),
        "_side": side,
        "_axis": F.when(F.col("top") >= 5, principal_axis(*[F.col(c).cast("double") for c in ("top", "sx", "sy", "sxx", "syy", "sxy")])),
    }).filter(F.col("eave_h") >= rules.min_eave)
    width = F.greatest(F.col("_side"), F.lit(1e-3))
    flat = (F.col("rise") < rules.flat_rise) | (F.col("rise") / width < rules.flat_ratio)
    axis = F.col("_axis")
    # Ratios compared as squares: no division by a vanishing variance.
    gable = ((axis["short"] > 0) & (axis["long"] >= axis["short"] * rules.gable_elongation ** 2)
             & (F.sqrt(axis["short"]) * 2 * scale <= width * rules.gable_width))
    shape = F.when(flat, FLAT).when(F.coalesce(gable, F.lit(False)), GABLE).otherwise(HIP)
    staged = staged.withColumn("shape", shape)
    rise = F.when(F.col("shape") == FLAT, 0.0).otherwise(F.least(F.col("rise"), F.col("_side") * rules.rise_share, F.lit(float(rules.max_rise))))
    return staged.withColumns({"rise": rise, "ridge_deg": F.when(F.col("shape") == GABLE, axis["azimuth"]).otherwise(0.0)}).drop("_axis", "_side")


def shape_counts(roofs: DataFrame, tile="tx") -> DataFrame:
    """Flat, gable and hip counts per tile and overall (tile NULL)."""
    count = lambda k: F.sum(F.when(F.col("shape") == k, 1).otherwise(0))
    return roofs.rollup(tile).agg(count(FLAT).alias("flat"), count(GABLE).alias("gable"), count(HIP).alias("hip"), F.count("*").alias("n"))


# -- Records ------------------------------------------------------------------

def record_pairs(footprints: DataFrame, records: DataFrame, fid: str, rec_id: str, radius: float, cell: float,
                 on: Sequence[str] = ("tx",), x="x", y="y") -> DataFrame:
    """Footprint and record pairs closer than `radius` (at most one cell)."""
    seekers = cells.with_point_cell(footprints.select(*on, fid, F.col(x).alias("_fx"), F.col(y).alias("_fy")), "_fx", "_fy", cell)
    targets = cells.with_neighbour_cells(records.select(*on, rec_id, F.col(x).alias("_rx"), F.col(y).alias("_ry")), "_rx", "_ry", cell)
    dx, dy = F.col("_rx") - F.col("_fx"), F.col("_ry") - F.col("_fy")
    return (seekers.join(by_keys(targets), [*on, cells.CELL_X, cells.CELL_Y]).withColumn("d2", dx * dx + dy * dy)
            .filter(F.col("d2") < radius * radius).select(fid, rec_id, "d2"))


def match_records(footprints: DataFrame, records: DataFrame, fid: str, rec_id: str, radius: float = 6.0, cell: float = 10.0,
                  on: Sequence[str] = ("tx",), x="x", y="y") -> DataFrame:
    """One record per footprint, in footprint order, each record used once."""
    return graph.match_nearest_once(record_pairs(footprints, records, fid, rec_id, radius, cell, on, x, y), fid, rec_id, "d2")


def attach_eaves(buildings: DataFrame, height="height", area="area_m2", eave="eave_m") -> DataFrame:
    """Height after the sanity rule, replaced by a trusted eave (checked again)."""
    safe = buildings.withColumn("_safe", sane_height(height, area))
    use = F.coalesce(eave_trusted(eave, "_safe"), F.lit(False))
    return safe.withColumn("height", F.when(use, sane_height(eave, area)).otherwise(F.col("_safe"))).drop("_safe")


def ground_probes(buildings: DataFrame, keep: Sequence[str], ring="ring") -> DataFrame:
    """The centroid (probe 0) and the four bounding-box corners of each ring."""
    staged = buildings.withColumns({"_b": rings.ring_bounds(ring), "_c": rings.ring_centroid(ring)})
    b = F.col("_b")
    pts = [(F.col("_c.x"), F.col("_c.y")), (b["min_x"], b["min_y"]), (b["max_x"], b["min_y"]), (b["min_x"], b["max_y"]), (b["max_x"], b["max_y"])]
    probes = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])
    return (staged.select(*keep, F.posexplode(probes).alias("probe", "_p"))
            .select(*keep, "probe", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")))


def ground_levels(sampled: DataFrame, keep: Sequence[str], elev="elev") -> DataFrame:
    """Lowest of the five probes and the centroid's own height."""
    return sampled.groupBy(*keep).agg(F.min(elev).alias("lowest"), F.max(F.when(F.col("probe") == 0, F.col(elev))).alias("centre"))


def base_and_top(levels: DataFrame, height: ColumnLike, base: ColumnLike) -> DataFrame:
    """Base below the lowest ground, top above the centroid; buildings standing in water are dropped."""
    return (levels.filter(F.col("centre") > WATER_BUILDING_M)
            .withColumns({"base_y": F.col("lowest") - BASE_SINK_M + col(base), "top_y": F.col("centre") + col(height)}))


def dry_polygons(levels: DataFrame) -> DataFrame:
    """Ground polygons none of whose probes is at water level."""
    return levels.filter(F.col("lowest") > WATER_GREEN_M)


def cells_in_rings(footprints: DataFrame, tile: Sequence[str], nx: int, ny: int, size, ring="ring") -> DataFrame:
    """Raster cells whose centre lies in a ring, generated from the ring's own box (no join). Edges are laid out once per ring."""
    staged = footprints.select(*tile, rings.ring_bounds(ring).alias("_b"), rings.flat_edges(ring).alias("_edges"))
    span = lambda low, high, n: F.sequence(F.greatest(F.lit(0).cast("bigint"), whole(low / size)), F.least(F.lit(n - 1).cast("bigint"), whole(high / size)))
    b = F.col("_b")
    fits = (b["max_x"] >= 0) & (b["max_y"] >= 0) & (b["min_x"] < nx * size) & (b["min_y"] < ny * size)
    grid = (staged.filter(fits).withColumn("cx", F.explode(span(b["min_x"], b["max_x"], nx)))
            .withColumn("_row", F.explode(span(b["min_y"], b["max_y"], ny))))
    inside = rings.inside_edges((F.col("cx") + 0.5) * size, (F.col("_row") + 0.5) * size, "_edges")
    return grid.filter(inside).select(*tile, "cx", (F.lit(ny - 1).cast("bigint") - F.col("_row")).alias("cy")).distinct()
