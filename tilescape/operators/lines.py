"""Polylines as arrays of struct(x, y): clipping, subdivision, decks, ribbons, walls, stripes.

A line is one row, so every step here is a narrow projection (plus one explode at the
end); nothing is regrouped per line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilescape.functions import colours, rings, scatter
from tilescape.functions._base import ColumnLike, clamp, col, explode_items, half_up, num, whole
from tilescape.functions.classify import compass_bearing

from . import cells, nearest

# Drape offsets in metres above the surface.
DRAPE = {"road": 0.6, "lane": 0.63, "green": 0.15, "landuse": 0.12,
         "paint_ribbon": 0.35, "paint_polygon": 0.25, "crosswalk": 0.55}
WATER_LEVEL = 0.5
MAX_SEGMENT_M = 30.0
# Bridges.
WATER_ELEVATION, WATER_RUN, LAND_CLEARANCE, DECK_THICKNESS = 1.5, 300.0, 7.0, 1.5
WATER_CLEARANCE_MIN, WATER_CLEARANCE_MAX, WATER_CLEARANCE_RUN = 15.0, 55.0, 2000.0
PIER_SPACING, PIER_MIN_CLEARANCE = 80.0, 4.0
# Crosswalk stripes and street trees.
STRIPE, STRIPE_GAP, STRIPES_MIN, STRIPES_MAX = 0.6, 0.6, 3, 32
STREET_SPACING, STREET_OFFSET = 24.0, 5.0
PARK_AREA_PER_TREE, PARK_MAX = 350.0, 200


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _pairs(path: Column) -> Column:
    """Array of struct(a, b) of consecutive vertices (open line)."""
    n = F.size(path)
    return F.zip_with(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _length(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def cumulative(values: Column) -> Column:
    """0, v1, v1 + v2, ... as an array."""
    return F.aggregate(values, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def segments(lines: DataFrame, path="path") -> DataFrame:
    """One row per segment: seg, a, b, length, and the length before it."""
    pairs = _pairs(col(path))
    staged = lines.withColumn("_pairs", pairs).withColumn("_len", F.transform("_pairs", _length)).withColumn("_cum", cumulative(F.col("_len")))
    return (explode_items(staged, [*lines.columns, "_len", "_cum"], F.col("_pairs"), "seg", "_s")
            .select(*lines.columns, "seg", F.col("_s.a").alias("a"), F.col("_s.b").alias("b"),
                    F.get("_len", F.col("seg")).alias("length"), F.get("_cum", F.col("seg")).alias("before")))


def subdivide(path: ColumnLike, max_len: float = MAX_SEGMENT_M) -> Column:
    """Insert evenly spaced vertices so that no segment is longer than `max_len`."""
    path = col(path)

    def pieces(s: Column) -> Column:
        n = F.greatest(F.ceil(_length(s) / max_len), F.lit(1).cast("bigint"))
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        inner = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda k: F.when(
            k == n, s["b"]).otherwise(_point(s["a"]["x"] + dx * (k / n), s["a"]["y"] + dy * (k / n))))
        return inner

    return F.when(F.size(path) < 2, path).otherwise(
        F.concat(F.slice(path, F.lit(1), F.lit(1)), F.flatten(F.transform(_pairs(path), pieces))))


def clip_to_box(path: ColumnLike, extent) -> Column:
    """Pieces of a line inside [0, extent]^2 with exact crossing vertices, as an array of lines."""
    path, extent = col(path), num(extent)

    def window(s: Column) -> Column:
        a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
        for start, step in ((a["x"], dx), (a["y"], dy)):
            t_low, t_high = -start / step, (extent - start) / step
            enter = F.greatest(enter, F.when(step > 0, t_low).when(step < 0, t_high))
            leave = F.least(leave, F.when(step > 0, t_high).when(step < 0, t_low))
            outside = outside | ((step == 0) & ((start < 0) | (start > extent)))
        at = lambda t: _point(a["x"] + t * dx, a["y"] + t * dy)
        return F.struct(at(enter).alias("a"), at(leave).alias("b"), (~outside & (enter <= leave)).alias("kept"),
                        (enter > 0).alias("enters"), (leave < 1).alias("leaves"))

    cast_path = F.transform(path, lambda p: _point(p["x"].cast("double"), p["y"].cast("double")))
    none = F.slice(cast_path, F.lit(1), F.lit(0))
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
    flushed = lambda done, cur: F.when(F.size(cur) >= 2, F.concat(done, F.array(cur))).otherwise(done)

    def push(cur: Column, p: Column) -> Column:
        return F.when(F.coalesce(F.try_element_at(cur, F.lit(-1)) == p, F.lit(False)), cur).otherwise(F.concat(cur, F.array(p)))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["enters"] | ~s["kept"]
        done = F.when(fresh, flushed(acc["done"], acc["cur"])).otherwise(acc["done"])
        cur = F.when(fresh, none).otherwise(acc["cur"])
        grown = push(F.when(F.size(cur) == 0, F.array(s["a"])).otherwise(cur), s["b"])
        cur = F.when(s["kept"], grown).otherwise(none)
        ends = s["kept"] & s["leaves"]
        return state(F.when(ends, flushed(done, cur)).otherwise(done), F.when(ends, none).otherwise(cur))

    start = state(F.slice(F.array(none), F.lit(1), F.lit(0)), none)
    return F.aggregate(F.transform(_pairs(cast_path), window), start, step, lambda acc: flushed(acc["done"], acc["cur"]))


def side_offsets(path: ColumnLike, half_width) -> Column:
    """Left and right ribbon points per vertex: the normal of (next - previous)."""
    path, hw = col(path), num(half_width)
    n = F.size(path)

    def at(p: Column, i: Column) -> Column:
        before, after = F.get(path, F.greatest(i - 1, F.lit(0))), F.get(path, F.least(i + 1, n - 1))
        tx, ty = after["x"] - before["x"], after["y"] - before["y"]
        scale = hw / F.coalesce(F.nullif(F.hypot(tx, ty), F.lit(0.0)), F.lit(1.0))
        return F.struct(_point(p["x"] - ty * scale, p["y"] + tx * scale).alias("left"),
                        _point(p["x"] + ty * scale, p["y"] - tx * scale).alias("right"))

    return F.transform(path, at)


def edge_lines(path: ColumnLike, half_width: float, inset: float = 0.4) -> Column:
    """The two painted edge lines of a motorway, as struct(left, right) arrays."""
    sides = side_offsets(path, half_width - inset)
    return F.struct(F.transform(sides, lambda s: s["left"]).alias("left"), F.transform(sides, lambda s: s["right"]).alias("right"))


# -- Bridges ------------------------------------------------------------------

def water_run(path: ColumnLike, terrain: ColumnLike) -> Column:
    """Longest stretch whose segments have both ends at water level."""
    wet = F.transform(col(terrain), lambda t: t <= WATER_ELEVATION)
    legs = F.zip_with(_pairs(col(path)), _pairs(wet), lambda s, w: F.struct(_length(s).alias("len"), (w["a"] & w["b"]).alias("wet")))
    zero = F.struct(F.lit(0.0).alias("best"), F.lit(0.0).alias("cur"))

    def step(acc: Column, leg: Column) -> Column:
        cur = F.when(leg["wet"], acc["cur"] + leg["len"]).otherwise(0.0)
        return F.struct(F.greatest(acc["best"], cur).alias("best"), cur.alias("cur"))

    return F.aggregate(legs, zero, step, lambda acc: acc["best"])


def deck_profile(terrain: ColumnLike, run: ColumnLike) -> Column:
    """Deck height per vertex before smoothing: clearance over land, more over long water."""
    terrain, run = col(terrain), col(run)
    over_water = WATER_CLEARANCE_MIN + F.least(F.lit(1.0), run / WATER_CLEARANCE_RUN) * (WATER_CLEARANCE_MAX - WATER_CLEARANCE_MIN)
    return F.transform(terrain, lambda t: F.when(
        (run > WATER_RUN) & (t <= WATER_ELEVATION), F.greatest(over_water, t + LAND_CLEARANCE)).otherwise(t + LAND_CLEARANCE))


def smooth_ends(values: ColumnLike, window: int = 5) -> Column:
    """Moving mean whose index is clamped, so the end values repeat."""
    values = col(values)
    half = window // 2
    last = F.size(values) - 1

    def mean(_, i: Column) -> Column:
        total = F.lit(0.0)
        for k in range(-half, half + 1):
            total = total + F.get(values, F.greatest(F.lit(0), F.least(last, i + k)))
        return total / window

    return F.transform(values, mean)


def with_deck(lines: DataFrame, path="path", terrain="terrain") -> DataFrame:
    """Add `water_run` and the smoothed `deck` array."""
    return (lines.withColumn("water_run", water_run(path, terrain)).withColumn("_raw", deck_profile(terrain, "water_run"))
            .withColumn("deck", smooth_ends("_raw")).drop("_raw"))


def oriented_box(ax: Column, ay: Column, bx: Column, by: Column, half_width) -> list[Column]:
    """Unit axes, length and extents of a segment box."""
    length = F.hypot(bx - ax, by - ay)
    tx, ty = (bx - ax) / length, (by - ay) / length
    hw = num(half_width)
    hx = F.abs(tx) * length / 2 + F.abs(ty) * hw
    hy = F.abs(ty) * length / 2 + F.abs(tx) * hw
    mx, my = (ax + bx) / 2, (ay + by) / 2
    return [ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), hw.alias("half_width"), length.alias("length"),
            tx.alias("tx_"), ty.alias("ty_"), (mx - hx).alias("min_x"), (my - hy).alias("min_y"),
            (mx + hx).alias("max_x"), (my + hy).alias("max_y")]


def deck_boxes(lines: DataFrame, half_width, keep: Sequence[str], path="path") -> DataFrame:
    """One oriented box per deck segment: top is the higher end, bottom the lower end minus the slab."""
    both = F.zip_with(_pairs(col(path)), _pairs(col("deck")), lambda s, d: F.struct(s.alias("s"), d.alias("d")))
    staged = explode_items(lines, [*keep, num(half_width).alias("_hw")], both, "seg", "_p")
    staged = staged.filter(_length(F.col("_p.s")) >= 1e-4)
    a, b = F.col("_p.s.a"), F.col("_p.s.b")
    return staged.select(*keep, "seg", *oriented_box(a["x"], a["y"], b["x"], b["y"], F.col("_hw")),
                         F.greatest("_p.d.a", "_p.d.b").alias("top"), (F.least("_p.d.a", "_p.d.b") - DECK_THICKNESS).alias("bottom"))


def piers(lines: DataFrame, keep: Sequence[str], path="path", terrain="terrain") -> DataFrame:
    """Piers every 80 m from 40 m on, at the last vertex not beyond the station."""
    cum = cumulative(F.transform(_pairs(col(path)), _length))
    staged = lines.withColumn("_cum", cum).withColumn("_total", F.element_at("_cum", -1))
    half = PIER_SPACING / 2
    count = F.ceil((F.col("_total") - half) / PIER_SPACING)
    staged = (staged.filter(F.col("_total") > half)
              .select(*keep, col(path).alias("_path"), "deck", col(terrain).alias("_terr"), "_cum",
                      F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("pier"))
              .withColumn("station", F.col("pier") * PIER_SPACING + half)
              .withColumn("_at", F.size(F.filter(F.slice("_cum", F.lit(2), F.size("_cum")), lambda c: c < F.col("station")))))
    base = F.least(F.get("_terr", F.col("_at")), F.lit(0.0)) - 2
    p = F.get("_path", F.col("_at"))
    return (staged.select(*keep, "pier", "station", p["x"].alias("x"), p["y"].alias("y"), base.alias("base"),
                          F.get("deck", F.col("_at")).alias("deck_y"))
            .filter(F.col("deck_y") - F.col("base") >= PIER_MIN_CLEARANCE))


# -- Roads near nodes ---------------------------------------------------------

def nearest_road_bearing(nodes: DataFrame, roads: DataFrame, node_id: str, road_id: str, piece: float = 0.002) -> DataFrame:
    """Bearing of the road segment nearest to each node, 0.0 when there is no road. Ties: lowest road, segment.

    Segments are cut into pieces of at most `piece` degrees along each axis, or of the segments' mean
    span where that is less (which at most doubles their number), and a node meets the pieces whose
    centres can be nearest up to half a piece (`nearest.candidate_pairs`). So where short segments lie
    dense, a node does not meet all of those within half of a fixed length.
    """
    path = F.transform("path", lambda p: _point(p["lon"], p["lat"]))
    legs = segments(roads.select(road_id, path.alias("path"))).select(
        road_id, "seg", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    span = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    usual = legs.agg(F.avg(span)).first()[0]
    piece = piece if usual is None else min(piece, max(usual, 1e-7))
    many = F.greatest(F.ceil(span / piece), F.lit(1).cast("bigint"))
    counted = legs.withColumn("_n", many)
    at = lambda p, q: F.col(p) + (F.col(q) - F.col(p)) * ((F.col("_k") + 0.5) / F.col("_n"))
    pieces = (counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
              .select(road_id, "seg", "ax", "ay", "bx", "by", at("ax", "bx").alias("_mx"), at("ay", "by").alias("_my")))
    places = nodes.select(node_id, "lon", "lat")
    pairs = nearest.candidate_pairs(places, pieces, 1, ("lon", "lat"), ("_mx", "_my"), scale=F.cos(F.radians("lat")), slack=piece * 0.7072)
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length2 = vx * vx + vy * vy
    t = F.when(length2 == 0, 0.0).otherwise(clamp(((F.col("lon") - F.col("ax")) * vx + (F.col("lat") - F.col("ay")) * vy) / length2, 0.0, 1.0))
    pairs = pairs.withColumn("_t", t)
    east = (F.col("ax") + F.col("_t") * vx - F.col("lon")) * F.cos(F.radians("lat"))
    distance = F.hypot(east, F.col("ay") + F.col("_t") * vy - F.col("lat"))
    best = pairs.groupBy(node_id).agg(F.min(F.struct(
        distance.alias("d"), F.col(road_id), F.col("seg"),
        compass_bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("bearing"))).alias("_b"))
    return places.join(best, node_id, "left").select(node_id, F.coalesce("_b.bearing", F.lit(0.0)).alias("bearing"), F.col("_b.d").alias("distance"))


# -- Walls --------------------------------------------------------------------

def wall_edges(solids: DataFrame, ring: str, keep: Sequence[str], hole: bool = False) -> DataFrame:
    """Edges of a ring with outward normal, length and the length before (texture offset)."""
    sign = -1.0 if hole else 1.0
    edges = rings.ring_edges(ring)
    staged = solids.withColumn("_edges", edges).withColumn("_cum", cumulative(F.transform("_edges", _length)))
    staged = explode_items(staged, [*keep, "_cum"], F.col("_edges"), "edge", "_e").withColumn("length", _length(F.col("_e")))
    a, b = F.col("_e.a"), F.col("_e.b")
    return (staged.filter(F.col("length") >= 1e-4)
            .select(*keep, "edge", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), "length",
                    F.get("_cum", F.col("edge")).alias("before"),
                    (-(b["y"] - a["y"]) / F.col("length") * sign).alias("nx"), ((b["x"] - a["x"]) / F.col("length") * sign).alias("ny")))


def first_claims(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep the first of all edges with the same rounded ends (in either direction).

    A minimum per key is a partial aggregate, so even an edge repeated by a third of the
    rows is reduced before the shuffle.
    """
    end = lambda x, y: F.struct(half_up(F.col(x) * 4).alias("x"), half_up(F.col(y) * 4).alias("y"))
    p, q = end("ax", "ay"), end("bx", "by")
    rest = [c for c in edges.columns if c not in order]
    keyed = edges.withColumns({"_k0": F.least(p, q), "_k1": F.greatest(p, q)})
    first = F.min(F.struct(*order, *rest)).alias("_f")
    return keyed.groupBy("_k0", "_k1").agg(first).select(*[F.col(f"_f.{c}").alias(c) for c in edges.columns])


# -- Stripes, facets and scatter ----------------------------------------------

def crosswalk_stripes(decals: DataFrame, keep: Sequence[str], x="x", y="y", bearing="bearing_deg", length="len_m", width="width_m") -> DataFrame:
    """Corner coordinates of the stripes of each crossing; y is south-positive."""
    stride = STRIPE + STRIPE_GAP
    n = F.greatest(F.lit(STRIPES_MIN).cast("bigint"), F.least(F.lit(STRIPES_MAX).cast("bigint"), whole(F.col(length) / stride)))
    staged = (decals.withColumn("_n", n).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
              .withColumn("_from", -(F.col("_n") * stride - STRIPE_GAP) / 2 + F.col("stripe") * stride)
              .withColumn("_angle", F.radians(bearing)))
    along_x, along_y, across_x, across_y = F.sin("_angle"), -F.cos("_angle"), F.cos("_angle"), F.sin("_angle")
    half = F.col(width) / 2
    corner = lambda s, w: _point(F.col(x) + along_x * s + across_x * w, F.col(y) + along_y * s + across_y * w)
    start, stop = F.col("_from"), F.col("_from") + STRIPE
    return staged.select(*keep, "stripe", F.array(corner(start, -half), corner(stop, -half), corner(stop, half), corner(start, half)).alias("corners"))


def roof_facets(roofs: DataFrame, ring: str, keep: Sequence[str], shape="shape", eave="eave_y", rise="rise_m", ridge="ridge_deg") -> DataFrame:
    """One triangle per footprint edge: to the nearer ridge end (gable) or to the centroid (hip)."""
    staged = roofs.withColumns({"_b": rings.ring_bounds(ring), "_c": rings.ring_centroid(ring)})
    b, c = F.col("_b"), F.col("_c")
    staged = staged.withColumn("_rise", F.least(F.col(rise), rings.short_side(b) * 0.5, F.lit(12.0)))
    dx, dy = F.sin(F.radians(ridge)), -F.cos(F.radians(ridge))
    staged = staged.withColumns({"_dx": dx, "_dy": dy})

    def span(low: Column, high: Column, start: Column, d: Column):
        moving = F.abs(d) > 1e-6
        t1, t2 = (low - start) / d, (high - start) / d
        return F.when(moving, F.least(t1, t2)), F.when(moving, F.greatest(t1, t2))

    x_lo, x_hi = span(b["min_x"], b["max_x"], c["x"], F.col("_dx"))
    y_lo, y_hi = span(b["min_y"], b["max_y"], c["y"], F.col("_dy"))
    staged = staged.withColumns({"_t0": F.greatest(x_lo, y_lo), "_t1": F.least(x_hi, y_hi)})
    gable = (F.col(shape) == 1) & (F.col("_t1") - F.col("_t0") >= 0.5)
    end = lambda t: _point(c["x"] + F.col("_dx") * F.col(t), c["y"] + F.col("_dy") * F.col(t))
    staged = staged.filter((F.col(shape) != 0) & (F.col(rise) > 0)).withColumns({"_gable": gable, "_r0": end("_t0"), "_r1": end("_t1")})
    staged = explode_items(staged, [*keep, "_gable", "_r0", "_r1", "_c", F.col(eave).alias("eave"), (F.col(eave) + F.col("_rise")).alias("top")],
                           rings.ring_edges(ring), "edge", "_e")
    mx, my = (F.col("_e.a.x") + F.col("_e.b.x")) / 2, (F.col("_e.a.y") + F.col("_e.b.y")) / 2
    d2 = lambda r: (mx - F.col(f"{r}.x")) * (mx - F.col(f"{r}.x")) + (my - F.col(f"{r}.y")) * (my - F.col(f"{r}.y"))
    apex = F.when(~F.col("_gable"), F.col("_c")).when(d2("_r0") < d2("_r1"), F.col("_r0")).otherwise(F.col("_r1"))
    return (staged.withColumn("_apex", apex)
            .select(*keep, "edge", F.col("_e.a").alias("a"), F.col("_e.b").alias("b"), F.col("_apex").alias("apex"), "eave", "top",
                    F.col("_gable").alias("gable")))


def street_trees(lines: DataFrame, line_id: str, path="path", spacing: float = STREET_SPACING) -> DataFrame:
    """Trees along a line at even arc-length stations, jittered and put on a random side."""
    legs = segments(lines.select(line_id, col(path).alias("path"))).filter(F.col("length") >= 1e-3)
    first = whole(F.col("before") / spacing) + 1
    last = whole((F.col("before") + F.col("length")) / spacing)
    legs = (legs.withColumns({"_first": first, "_last": last}).filter(F.col("_last") >= F.col("_first"))
            .withColumn("station", F.explode(F.sequence("_first", "_last"))))
    seed0 = colours.hash32(line_id, "station")
    legs = legs.withColumn("_s1", scatter.next_seed(seed0)).withColumn("_s2", scatter.next_seed(F.col("_s1"))).withColumn("_s3", scatter.next_seed(F.col("_s2")))
    along = clamp(F.col("station") * spacing - F.col("before") + (scatter.unit(F.col("_s1")) - 0.5) * 8, F.lit(0.0), F.col("length"))
    side = F.when(F.col("_s2") % 2 == 0, 1.0).otherwise(-1.0) * (STREET_OFFSET + (scatter.unit(F.col("_s3")) - 0.5) * 2)
    ux, uy = (F.col("b.x") - F.col("a.x")) / F.col("length"), (F.col("b.y") - F.col("a.y")) / F.col("length")
    legs = legs.withColumns({"_along": along, "_side": side})
    return legs.select(line_id, "station", (F.col("a.x") + ux * F.col("_along") - uy * F.col("_side")).alias("x"),
                       (F.col("a.y") + uy * F.col("_along") + ux * F.col("_side")).alias("y"),
                       scatter.is_conifer(scatter.next_seed(F.col("_s3"))).alias("conifer"))


def park_trees(parks: DataFrame, park_id: str, ring="ring") -> DataFrame:
    """Random positions inside a ring: twice the target number is drawn, those outside are dropped."""
    staged = parks.withColumn("_b", rings.ring_bounds(ring))
    b = F.col("_b")
    area = F.greatest((b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"]), F.lit(0.0))
    target = F.least(F.lit(PARK_MAX).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), whole(area / PARK_AREA_PER_TREE)))
    place = lambda s, low, high: F.col(f"_b.{low}") + scatter.unit(F.col(s)) * (F.col(f"_b.{high}") - F.col(f"_b.{low}"))
    staged = staged.withColumns({"_n": target * 2, "_edges": rings.flat_edges(ring)})
    # Draws are rows, not items of an array, so Spark compiles their arithmetic. The list of one place
    # keeps it from being worked out again in the containment test, which reads plain columns.
    draws = staged.select(park_id, "_b", "_edges", F.explode_outer(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("draw"))
    seeds = draws.withColumn("_s1", scatter.next_seed(colours.hash32(park_id, "draw"))).withColumn("_s2", scatter.next_seed(F.col("_s1")))
    at = F.struct(place("_s1", "min_x", "max_x").alias("x"), place("_s2", "min_y", "max_y").alias("y"))
    placed = seeds.select(park_id, "draw", "_edges", F.explode_outer(F.array(at)).alias("_p")).select(park_id, "draw", "_edges", "_p.x", "_p.y")
    return placed.filter(rings.inside_edges("x", "y", "_edges")).select(park_id, "draw", "x", "y")


def first_per_tile(rows: DataFrame, tile: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """The first `cap` rows of each tile in input order (the layer's published limit)."""
    w = Window.partitionBy(*tile).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def drape(vertices: DataFrame, layer: ColumnLike, surface="surface", out="y") -> DataFrame:
    """Height of draped vertices; water stays at its own level."""
    from tilescape.functions.classify import lookup
    layer = col(layer)
    return vertices.withColumn(out, F.when(layer == "water", F.lit(WATER_LEVEL)).otherwise(F.col(surface) + lookup(DRAPE, layer)))
