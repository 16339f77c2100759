"""Attribute rules: paint kinds, building heights, place labels, headings, detail tiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ._base import ColumnLike, clamp, col, half_up, num

# Paint kinds, their geometry and default widths in metres.
PAINT_KINDS = ("sidewalk", "path", "crosswalk", "court", "plaza", "parking", "sand", "pier_deck")
POLYGON_KINDS = ("plaza", "court", "parking", "sand", "pier_deck")
PAINT_WIDTH_M = {"sidewalk": 3.0, "path": 2.0, "pier_deck": 8.0}
PAINT_WIDTH_OTHER_M = 2.0
CROSSWALK_LENGTH_M, CROSSWALK_WIDTH_M = 12.0, 5.0
ROAD_HIGHWAYS = ("residential", "tertiary", "secondary", "primary", "trunk")

# Building height rules in metres.
HEIGHT_DEFAULT, HEIGHT_MIN, HEIGHT_MAX, HEIGHT_SLAB = 5.0, 1.0, 500.0, 0.5
EAVE_MIN_M, EAVE_MIN_SHARE = 2.0, 0.4

# Map pins by tier 1..3.
PIN_RANGE_M = {1: 5200.0, 2: 1900.0, 3: 750.0}
PIN_SCALE = {1: 1.5, 2: 1.0, 3: 0.78}
PIN_HOVER_M = {1: 90.0, 2: 34.0, 3: 16.0}
PIN_MAX_VISIBLE = 48

COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def lookup(table: dict, key: Column, default=None) -> Column:
    """Literal map lookup, folded into the projection (no dimension join)."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


# -- Map features -------------------------------------------------------------

def tag(tags: ColumnLike, key: str) -> Column:
    """Tag value, empty string when absent."""
    return F.coalesce(F.element_at(col(tags), F.lit(key)), F.lit(""))


def footway_kind(tags: ColumnLike) -> Column:
    """Paint kind of a way, NULL when it is not painted. First rule wins."""
    highway, foot, area = tag(tags, "highway"), tag(tags, "footway"), tag(tags, "area")
    return (F.when((foot == "sidewalk") | ((highway == "footway") & (foot != "crossing")), "sidewalk")
            .when(highway == "path", "path")
            .when((highway == "pedestrian") & (area == "yes"), "plaza")
            .when(tag(tags, "leisure") == "pitch", "court")
            .when((tag(tags, "amenity") == "parking") & (area != "no"), "parking")
            .when(tag(tags, "natural") == "beach", "sand")
            .when(tag(tags, "man_made") == "pier", "pier_deck"))


def painted_as_polygon(kind: ColumnLike, path: ColumnLike) -> Column:
    """Area kinds with a closed path of at least four vertices."""
    path = col(path)
    return (col(kind).isin(*POLYGON_KINDS) & (F.size(path) >= 4)
            & (F.get(path, F.lit(0)) == F.try_element_at(path, F.lit(-1))))


def paint_width(kind: ColumnLike) -> Column:
    return lookup(PAINT_WIDTH_M, col(kind), PAINT_WIDTH_OTHER_M)


def is_marked_crossing(tags: ColumnLike) -> Column:
    crossing = tag(tags, "crossing")
    return ((tag(tags, "highway") == "crossing") | (crossing != "")) & ~crossing.isin("unmarked", "no")


def selected_for_paint(tags: ColumnLike, kind: ColumnLike) -> Column:
    """The element selection of the paint extract (ways and nodes)."""
    t = lambda k: tag(tags, k)
    way = ((t("footway") == "sidewalk") | t("highway").isin("footway", "path", "pedestrian", *ROAD_HIGHWAYS)
           | (t("leisure") == "pitch") | ((t("amenity") == "parking") & (t("area") != "no"))
           | (t("natural") == "beach") | (t("man_made") == "pier"))
    node = (t("highway") == "crossing") | t("crossing").rlike("marked|zebra|traffic_signals|uncontrolled")
    return F.when(col(kind) == "way", way).when(col(kind) == "node", node).otherwise(False)


def selected_as_building(tags: ColumnLike, kind: ColumnLike) -> Column:
    return col(kind).isin("way", "relation") & F.map_contains_key(col(tags), F.lit("building"))


def compass_bearing(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Degrees clockwise from north of a short segment."""
    east = (lon1 - lon0) * F.cos(F.radians((lat0 + lat1) / 2))
    return F.pmod(F.degrees(F.atan2(east, lat1 - lat0)), F.lit(360.0))


def way_bearing(path: ColumnLike) -> Column:
    """Bearing from the first to the last vertex; 0 for fewer than two."""
    path = col(path)
    a, b = F.get(path, F.lit(0)), F.try_element_at(path, F.lit(-1))
    return F.when(F.size(path) >= 2, compass_bearing(a["lon"], a["lat"], b["lon"], b["lat"])).otherwise(0.0)


# -- Buildings ----------------------------------------------------------------

def _leading_number(text: Column) -> Column:
    head = F.regexp_extract(F.trim(text), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return head.try_cast("double")


def building_heights(props: ColumnLike) -> Column:
    """Struct height, base from a property map, NULL when the feature is dropped."""
    props = col(props)
    value = lambda k: F.element_at(props, F.lit(k))
    lowest = _leading_number(value("render_min_height"))
    height = clamp(F.coalesce(_leading_number(value("render_height")), F.lit(HEIGHT_DEFAULT)), HEIGHT_MIN, HEIGHT_MAX)
    hidden = F.coalesce(value("hide_3d").isin("1", "true"), F.lit(False))
    dropped = hidden | F.coalesce(lowest >= height, F.lit(False))
    base = clamp(F.coalesce(lowest, F.lit(0.0)), F.lit(0.0), height - HEIGHT_SLAB)
    return F.when(~dropped, F.struct(height.alias("height"), base.alias("base")))


def sane_height(height: ColumnLike, area_m2: ColumnLike) -> Column:
    """Replace heights that cannot fit the footprint."""
    h, area = col(height), col(area_m2)
    return (F.when((h > 400) | ((h > 150) & (area < 100)), HEIGHT_DEFAULT)
            .when((h > 50) & (area > 25000), F.least(h, F.lit(20.0))).otherwise(h))


def eave_trusted(eave_m: ColumnLike, map_height_m: ColumnLike) -> Column:
    return (col(eave_m) >= EAVE_MIN_M) & (col(eave_m) >= col(map_height_m) * EAVE_MIN_SHARE)


# -- Places -------------------------------------------------------------------

def place_label(housenumber, street, name, city, district, locality, county, state) -> Column:
    """`number street, city` with fallbacks; the city is never repeated."""
    num_, street, name, city, district, locality, county, state = (
        F.nullif(col(v), F.lit("")) for v in (housenumber, street, name, city, district, locality, county, state))
    town = F.coalesce(city, district, locality, county, state)
    head = F.coalesce(F.concat(num_, F.lit(" "), street), street, name, locality, county)
    label = F.concat_ws(", ", head, F.when(head.isNull() | (town != head), town))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("(unnamed place)"))


# -- Headings and angles ------------------------------------------------------

def compass_label(degrees: ColumnLike) -> Column:
    step = half_up(F.pmod(col(degrees), F.lit(360.0)) / 45.0) % 8
    return F.element_at(F.array(*[F.lit(v) for v in COMPASS]), (step + 1).cast("int"))


def wrap_angle(radians: ColumnLike) -> Column:
    return F.pmod(col(radians) + math.pi, F.lit(2 * math.pi)) - math.pi


def blend_angle(a: ColumnLike, b: ColumnLike, t: ColumnLike) -> Column:
    """Interpolate along the shorter arc."""
    turn = 2 * math.pi
    d = (col(b) - col(a)) % turn
    d = F.when(d > math.pi, d - turn).when(d < -math.pi, d + turn).otherwise(d)
    return col(a) + d * col(t)


def heading_x(yaw: ColumnLike) -> Column:
    return F.sin(col(yaw))


def heading_z(yaw: ColumnLike) -> Column:
    return -F.cos(col(yaw))


def yaw_to_compass(yaw: ColumnLike) -> Column:
    return F.pmod(F.degrees(col(yaw)), F.lit(360.0))


def kmh(metres_per_second: ColumnLike) -> Column:
    return col(metres_per_second) * 3.6


# -- View rules ---------------------------------------------------------------

def detail_tier(tx, ty, camera_tx, camera_ty, altitude_m) -> Column:
    """0 near, 1 middle, 2 far, by Chebyshev tile distance; one coarser above 400 m."""
    d = F.greatest(F.abs(col(tx) - col(camera_tx)), F.abs(col(ty) - col(camera_ty)))
    tier = F.when(d <= 1, 0).when(d <= 3, 1).otherwise(2)
    return F.least(tier + F.when(col(altitude_m) > 400, 1).otherwise(0), F.lit(2))


def layer_visible(tier: ColumnLike, hide_at: ColumnLike) -> Column:
    return F.coalesce(col(tier) < col(hide_at), F.lit(True))


def pin_label_height(distance_m: ColumnLike, tier: ColumnLike) -> Column:
    return clamp(col(distance_m) * 0.042, 5.0, 175.0) * lookup(PIN_SCALE, col(tier), 1.0)


def pin_range(tier: ColumnLike) -> Column:
    """Visible range; an unknown tier has range 0."""
    return lookup(PIN_RANGE_M, col(tier), 0.0)


def pin_hover(tier: ColumnLike) -> Column:
    return lookup(PIN_HOVER_M, col(tier))
