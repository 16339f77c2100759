"""Colour rules. Palette entries are sRGB hex; arithmetic on them is in linear light."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._base import ColumnLike, clamp, col, half_even, num, whole
from .classify import lookup

# sRGB palettes.
ROOF_FAMILY = ("F5E4C3", "EEC99C", "E4A87A", "D08772", "E8CFA6", "DDB98F")
WALL_SHADE, WALL_BASE_SHADE = 0.88, 0.68
TERRAIN_STOPS = ((0.0, "D9CDA5"), (30.0, "A9B889"), (200.0, "93AA76"), (500.0, "B5A67B"))
ROAD_COLOUR = {
    "motorway": "D9B98C", "trunk": "DBBD91", "primary": "E2D5C2", "secondary": "E5D5BE",
    "tertiary": "E7DBC7", "minor": "E9E2D6", "service": "E5DDD0", "path": "CFC2A9",
    "track": "C9B896", "rail": "7C6E5A", "transit": "B8A889", "ferry": "8CA0AA",
}
ROAD_HALF_WIDTH_M = {
    "motorway": 8.0, "trunk": 6.0, "primary": 5.5, "secondary": 4.0, "tertiary": 3.5, "minor": 3.0,
    "service": 2.0, "path": 1.2, "track": 1.5, "rail": 1.0, "transit": 1.5, "ferry": 2.0,
}
LANE_HALF_WIDTH_M = {"motorway": 0.18, "trunk": 0.16, "primary": 0.14, "secondary": 0.12}
MAJOR_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "rail")
LANDUSE_COLOUR = {
    "residential": "B7B98A", "commercial": "C7C29F", "retail": "C9C6A5", "industrial": "9CA79A",
    "school": "AFB58C", "university": "AFB58C", "hospital": "B3B296", "cemetery": "96A57F",
}
LANDCOVER_COLOUR = {"wood": "6E9962", "grass": "A6C084", "sand": "E8D8A8", "wetland": "8FAE8A"}
PARK_COLOUR, WATER_COLOUR = "93B77A", "3E7C8A"
PAINT_ORDER = {"landuse": 0, "landcover": 1, "park": 2}
PAINT_COLOUR = {
    "sidewalk": "EFE1C6", "path": "D9C298", "plaza": "E7D4B0", "pier_deck": "B58F65",
    "sand": "E8D8A8", "parking": "D5C4A1", "court": "C97C56", "crosswalk": "F5E8C8",
}

# Grading constants.
FLOOR_RGB = (58, 53, 48)
GRADE_GAMMA, GRADE_RED, GRADE_RED_ADD, GRADE_BLUE, GRADE_SATURATION = 0.72, 1.06, 0.02, 0.94, 1.18
GRADE_LUMA = (0.30, 0.59, 0.11)
WASH_RED, WASH_RED_ADD, WASH_BLUE, WASH_SATURATION = 1.06, 5, 0.94, 1.15
WASH_LUMA = (0.299, 0.587, 0.114)
HASH_START, HASH_PRIME, MASK32 = 0x811C9DC5, 0x01000193, 0xFFFFFFFF


def _linear(hex6: str) -> tuple[float, float, float]:
    """sRGB hex to linear light, for literals."""
    out = []
    for i in (0, 2, 4):
        c = int(hex6[i:i + 2], 16) / 255.0
        out.append(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4)
    return tuple(out)


def _rgb(r, g, b) -> Column:
    return F.struct(num(r).alias("r"), num(g).alias("g"), num(b).alias("b"))


def linear_literal(hex6: str) -> Column:
    return _rgb(*_linear(hex6))


def hash32(*args: ColumnLike) -> Column:
    """32-bit hash of integers, two rounds per argument (the value, then the value times 1000)."""
    h = F.lit(HASH_START).cast("bigint")
    for a in args:
        a = num(a).cast("bigint")
        for part in (a, a * 1000):
            h = (h.bitwiseXOR(part.bitwiseAND(F.lit(MASK32))) * HASH_PRIME).bitwiseAND(F.lit(MASK32))
    return h


def building_colour(seed: ColumnLike) -> Column:
    """Linear rgb of a roof: family by seed mod 6, brightness jittered by 6 %."""
    seed = col(seed)
    family = F.array(*[linear_literal(h) for h in ROOF_FAMILY])
    base = F.get(family, (F.abs(seed) % len(ROOF_FAMILY)).cast("int"))
    jitter = 1 + (F.shiftrightunsigned(seed, 5).bitwiseAND(F.lit(255)) / 255.0 - 0.5) * 0.12
    return _rgb(base["r"] * jitter, base["g"] * jitter, base["b"] * jitter)


def shade(rgb: Column, factor: float) -> Column:
    return _rgb(rgb["r"] * factor, rgb["g"] * factor, rgb["b"] * factor)


def terrain_colour(height: ColumnLike) -> Column:
    """Linear rgb along the four-stop elevation ramp."""
    h = col(height)
    out = F.when(h <= TERRAIN_STOPS[0][0], linear_literal(TERRAIN_STOPS[0][1]))
    for (h0, c0), (h1, c1) in zip(TERRAIN_STOPS, TERRAIN_STOPS[1:]):
        t = (h - h0) / (h1 - h0)
        out = out.when(h < h1, _rgb(*[F.lit(a) + (F.lit(b) - F.lit(a)) * t
                                      for a, b in zip(_linear(c0), _linear(c1))]))
    return out.otherwise(linear_literal(TERRAIN_STOPS[-1][1]))


def road_colour(road_class: ColumnLike) -> Column:
    return lookup(ROAD_COLOUR, col(road_class))


def road_half_width(road_class: ColumnLike) -> Column:
    return lookup(ROAD_HALF_WIDTH_M, col(road_class))


def road_drawable(road_class: ColumnLike) -> Column:
    return F.coalesce(col(road_class).isin(*ROAD_HALF_WIDTH_M), F.lit(False))


def ground_colour(layer: ColumnLike, ground_class: ColumnLike) -> Column:
    """Hex colour of a landuse / landcover / park polygon, NULL when it is not painted."""
    layer, cls = col(layer), col(ground_class)
    return (F.when(layer == "landuse", lookup(LANDUSE_COLOUR, cls))
            .when(layer == "landcover", lookup(LANDCOVER_COLOUR, cls))
            .when(layer == "park", F.lit(PARK_COLOUR)))


def paint_order(layer: ColumnLike) -> Column:
    return lookup(PAINT_ORDER, col(layer))


def paint_colour(kind: ColumnLike) -> Column:
    return lookup(PAINT_COLOUR, col(kind), PAINT_COLOUR["sidewalk"])


def dream_grade(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    """Golden-hour grade of byte colours: gamma lift, warm shift, saturation, floor."""
    red, green, blue = (F.pow(col(v) / 255.0, F.lit(GRADE_GAMMA)) for v in (r, g, b))
    red = F.least(red * GRADE_RED + GRADE_RED_ADD, F.lit(1.0))
    blue = F.greatest(blue * GRADE_BLUE, F.lit(0.0))
    luma = red * GRADE_LUMA[0] + green * GRADE_LUMA[1] + blue * GRADE_LUMA[2]
    graded = [clamp(luma + (v - luma) * GRADE_SATURATION, 0.0, 1.0) for v in (red, green, blue)]
    return _rgb(*[F.greatest(whole(clamp(v * 255.0, 0.0, 255.0)), F.lit(f).cast("bigint"))
                  for v, f in zip(graded, FLOOR_RGB)])


def warm_shift(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    """Warm bias and saturation of a wash pixel, rounded to integers at each step."""
    red = F.least(half_even(col(r) * WASH_RED + WASH_RED_ADD), F.lit(255).cast("bigint"))
    green, blue = col(g).cast("bigint"), half_even(col(b) * WASH_BLUE)
    luma = red * WASH_LUMA[0] + green * WASH_LUMA[1] + blue * WASH_LUMA[2]
    return _rgb(*[clamp(half_even(luma + (v - luma) * WASH_SATURATION), F.lit(f).cast("bigint"), F.lit(255).cast("bigint"))
                  for v, f in zip((red, green, blue), FLOOR_RGB)])


def wash_multiplier(value: ColumnLike) -> Column:
    return col(value) / 255.0 * 0.8 + 0.6
