"""Spatial queries over solids: ray down, occupancy, swept spheres, sizes.

Prisms have `outer`, `holes`, `base`, `top`; decks are oriented boxes (see
`lines.oriented_box`) with `bottom`, `top`. Both are joined to probes through the shared
cell join, and each pair is decided by a closed-form expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tilescape.functions import rings
from tilescape.functions._base import ColumnLike, col, num
from tilescape.functions.classify import pin_hover

from . import cells, footprints

# Fixed values.
WATER_THRESHOLD = 0.4
UNDER_LOOK_UP, UNDER_MARGIN, UNDER_DROP = 700.0, 0.5, 500.0
PIN_FROM, PIN_DROP = 1500.0, 3000.0
SPAWN_ABOVE = 80.0
SKIN = 0.02
_BOX = ("_min_x", "_min_y", "_max_x", "_max_y")


def with_prism_box(prisms: DataFrame) -> DataFrame:
    return prisms.withColumn("_b", rings.ring_bounds("outer")).select(
        "*", *[F.col(f"_b.{n[1:]}").alias(n) for n in _BOX]).drop("_b")


def in_oriented_box(x: Column, y: Column) -> Column:
    """Is the point within the half length and half width of the deck segment?"""
    dx, dy = x - (F.col("ax") + F.col("bx")) / 2, y - (F.col("ay") + F.col("by")) / 2
    return ((F.abs(dx * F.col("tx_") + dy * F.col("ty_")) <= F.col("length") / 2)
            & (F.abs(dy * F.col("tx_") - dx * F.col("ty_")) <= F.col("half_width")))


def probes_on_decks(probes: DataFrame, decks: DataFrame, cell: float, on: Sequence[str], x="x", y="y") -> DataFrame:
    return cells.points_in_boxes(probes, decks, cell, x, y, ("min_x", "min_y", "max_x", "max_y"), on,
                                 exact=in_oriented_box(F.col(x), F.col(y)))


def ray_down(probes: DataFrame, probe_id: str, prisms: DataFrame, decks: DataFrame | None, terrain: DataFrame | None,
             cell: float, on: Sequence[str] = ("tx",), x="x", y="y", from_y="from_y", max_drop="max_drop",
             water: float = WATER_THRESHOLD) -> DataFrame:
    """Highest surface at or below each probe: (id, y, kind), probes without a hit left out.

    `terrain` holds (id, surface). Equal heights keep prism before deck before terrain.
    """
    reach = lambda top: (F.col(top) <= F.col(from_y)) & (F.col(from_y) - F.col(top) <= F.col(max_drop))
    hit = lambda df, top, rank: df.select(probe_id, F.struct(F.col(top).cast("double").alias("y"), F.lit(rank).alias("rank")).alias("_h"))
    slim = probes.select(probe_id, *on, x, y, from_y, max_drop)
    hits = hit(footprints.points_in_polygons(slim, prisms.select(*on, "outer", "holes", "top"), cell, on, x, y).filter(reach("top")), "top", 0)
    if decks is not None:
        hits = hits.unionByName(hit(probes_on_decks(slim, decks, cell, on, x, y).filter(reach("top")), "top", -1))
    if terrain is not None:
        ground = slim.join(terrain.select(probe_id, "surface"), probe_id)
        hits = hits.unionByName(hit(ground.filter((F.col("surface") > water) & reach("surface")), "surface", -2))
    return (hits.groupBy(probe_id).agg(F.max("_h").alias("_h"))
            .select(probe_id, F.col("_h.y").alias("y"), F.when(F.col("_h.rank") == -2, "terrain").otherwise("building").alias("kind")))


def occupied(probes: DataFrame, probe_id: str, prisms: DataFrame, decks: DataFrame | None, terrain: DataFrame | None,
             cell: float, on: Sequence[str] = ("tx",), x="x", y="y", y0="y0", y1="y1", water: float = WATER_THRESHOLD) -> DataFrame:
    """Ids of probes whose height interval (either order) meets something solid."""
    slim = probes.select(probe_id, *on, x, y, F.least(y0, y1).alias("_lo"), F.greatest(y0, y1).alias("_hi"))
    meets = lambda low, top: (F.col("_hi") >= F.col(low)) & (F.col("_lo") <= F.col(top))
    hits = footprints.points_in_polygons(slim, prisms.select(*on, "outer", "holes", "base", "top"), cell, on, x, y).filter(meets("base", "top")).select(probe_id)
    if decks is not None:
        hits = hits.unionByName(probes_on_decks(slim, decks, cell, on, x, y).filter(meets("bottom", "top")).select(probe_id))
    if terrain is not None:
        ground = slim.join(terrain.select(probe_id, "surface"), probe_id)
        hits = hits.unionByName(ground.filter((F.col("surface") > water) & (F.col("surface") >= F.col("_lo"))).select(probe_id))
    return hits.distinct()


def under_surface(points: DataFrame, above: DataFrame, below: DataFrame, point_id: str, y="y") -> DataFrame:
    """Points with a surface more than 0.5 m above and nothing below: ray results from above and from the point."""
    up = above.select(point_id, F.col("y").alias("_above"))
    return (points.join(up, point_id).filter(F.col("_above") > F.col(y) + UNDER_MARGIN)
            .join(below.select(point_id), point_id, "left_anti").withColumnRenamed("_above", "surface_above"))


def pin_heights(pins: DataFrame, hits: DataFrame, pin_id: str, tier="tier") -> DataFrame:
    """Hover height over the probed surface, or over sea level when nothing was hit."""
    return (pins.join(hits.select(pin_id, F.col("y").alias("_y")), pin_id, "left")
            .withColumn("float_y", F.coalesce("_y", F.lit(0.0)) + pin_hover(tier)).drop("_y"))


def spawn_altitude(points: DataFrame, hits: DataFrame, nearest: DataFrame, point_id: str) -> DataFrame:
    """Start height: probed surface, else the nearest elevation pixel, else 0, plus 80 m."""
    return (points.join(hits.select(point_id, F.col("y").alias("_hit")), point_id, "left")
            .join(nearest.select(point_id, F.col("elev").alias("_near")), point_id, "left")
            .withColumn("altitude", F.coalesce("_hit", "_near", F.lit(0.0)) + SPAWN_ABOVE).drop("_hit", "_near"))


# -- Swept spheres ------------------------------------------------------------

CONTACT = ("px", "py", "pz", "nx", "ny", "nz")


def _contact(t: Column, key: Column, rank, *place: Column) -> list[Column]:
    """Columns of a contact; of one solid's contacts the least (t, key, rank) is the first."""
    return [t.cast("double").alias("t"), key.cast("double").alias("key"), num(rank).cast("int").alias("rank"),
            *[v.cast("double").alias(n) for v, n in zip(place, CONTACT)]]


def _kept(df: DataFrame, test: Column) -> DataFrame:
    """Rows that pass, tested behind a generator: a plain filter is pushed down with every step before it inlined."""
    return df.withColumn("_kept", F.explode_outer(F.when(test, F.array(F.lit(True))))).filter(F.col("_kept").isNotNull()).drop("_kept")


def _apart(df: DataFrame, name: str) -> DataFrame:
    """`df`, whose next steps get a method of their own. Spark makes one method of a chain of projections, and HotSpot never
    compiles one of over 8,000 bytes; a lambda's result (here `name` itself) ends the chain."""
    return df.withColumn(name, F.get(F.transform(F.array(name), lambda v: v), F.lit(0)))


def with_sweep_edges(prisms: DataFrame) -> DataFrame:
    """Add the box and `edges`: all walls of a prism, laid out once, with their sign and order."""
    def walls(ring: Column, sign: float, first: Column) -> Column:
        return F.transform(rings.flat_edges(ring), lambda e, i: F.struct(
            e["x0"].alias("ax"), e["y0"].alias("az"), e["x1"].alias("bx"), e["y1"].alias("bz"),
            F.lit(sign).alias("sign"), (first + i).cast("int").alias("rank")))

    offset = F.size("outer")
    holes = F.transform("holes", lambda h, i: walls(h, -1.0, offset + i * 10000))
    return (with_prism_box(prisms).withColumn("edges", F.concat(walls(F.col("outer"), 1.0, F.lit(0)), F.flatten(holes)))
            .withColumns({"_outer_edges": rings.flat_edges("outer"), "_hole_edges": F.transform("holes", rings.flat_edges)}))


def _in_prism(x: Column, z: Column) -> Column:
    return rings.inside_edges(x, z, "_outer_edges") & ~F.exists("_hole_edges", lambda h: rings.inside_edges(x, z, h))


def prism_contacts(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Contacts per (sweep, prism) pair, see `_contact`: columns fx..r (motion), base, top, edges.

    Walls become rows, and each closed-form step is one generated projection. Starting
    inside gives t = 0 and the shortest way out (least key).
    """
    c = F.col
    zero, one = F.lit(0.0), F.lit(1.0)
    staged = pairs.withColumns({"dx": c("tx") - c("fx"), "dy": c("ty") - c("fy"), "dz": c("tz") - c("fz")})
    in_height = (c("fy") >= c("base") - c("r")) & (c("fy") <= c("top") + c("r"))
    t_top = F.when((c("fy") > c("top")) & (c("dy") < 0), (c("top") + c("r") - c("fy")) / F.nullif(c("dy"), zero))
    staged = staged.withColumns({"inside": F.when(in_height, _in_prism(c("fx"), c("fz"))).otherwise(False), "t_top": t_top})
    lands = F.when((c("t_top") > 0) & (c("t_top") < 1),
                   _in_prism(c("fx") + c("t_top") * c("dx"), c("fz") + c("t_top") * c("dz"))).otherwise(False)
    staged = staged.withColumn("lands", lands).drop("_outer_edges", "_hole_edges", "outer", "holes")

    # One row per wall plus one row (rank NULL) for the horizontal planes. Most walls give nothing and are
    # dropped as soon as that is known.
    nothing = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("ax", "double"), ("az", "double"), ("bx", "double"), ("bz", "double"),
                                                                   ("sign", "double"), ("rank", "int"))])
    e = staged.select(*keep, "fx", "fy", "fz", "dx", "dy", "dz", "r", "base", "top", "inside", "lands", "t_top",
                      F.explode_outer(F.concat(F.array(nothing), c("edges"))).alias("e"))
    e = e.select("*", "e.*").drop("e")
    e = e.withColumns({"ex": c("bx") - c("ax"), "ez": c("bz") - c("az")})
    e = e.withColumn("len2", c("ex") * c("ex") + c("ez") * c("ez"))
    e = e.withColumn("len2", F.when(c("len2") >= 1e-10, c("len2")))
    e = e.withColumn("len", F.sqrt("len2"))
    e = e.withColumns({"wx": -c("ez") / c("len") * c("sign"), "wz": c("ex") / c("len") * c("sign"),
                       "along0": ((c("fx") - c("ax")) * c("ex") + (c("fz") - c("az")) * c("ez")) / c("len2")})
    e = e.withColumns({"gap": (c("fx") - c("ax")) * c("wx") + (c("fz") - c("az")) * c("wz"), "speed": c("dx") * c("wx") + c("dz") * c("wz"),
                       "k": F.greatest(zero, F.least(one, c("along0")))})
    e = e.withColumn("t", F.when((c("speed") < 0) & (c("gap") >= c("r")), (c("r") - c("gap")) / F.nullif(c("speed"), zero)))
    near = (c("speed") < 0) & (c("gap") > 0) & (c("gap") < c("r"))
    plane_ok = (c("t") >= 0) & (c("t") < 1)
    e = _apart(_kept(e, F.when(c("rank").isNull(), c("inside") | c("lands")).when(c("len2").isNotNull(), c("inside") | near | plane_ok)), "k")

    # Ways out of the prism: up, down, or through the nearest point of a wall.
    up, down = F.greatest(zero, c("top") - c("fy")), F.greatest(zero, c("fy") - c("base"))
    e = e.withColumns({"vy": F.when(down < up, -1.0).otherwise(1.0), "vd": F.least(up, down),
                       "qx": c("ax") + c("k") * c("ex") - c("fx"), "qz": c("az") + c("k") * c("ez") - c("fz")})
    e = e.withColumn("d", F.hypot("qx", "qz"))
    e = e.withColumns({"nx": F.when(c("d") > 1e-6, c("qx") / F.nullif(c("d"), zero)).otherwise(c("wx")),
                       "nz": F.when(c("d") > 1e-6, c("qz") / F.nullif(c("d"), zero)).otherwise(c("wz")), "push": c("d") + c("r") + SKIN})

    # Wall planes, their end caps, and the band right at the wall.
    at = lambda axis, t: c(f"f{axis}") + c(t) * c(f"d{axis}")
    e = e.withColumns({"cx": at("x", "t"), "cy": at("y", "t"), "cz": at("z", "t")})
    e = e.withColumn("along", ((c("cx") - c("ax")) * c("ex") + (c("cz") - c("az")) * c("ez")) / c("len2"))
    end = lambda axis: F.when(c("along") < 0, c(f"a{axis}")).when(c("along") > 1, c(f"b{axis}"))
    e = e.withColumns({"lx": end("x"), "lz": end("z")})
    e = e.withColumns({"ox": c("fx") - c("lx"), "oz": c("fz") - c("lz"), "qa": c("dx") * c("dx") + c("dz") * c("dz")})
    e = e.withColumns({"qb": (c("ox") * c("dx") + c("oz") * c("dz")) * 2, "qc": c("ox") * c("ox") + c("oz") * c("oz") - c("r") * c("r")})
    e = e.withColumn("disc", c("qb") * c("qb") - c("qa") * c("qc") * 4)
    e = e.withColumn("tc", F.when((c("qa") >= 1e-10) & (c("disc") >= 0), (-c("qb") - F.sqrt(F.greatest(c("disc"), zero))) / (F.nullif(c("qa"), zero) * 2)))
    e = e.withColumns({"my": at("y", "tc"), "mx": at("x", "tc") - c("lx"), "mz": at("z", "tc") - c("lz")})
    e = e.withColumn("mag", F.coalesce(F.nullif(F.hypot("mx", "mz"), zero), one))
    level = lambda y: (c(y) + c("r") >= c("base")) & (c(y) - c("r") <= c("top"))
    cap_ok = (c("tc") >= 0) & (c("tc") < 1) & level("my")
    case = (F.when(c("rank").isNull(), F.when(c("inside"), "vertical").when(c("lands"), "landing"))
            .when(c("len2").isNull(), None)
            .when(c("inside"), "exit")
            .when(near, F.when(c("along0").between(0, 1) & level("fy"), "graze"))
            .when(plane_ok & c("lx").isNotNull(), F.when(cap_ok, "cap"))
            .when(plane_ok & level("cy"), "face"))
    e = _apart(_kept(e.withColumn("case", case), c("case").isNotNull()), "case")
    pick = lambda **by_case: _by_case(c("case"), by_case)
    time = pick(landing=c("t_top"), face=c("t"), cap=c("tc"), vertical=zero, exit=zero, graze=zero)
    key = pick(vertical=c("vd"), exit=c("d"), landing=c("t_top"), face=c("t"), cap=c("tc"), graze=zero)
    return e.select(*keep, *_contact(
        time, key, F.coalesce("rank", F.lit(-1)),
        pick(vertical=c("fx"), exit=c("fx") + c("nx") * c("push"), landing=at("x", "t_top"), face=c("cx") - c("wx") * c("r"), cap=c("lx"), graze=c("fx") - c("wx") * c("gap")),
        pick(vertical=c("fy") + (c("vd") + c("r") + SKIN) * c("vy"), exit=c("fy"), landing=c("top"), face=c("cy"), cap=c("my"), graze=c("fy")),
        pick(vertical=c("fz"), exit=c("fz") + c("nz") * c("push"), landing=at("z", "t_top"), face=c("cz") - c("wz") * c("r"), cap=c("lz"), graze=c("fz") - c("wz") * c("gap")),
        pick(vertical=zero, exit=c("nx"), landing=zero, face=c("wx"), cap=c("mx") / c("mag"), graze=c("wx")),
        pick(vertical=c("vy"), exit=zero, landing=one, face=zero, cap=zero, graze=zero),
        pick(vertical=zero, exit=c("nz"), landing=zero, face=c("wz"), cap=c("mz") / c("mag"), graze=c("wz"))))


def _by_case(case: Column, values: dict[str, Column]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(case == name, value) if out is None else out.when(case == name, value)
    return out


def deck_contacts(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """First contact per (sweep, deck) pair with an oriented box, by the slab method in deck axes; see `_contact`."""
    c = F.col
    zero = F.lit(0.0)
    d = pairs.withColumns({"mx": (c("ax") + c("bx")) / 2, "mz": (c("ay") + c("by")) / 2, "my": (c("top") + c("bottom")) / 2,
                           "dx": c("tx") - c("fx"), "dy": c("ty") - c("fy"), "dz": c("tz") - c("fz")})
    d = d.withColumns({"ou": (c("fx") - c("mx")) * c("tx_") + (c("fz") - c("mz")) * c("ty_"), "ov": (c("fz") - c("mz")) * c("tx_") - (c("fx") - c("mx")) * c("ty_"),
                       "ow": c("fy") - c("my"), "du": c("dx") * c("tx_") + c("dz") * c("ty_"), "dv": c("dz") * c("tx_") - c("dx") * c("ty_"), "dw": c("dy"),
                       "hu": c("length") / 2 + c("r"), "hv": c("half_width") + c("r"), "hw": (c("top") - c("bottom")) / 2 + c("r")})
    blocked = F.lit(False)
    for a in "uvw":
        still = F.abs(c(f"d{a}")) < 1e-9
        t1, t2 = (-c(f"h{a}") - c(f"o{a}")) / c(f"d{a}"), (c(f"h{a}") - c(f"o{a}")) / c(f"d{a}")
        d = d.withColumns({f"in_{a}": F.when(~still, F.least(t1, t2)), f"out_{a}": F.when(~still, F.greatest(t1, t2))})
        blocked = blocked | (still & (F.abs(c(f"o{a}")) > c(f"h{a}")))
    # The latest positive entry decides; on equal entries the earlier axis does.
    d = d.withColumns({"t": F.greatest(zero, "in_u", "in_v", "in_w"), "t_out": F.least(F.lit(1.0), "out_u", "out_v", "out_w"), "blocked": blocked})
    axis = F.when(c("t") == 0, F.lit("none")).when(c("in_u") == c("t"), "u").when(c("in_v") == c("t"), "v").otherwise("w")
    d = _apart(_kept(d, ~c("blocked") & (c("t") <= c("t_out")) & (c("t") < 1)), "t").withColumn("axis", axis)
    for a in "uvw":
        d = d.withColumn(f"n{a}", F.when(c("axis") == a, F.when(c(f"d{a}") > 0, -1.0).otherwise(1.0)).otherwise(0.0))
    for a in "uvw":
        d = d.withColumn(f"p{a}", c(f"o{a}") + c("t") * c(f"d{a}") - c(f"n{a}") * c("r"))
    return d.select(*keep, *_contact(c("t"), c("t"), 0, c("mx") + c("pu") * c("tx_") - c("pv") * c("ty_"), c("my") + c("pw"), c("mz") + c("pu") * c("ty_") + c("pv") * c("tx_"),
                                     c("nu") * c("tx_") - c("nv") * c("ty_"), c("nw"), c("nu") * c("ty_") + c("nv") * c("tx_")))


#: A deck is grown by the radius along its own axes, so its corners reach out by the radius times the root of 2.
_GROWN = 1.4143


def _entry(axes: Sequence[tuple[str, str, str, str]]) -> Column:
    """Where the centre's path enters the grown box, from 0 to 1; null if it passes by. Every contact needs an entry, so no hit is lost."""
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    slack = F.col("r") * _GROWN + 1e-6
    for start, stop, low, high in axes:
        f, d = F.col(start), F.nullif(F.col(stop) - F.col(start), F.lit(0.0))
        low, high = F.col(low) - slack, F.col(high) + slack
        t1, t2 = (low - f) / d, (high - f) / d
        still = f.between(low, high)
        enter.append(F.coalesce(F.least(t1, t2), F.when(still, 0.0).otherwise(2.0)))
        leave.append(F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
    return F.when(F.greatest(*enter) <= F.least(*leave), F.greatest(*enter))


def sweep_spheres(sweeps: DataFrame, sweep_id: str, prisms: DataFrame, decks: DataFrame | None, cell: float,
                  on: Sequence[str] = ("tile",), prism_id="fid", deck_id="deck_id") -> DataFrame:
    """First contact per sweep over all prisms and decks, sweeps without one left out.

    `sweeps` has fx, fy, fz -> tx, ty, tz and radius r (y is height). A sweep visits the cells
    along its path and meets the solids in them; a pair that shares several cells is evaluated
    only in that of the box's point next to where the path enters the grown box.
    """
    motion = ("fx", "fy", "fz", "tx", "ty", "tz", "r")
    low, high = (lambda a: F.least(f"f{a}", f"t{a}") - F.col("r")), (lambda a: F.greatest(f"f{a}", f"t{a}") + F.col("r"))
    moved = sweeps.select(sweep_id, *on, *[F.col(m).cast("double").alias(m) for m in motion])
    left = cells.with_path_cells(moved, ("fx", "fz"), ("tx", "tz"), cell, F.col("r") * _GROWN)

    def pairs(solids: DataFrame, base: str) -> DataFrame:
        right = cells.with_box_cells(solids, "_min_x", "_min_y", "_max_x", "_max_y", cell)
        meets = ((high("x") >= F.col("_min_x")) & (low("x") <= F.col("_max_x")) & (high("z") >= F.col("_min_y"))
                 & (low("z") <= F.col("_max_y")) & (high("y") >= F.col(base)) & (low("y") <= F.col("top")))
        entry = _entry([("fx", "tx", "_min_x", "_max_x"), ("fz", "tz", "_min_y", "_max_y"), ("fy", "ty", base, "top")])
        within = lambda f, t, least, most: F.greatest(F.col(least), F.least(F.col(most), F.col(f) + (F.col(t) - F.col(f)) * F.col("_entry")))
        once = ((F.col(cells.CELL_X) == cells.cell(within("fx", "tx", "_min_x", "_max_x"), cell))
                & (F.col(cells.CELL_Y) == cells.cell(within("fz", "tz", "_min_y", "_max_y"), cell)))
        met = _apart(left.join(right, [*on, cells.CELL_X, cells.CELL_Y]).filter(meets), "r").withColumn("_entry", entry)
        return _kept(met, once).drop("_entry", cells.CELL_X, cells.CELL_Y)

    ranked = lambda df, rank, ident: df.select(sweep_id, F.struct(
        "t", F.lit(rank).alias("kind_rank"), F.col(ident).alias("solid"), "key", "rank", *CONTACT).alias("_h"))
    number = lambda c: F.col(c).cast("double").alias(c)
    solid = with_sweep_edges(prisms).select(*on, prism_id, number("base"), number("top"), "edges", "_outer_edges", "_hole_edges", *_BOX)
    hits = ranked(prism_contacts(pairs(solid, "base"), [sweep_id, prism_id]), 0, prism_id)
    if decks is not None:
        boxes = decks.withColumnsRenamed({n[1:]: n for n in _BOX})
        hits = hits.unionByName(ranked(deck_contacts(pairs(boxes, "bottom"), [sweep_id, deck_id]), 1, deck_id))
    best = hits.groupBy(sweep_id).agg(F.min("_h").alias("_h")).filter(F.col("_h.t") < 1)
    return best.select(sweep_id, "_h.t", F.when(F.col("_h.kind_rank") == 0, "prism").otherwise("deck").alias("kind"), "_h.solid",
                       *[f"_h.{n}" for n in CONTACT])


# -- Reports ------------------------------------------------------------------

def payload_size(prisms: DataFrame, decks: DataFrame, tile: Sequence[str], prism_cells: DataFrame, deck_cells: DataFrame, grid: int = 16) -> DataFrame:
    """Bytes per tile: 8 per ring vertex, 96 per deck box, 4 per cell entry and offset."""
    holes = F.aggregate(F.transform("holes", F.size), F.lit(0), lambda a, b: a + b)
    fixed = 2 * 4 * (grid * grid + 1)
    parts = [prisms.select(*tile, ((F.size("outer") + holes) * 8).alias("_n")), decks.select(*tile, F.lit(96).alias("_n")),
             prism_cells.select(*tile, F.lit(4).alias("_n")), deck_cells.select(*tile, F.lit(4).alias("_n"))]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    return all_parts.groupBy(*tile).agg((F.sum("_n") + fixed).alias("bytes"))


def roof_coverage(buildings: DataFrame, hits_of, keep: Sequence[str], steps: int = 6) -> DataFrame:
    """Hit rate of a (steps + 1)^2 probe grid over each group's bounding box.

    `hits_of` maps probes (probe_id, keep..., x, y) to the probe ids that hit.
    """
    b = buildings.withColumn("_b", rings.ring_bounds("outer"))
    box = b.groupBy(*keep).agg(F.min("_b.min_x").alias("x0"), F.max("_b.max_x").alias("x1"), F.min("_b.min_y").alias("y0"),
                               F.max("_b.max_y").alias("y1"), F.max("top").alias("top"))
    span = lambda: F.explode(F.sequence(F.lit(0), F.lit(steps)))
    probes = (box.withColumn("_i", span()).withColumn("_j", span())
              .withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_i") / steps,
                            "y": F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("_j") / steps})
              .withColumn("probe_id", F.struct(*keep, "_i", "_j")))
    hit = hits_of(probes).select("probe_id").withColumn("_hit", F.lit(1))
    return (probes.join(hit, "probe_id", "left").groupBy(*keep)
            .agg(F.count("*").alias("probes"), F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"))
            .withColumn("rate", F.col("hits") / F.col("probes")))
