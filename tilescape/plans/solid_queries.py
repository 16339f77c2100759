"""Queries over footprints and solids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import rings
from tilescape.operators import cells, collision, footprints, graph, lines, qa, raster, trees
from tilescape.session import cut

from .fixtures import fixture, parts_for, rectangle, spark_table
from .raster_queries import CANOPY, N, RULES as TREE_RULES, bilinear_sql, canopy, pixels
from .registry import query

CM = footprints.RoofRules(min_area=250000, pad=50, min_points=20, above_ground=200, min_structure=10, min_eave=200,
                          max_rise=1200, flat_rise=100)


def rings_cm(spark, sf, name="fx_footprints"):
    f = fixture(spark, sf, name)
    return f.withColumn("ring", rectangle("x0_cm", "y0_cm", "w_cm", "h_cm"))


def hits(spark, sf, pad=50.0, dealt=True):
    pts = raster.drop_noise(fixture(spark, sf, "fx_points", dealt=dealt))
    return footprints.points_in_rings(pts, rings_cm(spark, sf).select("tx", "fid", "ring", "x0_cm", "y0_cm"), 800, pad, ("tx",), "x_cm", "y_cm")


HITS = """p as (select * from {fx_points} where cls not in (7, 18)),
    j as (select f.fid, f.tx, f.x0_cm, f.y0_cm, p.x_cm, p.y_cm, p.z_cm from p join {fx_footprints} f on f.tx = p.tx
          and p.x_cm between x0_cm - 50 and x0_cm + w_cm + 50 and p.y_cm between y0_cm - 50 and y0_cm + h_cm + 50
          where greatest(x0_cm - p.x_cm, 0, p.x_cm - x0_cm - w_cm) ** 2 + greatest(y0_cm - p.y_cm, 0, p.y_cm - y0_cm - h_cm) ** 2 <= 2500)"""


@query("fl8_footprint_candidates", "select fid from {fx_footprints} where w_cm * h_cm >= 250000")
def fl8(spark, sf):
    return footprints.candidates(rings_cm(spark, sf), rules=CM).select("fid")


@query("jn3_points_in_footprints", f"with {HITS} select fid, count(*) as n, sum(z_cm)::bigint as z, min(x_cm) as x from j group by 1")
def jn3(spark, sf):
    return hits(spark, sf).groupBy("fid").agg(F.count("*").alias("n"), F.sum("z_cm").alias("z"), F.min("x_cm").alias("x"))


def prisms(spark, sf):
    """Footprints as solids with a 1 m square hole, all in centimetres."""
    f = rings_cm(spark, sf, "fx_prisms")
    x, y = F.col("x0_cm"), F.col("y0_cm")
    hole = rings.ring_of((x + 100, y + 100), (x + 100, y + 200), (x + 200, y + 200), (x + 200, y + 100))
    return f.select("fid", "tx", F.col("ring").alias("outer"), F.array(hole).alias("holes"), F.col("base_cm").alias("base"), F.col("top_cm").alias("top"))


def rays(spark, sf):
    return fixture(spark, sf, "fx_rays").select("ray_id", "tx", (F.col("x_cm") + 0.37).alias("x"), (F.col("y_cm") + 0.37).alias("y"),
                                                F.col("from_cm").alias("from_y"), F.col("drop_cm").alias("max_drop"), "ground_cm")


# Half-open rectangle membership is what the even-odd rule gives for points on a border.
INSIDE = """r.tx = s.tx and r.x_cm >= s.x0_cm and r.x_cm < s.x0_cm + s.w_cm and r.y_cm >= s.y0_cm and r.y_cm < s.y0_cm + s.h_cm
    and not (r.x_cm >= s.x0_cm + 100 and r.x_cm < s.x0_cm + 200 and r.y_cm >= s.y0_cm + 100 and r.y_cm < s.y0_cm + 200)"""


@query("jn4_probes_in_prisms", f"""
    select ray_id, count(*) as n, min(fid) as first_fid from {{fx_rays}} r join {{fx_prisms}} s on {INSIDE} group by 1""")
def jn4(spark, sf):
    out = footprints.points_in_polygons(rays(spark, sf), prisms(spark, sf), 800)
    return out.groupBy("ray_id").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"))


PROFILE = """g as (select fid, quantile_cont(z_cm, 0.05) as ground, count(*) as n from j group by 1 having count(*) >= 20),
    b as (select j.*, ground from j join g using (fid) where z_cm > ground + 200),
    e as (select fid, ground, count(*) as structure, quantile_cont(z_cm, 0.15) as eave, quantile_cont(z_cm, 0.95) as p95, quantile_cont(z_cm, 0.90) as p90,
          from b group by 1, 2 having count(*) >= 10),
    k as (select e.*, case when (select count(*) from b where b.fid = e.fid and z_cm >= p95) >= 5 then p95 else p90 end as cutoff from e),
    t as (select b.fid, k.ground, eave, structure, x_cm - x0_cm as dx, y_cm - y0_cm as dy, z_cm from b join k using (fid) where z_cm >= cutoff),
    m as (select fid, ground, eave, structure, quantile_cont(z_cm, 0.5) as ridge, count(*) as top, sum(dx)::double as sx, sum(dy)::double as sy,
                 sum(dx * dx)::double as sxx, sum(dy * dy)::double as syy, sum(dx * dy)::double as sxy from t group by 1, 2, 3, 4)"""


def profiles(spark, sf):
    """Footprints that may meet very many points are told by the cells' counts; their heights are refined over all tasks."""
    keys, near = ["fid", "tx"], hits(spark, sf, dealt=False)
    args = (keys, CM)
    crowded = cut(footprints.crowded(raster.drop_noise(fixture(spark, sf, "fx_points", dealt=False)), rings_cm(spark, sf), keys, 800, 50.0, ("tx",), "x_cm", "y_cm"))
    whole = lambda df: footprints.roof_profiles_whole(df, *args, parts_for(spark_table(spark, sf, "lineitem"), 300_000), "x_cm", "y_cm", "z_cm", "x0_cm", "y0_cm")
    if crowded.isEmpty():
        return whole(near)
    hist = footprints.height_histogram(near.join(crowded, keys, "left_semi"), keys, "x_cm", "y_cm", "z_cm", "x0_cm", "y0_cm")
    return whole(near.join(crowded, keys, "left_anti")).unionByName(footprints.roof_profiles(hist, *args))


@query("ag7_roof_profile", f"""
    with {HITS}, {PROFILE} select fid, round(ground, 4) as ground, round(eave, 4) as eave, round(ridge, 4) as ridge, structure, top from m""")
def ag7(spark, sf):
    return profiles(spark, sf).select("fid", *[F.round(c, 4).alias(c) for c in ("ground", "eave", "ridge")], "structure", "top")


SHAPES = """a as (select m.*, fid % 100 as z, (top * sxx - sx * sx) / (top * (top - 1)) as va, (top * syy - sy * sy) / (top * (top - 1)) as vc,
           (top * sxy - sx * sy) / (top * (top - 1)) as vb, f.tx, least(w_cm, h_cm)::double as side from m join {fx_footprints} f using (fid) where eave - ground >= 200),
    x as (select *, (va + vc) / 2 + sqrt((va - vc) ** 2 / 4 + vb * vb) as lv, (va + vc) / 2 - sqrt((va - vc) ** 2 / 4 + vb * vb) as sv, greatest(ridge - eave, 0) as rise0 from a),
    s as (select *, case when rise0 < 100 or rise0 / side < 0.06e0 then 0 when top >= 5 and sv > 0 and lv >= sv * 4.84e0 and sqrt(sv) * 2 <= side * 0.4e0 then 1 else 2 end as shape from x)"""


def shapes(spark, sf):
    p = profiles(spark, sf).join(fixture(spark, sf, "fx_footprints").select("fid", F.least("w_cm", "h_cm").cast("double").alias("side")), "fid")
    return footprints.roof_shapes(p, "side", 1.0, CM)


@query("ag8_roof_gates", f"""
    with {HITS}, {PROFILE}, {SHAPES} select fid, shape, round(eave - ground, 4) as eave_h, round(case when shape = 0 then 0 else least(rise0, side * 0.5e0, 1200) end, 4) as rise from s""")
def ag8(spark, sf):
    return shapes(spark, sf).select("fid", "shape", F.round("eave_h", 4).alias("eave_h"), F.round("rise", 4).alias("rise"))


@query("ag9_ridge_axis", f"""
    with {HITS}, {PROFILE}, {SHAPES}, z as (select fid, shape, degrees(atan2(cos(atan2(2 * vb, va - vc) / 2), sin(atan2(2 * vb, va - vc) / 2))) as d from s)
    select fid, round(case when shape = 1 then fmod(d + 360, 180) else 0 end, 3) as ridge_deg from z""")
def ag9(spark, sf):
    return shapes(spark, sf).select("fid", F.round("ridge_deg", 3).alias("ridge_deg"))


@query("ag10_shape_counts", f"""
    with {HITS}, {PROFILE}, {SHAPES} select tx, count(*) filter (shape = 0) as flat, count(*) filter (shape = 1) as gable, count(*) filter (shape = 2) as hip, count(*) as n
    from s group by grouping sets ((tx), ())""")
def ag10(spark, sf):
    return footprints.shape_counts(shapes(spark, sf))


MATCH = """with recursive pairs as (select f.fid, r.rec_id, (f.x0_cm + w_cm // 2 - r.x_cm) ** 2 + (f.y0_cm + h_cm // 2 - r.y_cm) ** 2 as d2
        from {fx_footprints} f join {fx_records} r on r.tx = f.tx
        and (f.x0_cm + w_cm // 2 - r.x_cm) ** 2 + (f.y0_cm + h_cm // 2 - r.y_cm) ** 2 < 360000)"""


def centres(spark, sf):
    return fixture(spark, sf, "fx_footprints").select("tx", "fid", F.expr("x0_cm + w_cm div 2").alias("x"), F.expr("y0_cm + h_cm div 2").alias("y"))


def matched(spark, sf):
    rec = fixture(spark, sf, "fx_records").select("tx", "rec_id", F.col("x_cm").alias("x"), F.col("y_cm").alias("y"))
    return footprints.match_records(centres(spark, sf), rec, "fid", "rec_id", 600, 1000)


# Footprints of a tile choose one after the other; `taken` holds the records that are gone.
@query("jn10_one_to_one_match", f"""
    {MATCH}, c as (select fid, fid // 500 as tile, list(struct_pack(d2 := cast(d2 as bigint), rec := rec_id) order by d2, rec_id) as cs from pairs group by 1),
         o as (select *, row_number() over (partition by tile order by fid) as k from c),
         g as (select distinct tile, cast(0 as bigint) as k, cast([] as bigint[]) as taken, cast(null as bigint) as fid, cast(null as bigint) as rec_id, cast(null as bigint) as d2 from o
               union all select tile, k, case when p is null then taken else list_append(taken, p.rec) end, fid, p.rec, p.d2
               from (select o.tile, o.k, g.taken, o.fid, list_filter(o.cs, lambda x: not list_contains(g.taken, x.rec))[1] as p from g join o on o.tile = g.tile and o.k = g.k + 1) q)
    select fid, rec_id, d2 from g where rec_id is not null""")
def jn10(spark, sf):
    return matched(spark, sf).select("fid", "rec_id", F.col("d2").cast("bigint").alias("d2"))


@query("jn10_candidate_pairs", f"{MATCH} select fid, rec_id, cast(d2 as bigint) as d2 from pairs")
def jn10_pairs(spark, sf):
    rec = fixture(spark, sf, "fx_records").select("tx", "rec_id", F.col("x_cm").alias("x"), F.col("y_cm").alias("y"))
    return footprints.record_pairs(centres(spark, sf), rec, "fid", "rec_id", 600, 1000).select("fid", "rec_id", F.col("d2").cast("bigint").alias("d2"))


@query("jn11_roof_attach", """
    with b as (select f.fid, (f.fid % 60)::double as h, w_cm * h_cm / 1e4 as area, r.eave_dm / 10e0 as eave from {fx_footprints} f left join {fx_records} r on r.rec_id = f.fid + 3),
         s as (select *, case when h > 400 then 5 when h > 150 and area < 100 then 5 when h > 50 and area > 25000 then least(h, 20) else h end as safe from b)
    select fid, case when eave >= 2 and eave >= 0.4e0 * safe then eave else safe end as height from s""")
def jn11(spark, sf):
    rec = fixture(spark, sf, "fx_records").select((F.col("rec_id") - 3).alias("fid"), (F.col("eave_dm") / 10.0).alias("eave_m"))
    b = fixture(spark, sf, "fx_footprints").select("fid", (F.col("fid") % 60).cast("double").alias("height"), (F.expr("w_cm * h_cm") / 1e4).alias("area_m2"))
    return footprints.attach_eaves(b.join(rec, "fid", "left")).select("fid", "height")


PROBES = """pr as (select fid, 0 as probe, x0_cm + w_cm / 2e0 as x, y0_cm + h_cm / 2e0 as y from {fx_footprints}
    union all select fid, 1, x0_cm, y0_cm from {fx_footprints} union all select fid, 2, x0_cm + w_cm, y0_cm from {fx_footprints}
    union all select fid, 3, x0_cm, y0_cm + h_cm from {fx_footprints} union all select fid, 4, x0_cm + w_cm, y0_cm + h_cm from {fx_footprints}),
    pf as (select fid, probe, (x + 7.3217e0) / 6400e0 + fid % 8 as fx, (y + 3.9171e0) / 6400e0 + fid // 700 as fy from pr)"""


def levels(spark, sf):
    probes = footprints.ground_probes(rings_cm(spark, sf), ["fid"])
    out = raster.sample_bilinear(probes, pixels(spark, sf), (F.col("x") + 7.3217) / 6400 + F.col("fid") % 8, (F.col("y") + 3.9171) / 6400 + F.expr("fid div 700"), N, keep=["fid", "probe"])
    return footprints.ground_levels(out.withColumn("elev", F.col("elev") / 10 - 20), ["fid"])


LEVELS = f"{PROBES}, lv as (select fid, min(elev / 10 - 20) as lowest, max(case when probe = 0 then elev / 10 - 20 end) as centre from ({bilinear_sql('pf', 'fid, probe')}) s group by 1)"


@query("jn12_base_and_top", f"with {LEVELS} select fid, round(lowest - 3 + fid % 3, 3) as base_y, round(centre + fid % 30, 3) as top_y from lv where centre > 0.4e0")
def jn12(spark, sf):
    out = footprints.base_and_top(levels(spark, sf), F.col("fid") % 30, F.col("fid") % 3)
    return out.select("fid", F.round("base_y", 3).alias("base_y"), F.round("top_y", 3).alias("top_y"))


@query("fl6_dry_polygons", f"with {LEVELS} select fid from lv where lowest > 0.6e0")
def fl6(spark, sf):
    return footprints.dry_polygons(levels(spark, sf)).select("fid")


MASK = """inring as (select distinct f.tx, cx, cy from {fx_footprints} f, (select unnest(generate_series(0, 63)) as cx) a, (select unnest(generate_series(0, 63)) as cy) b
        where cx * 100 + 50 >= x0_cm and cx * 100 + 50 < x0_cm + w_cm and (63 - cy) * 100 + 50 >= y0_cm and (63 - cy) * 100 + 50 < y0_cm + h_cm),
    mask as (select distinct tx, cx + dx as cx, cy + dy as cy from inring, (select unnest(generate_series(-2, 2)) as dx) a, (select unnest(generate_series(-2, 2)) as dy) b
        where abs(dx) + abs(dy) <= 2 and cx + dx between 0 and 63 and cy + dy between 0 and 63)"""


@query("jn16_building_mask", f"""
    with {CANOPY}, {MASK} select h.tx, h.cx, h.cy, h.chm from h left join mask m on m.tx = h.tx and m.cx = h.cx and m.cy = h.cy where m.tx is null""")
def jn16(spark, sf):
    inside = footprints.cells_in_rings(rings_cm(spark, sf), ["tx"], N, N, 100)
    return canopy(spark, sf).join(trees.building_mask(inside, 2, N, N), ["tx", "cx", "cy"], "left_anti")


# -- Solids -------------------------------------------------------------------

def decks_cm(spark, sf):
    """One 40 m diagonal deck per crossing of a coarse lattice, in centimetres."""
    f = fixture(spark, sf, "fx_footprints")
    ax, ay, bx, by = F.col("x0_cm"), F.col("y0_cm"), F.col("x0_cm") + F.col("w_cm") * 2, F.col("y0_cm") + F.col("h_cm")
    d = lambda c: c.cast("double")
    return f.select("tx", F.col("fid").alias("deck_id"), *lines.oriented_box(d(ax), d(ay), d(bx), d(by), 150.0),
                    (F.col("fid") * 53 % 3000 + 300).alias("top"), (F.col("fid") * 53 % 3000 + 150).alias("bottom"))


DECKS = """dk as (select tx, fid as deck_id, x0_cm + w_cm as mx, y0_cm + h_cm / 2e0 as my, w_cm * 2 as dx, h_cm as dy, sqrt((w_cm * 2) ** 2 + h_cm ** 2) as len,
        fid * 53 % 3000 + 300 as top, fid * 53 % 3000 + 150 as bottom from {fx_footprints})"""
ON_DECK = """r.tx = s.tx and abs((r.x_cm + 0.37e0 - s.mx) * s.dx + (r.y_cm + 0.37e0 - s.my) * s.dy) <= s.len * s.len / 2
    and abs((r.y_cm + 0.37e0 - s.my) * s.dx - (r.x_cm + 0.37e0 - s.mx) * s.dy) <= 150 * s.len"""


@query("jn21_deck_containment", f"with {DECKS} select ray_id, count(*) as n, min(deck_id) as first_deck from {{fx_rays}} r join dk s on {ON_DECK} group by 1")
def jn21(spark, sf):
    return (collision.probes_on_decks(rays(spark, sf), decks_cm(spark, sf), 800, ["tx"]).groupBy("ray_id")
            .agg(F.count("*").alias("n"), F.min("deck_id").alias("first_deck")))


HITS_DOWN = f"""{DECKS}, hit as (
    select ray_id, top_cm as y, 0 as rank from {{fx_rays}} r join {{fx_prisms}} s on {INSIDE} where top_cm <= from_cm and from_cm - top_cm <= drop_cm
    union all select ray_id, s.top, -1 from {{fx_rays}} r join dk s on {ON_DECK} where s.top <= from_cm and from_cm - s.top <= drop_cm
    union all select ray_id, ground_cm, -2 from {{fx_rays}} r where ground_cm > 40 and ground_cm <= from_cm and from_cm - ground_cm <= drop_cm),
    down as (select ray_id, max(row(y, rank)) as b from hit group by 1)"""


def down(spark, sf, probes=None):
    r = rays(spark, sf) if probes is None else probes
    terrain = r.select("ray_id", F.col("ground_cm").alias("surface"))
    return collision.ray_down(r, "ray_id", prisms(spark, sf), decks_cm(spark, sf), terrain, 800, water=40)


@query("jn19_ray_down", f"with {HITS_DOWN} select ray_id, cast(b[1] as bigint) as y, case when b[2] = -2 then 'terrain' else 'building' end as kind from down")
def jn19(spark, sf):
    return down(spark, sf).withColumn("y", F.col("y").cast("bigint"))


@query("jn20_occupied", f"""
    with {DECKS}, q as (select *, least(from_cm, drop_cm) as lo, greatest(from_cm, drop_cm) as hi from {{fx_rays}})
    select ray_id from q r join {{fx_prisms}} s on {INSIDE} where hi >= base_cm and lo <= top_cm
    union select ray_id from q r join dk s on {ON_DECK} where hi >= s.bottom and lo <= s.top
    union select ray_id from q where ground_cm > 40 and ground_cm >= lo""")
def jn20(spark, sf):
    r = rays(spark, sf)
    terrain = r.select("ray_id", F.col("ground_cm").alias("surface"))
    return collision.occupied(r, "ray_id", prisms(spark, sf), decks_cm(spark, sf), terrain, 800, y0="from_y", y1="max_drop", water=40)


def sweeps(spark, sf):
    r = fixture(spark, sf, "fx_rays").withColumnRenamed("tx", "tile")
    c = lambda e, name: F.expr(e).cast("double").alias(name)
    return r.select("ray_id", "tile", c("x_cm", "fx"), c("from_cm", "fy"), c("y_cm", "fz"),
                    c("x_cm + (ray_id * 31) % 1200 - 600", "tx"), c("from_cm - drop_cm div 4", "ty"), c("y_cm + (ray_id * 17) % 1200 - 600", "tz"),
                    F.lit(40.0).alias("r"))


# Many-cased geometry: tested against a brute-force solver on a small fixture instead of SQL.
@query("jn22_swept_sphere")
def jn22(spark, sf):
    tiled = lambda df: df.withColumnRenamed("tx", "tile")
    out = collision.sweep_spheres(sweeps(spark, sf), "ray_id", tiled(prisms(spark, sf)), tiled(decks_cm(spark, sf)), 800)
    return out.select("ray_id", F.round("t", 6).alias("t"), "kind", "solid", *[F.round(c, 4).alias(c) for c in ("px", "py", "pz", "nx", "ny", "nz")])


@query("jn23_cell_index", """
    select tx, c as grid_col, r as grid_row, count(*) as n, min(fid) as first_fid from {fx_footprints},
        (select unnest(generate_series(0, 15)) as c) a, (select unnest(generate_series(0, 15)) as r) b
    where c between least(15, x0_cm // 400) and least(15, (x0_cm + w_cm) // 400) and r between least(15, y0_cm // 400) and least(15, (y0_cm + h_cm) // 400) group by 1, 2, 3""")
def jn23(spark, sf):
    boxed = collision.with_prism_box(prisms(spark, sf))
    out = cells.tile_grid_cells(boxed, "_min_x", "_min_y", "_max_x", "_max_y", (0, 0), (6400, 6400))
    return out.groupBy("tx", "grid_col", "grid_row").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"))


@query("jn26_under_surface", f"""
    with up as (select ray_id, max(top_cm) as y from {{fx_rays}} r join {{fx_prisms}} s on {INSIDE} where top_cm <= from_cm + 700 group by 1),
         lo as (select distinct ray_id from {{fx_rays}} r join {{fx_prisms}} s on {INSIDE} where top_cm <= from_cm and from_cm - top_cm <= 500)
    select r.ray_id, cast(up.y as bigint) as surface_above from {{fx_rays}} r join up using (ray_id)
    where up.y > r.from_cm + 0.5e0 and r.ray_id not in (select ray_id from lo)""")
def jn26(spark, sf):
    r, p = rays(spark, sf), prisms(spark, sf)
    above = collision.ray_down(r.withColumns({"from_y": F.col("from_y") + 700, "max_drop": F.lit(699)}), "ray_id", p, None, None, 800)
    below = collision.ray_down(r.withColumn("max_drop", F.lit(500)), "ray_id", p, None, None, 800)
    out = collision.under_surface(r.withColumn("py", F.col("from_y").cast("double")), above, below, "ray_id", y="py")
    return out.select("ray_id", F.col("surface_above").cast("bigint").alias("surface_above"))


@query("jn27_pin_heights", f"""
    with p as (select pin_id as ray_id, 2616 + pin_id // 25 as tx, x_m * 4 // 5 as x_cm, z_m * 4 // 5 as y_cm, tier from {{fx_pins}}),
         h as (select ray_id, max(top_cm) as y from p r join {{fx_prisms}} s on {INSIDE} where top_cm <= 1500 and 1500 - top_cm <= 3000 group by 1)
    select ray_id as pin_id, cast(coalesce(y, 0) + case tier when 1 then 90 when 2 then 34 else 16 end as bigint) as float_y from p left join h using (ray_id)""")
def jn27(spark, sf):
    pins = fixture(spark, sf, "fx_pins").select("pin_id", "tier", F.expr("2616 + pin_id div 25").alias("tx"), F.expr("x_m * 4 div 5").alias("x"), F.expr("z_m * 4 div 5").alias("y"),
                                                F.lit(collision.PIN_FROM).alias("from_y"), F.lit(collision.PIN_DROP).alias("max_drop"))
    found = collision.ray_down(pins, "pin_id", prisms(spark, sf), None, None, 800)
    return collision.pin_heights(pins, found, "pin_id").select("pin_id", F.col("float_y").cast("bigint").alias("float_y"))


@query("jn28_spawn_altitude", f"""
    with {HITS_DOWN}, n as (select ray_id, elev_dm from {{fx_rays}} r left join {{fx_pixels}} p on p.tx = ray_id % 8 and p.ty = ray_id // 4000 and p.px = x_cm // 100 and p.py = y_cm // 100)
    select r.ray_id, cast(coalesce(b[1], n.elev_dm, 0) + 80 as bigint) as altitude from {{fx_rays}} r left join down using (ray_id) left join n using (ray_id)""")
def jn28(spark, sf):
    r = rays(spark, sf)
    near = raster.sample_nearest(r, pixels(spark, sf), F.col("ray_id") % 8 + F.floor("x") / 6400, F.expr("ray_id div 4000") + F.floor("y") / 6400, N, ["value"]).select("ray_id", F.col("value").alias("elev"))
    return collision.spawn_altitude(r, down(spark, sf), near, "ray_id").select("ray_id", F.col("altitude").cast("bigint").alias("altitude"))


@query("ag20_payload_size", """
    select tx, cast(sum(64 + 96 + 4 * ((least(15, (x0_cm + w_cm) // 400) - least(15, x0_cm // 400) + 1) * (least(15, (y0_cm + h_cm) // 400) - least(15, y0_cm // 400) + 1))) + 2056 as bigint) as bytes
    from {fx_footprints} group by tx""")
def ag20(spark, sf):
    boxed = collision.with_prism_box(prisms(spark, sf))
    grid = cells.tile_grid_cells(boxed, "_min_x", "_min_y", "_max_x", "_max_y", (0, 0), (6400, 6400))
    decks = decks_cm(spark, sf).select("tx")
    return collision.payload_size(prisms(spark, sf), decks, ["tx"], grid, grid.limit(0)).withColumn("bytes", F.col("bytes").cast("bigint"))


def triangles(spark, sf):
    """Two roof triangles per footprint (one in five flipped) and one wall triangle."""
    f = fixture(spark, sf, "fx_footprints")
    d = lambda e: F.expr(e).cast("double")
    v = lambda x, y, z: F.struct(d(x).alias("x"), d(y).alias("y"), d(z).alias("z"))
    n = lambda x, y, z: F.struct(*[F.lit(float(k)).alias(c) for k, c in zip((x, y, z), "xyz")])
    p00, p10, p01, low = v("x0_cm", "9", "y0_cm"), v("x0_cm + w_cm", "9", "y0_cm"), v("x0_cm", "9", "y0_cm + h_cm"), v("x0_cm", "0", "y0_cm")
    up = F.col("fid") % 5 != 0
    roof = f.select("tx", p00.alias("a"), F.when(up, p01).otherwise(p10).alias("b"), F.when(up, p10).otherwise(p01).alias("c"), n(0, 1, 0).alias("normal"))
    wall = f.select("tx", p00.alias("a"), p10.alias("b"), low.alias("c"), F.when(F.col("fid") % 7 == 0, n(0, 0, -1)).otherwise(n(0, 0, 1)).alias("normal"))
    return roof.unionByName(wall)


@query("ag21_triangle_audit", """
    select tx, count(*) * 2 as triangles, count(*) as roof_triangles, round(count(*) filter (fid % 5 <> 0) / count(*)::double, 6) as roof_up,
           round((count(*) filter (fid % 5 <> 0) + count(*) filter (fid % 7 = 0)) / (2.0 * count(*))::double, 6) as normals_agree from {fx_footprints} group by tx""")
def ag21(spark, sf):
    out = qa.triangle_audit(triangles(spark, sf), ["tx"])
    return out.select("tx", "triangles", "roof_triangles", F.round("roof_up", 6).alias("roof_up"), F.round("normals_agree", 6).alias("normals_agree"))


@query("ag22_duplicate_quads", """
    with q as (select tx, (x_cm * 4 + 50) // 100 as a, (y_cm * 4 + 50) // 100 as b, count(*) as n from {fx_points} group by 1, 2, 3)
    select tx, sum(n)::bigint as quads, sum(n - 1)::bigint as duplicates, round(sum(n - 1) / sum(n)::double, 6) as share from q group by tx""")
def ag22(spark, sf):
    pts = fixture(spark, sf, "fx_points")
    return qa.duplicate_share(pts, [F.col("x_cm") / 100.0, F.col("y_cm") / 100.0], ["tx"]).withColumn("share", F.round("share", 6))


@query("ag23_roof_coverage", """
    with b as (select tx, min(x0_cm) as x0, max(x0_cm + w_cm) as x1, min(y0_cm) as y0, max(y0_cm + h_cm) as y1 from {fx_footprints} group by 1),
         p as (select tx, i, j, x0 + (x1 - x0) * i / 6e0 as x, y0 + (y1 - y0) * j / 6e0 as y from b, (select unnest(generate_series(0, 6)) as i) q, (select unnest(generate_series(0, 6)) as j) r),
         h as (select distinct p.tx, i, j from p join {fx_prisms} s on s.tx = p.tx and x >= x0_cm and x < x0_cm + w_cm and y >= y0_cm and y < y0_cm + h_cm
               and not (x >= x0_cm + 100 and x < x0_cm + 200 and y >= y0_cm + 100 and y < y0_cm + 200))
    select p.tx, count(*) as probes, count(h.i) as hits from p left join h using (tx, i, j) group by 1""")
def ag23(spark, sf):
    p = prisms(spark, sf)
    find = lambda probes: collision.ray_down(probes.withColumns({"from_y": F.lit(1e6), "max_drop": F.lit(2e6)}), "probe_id", p, None, None, 800)
    return collision.roof_coverage(p, find, ["tx"]).select("tx", "probes", F.col("hits").cast("bigint").alias("hits"))
