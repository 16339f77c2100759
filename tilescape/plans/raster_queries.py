"""Queries over rasters: canopy, stems, crowns, elevation tiles, sampling, imagery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import colours, fixedpoint, geo
from tilescape.functions._base import whole
from tilescape.operators import graph, raster, trees

from .fixtures import fixture, parts_for, spark_table
from .registry import query
from .scalar_queries import micro, milli

N = 64
# Thresholds in centimetres, areas sized for 8 m islands.
RULES = trees.TreeRules(min_height=300, max_height=3500, noise_area=3, small_area=25, medium_area=50,
                        medium_span=400, large_span=60, floor_radius=1, floor_share=0.1, plateau_span=150)

CELLS = """c as (select tx, x_cm // 100 as cx, 63 - y_cm // 100 as cy, min(case when cls = 2 then z_cm end) as dem,
        max(case when cls not in (2, 9, 17) then z_cm end) as dsm from {fx_points} where cls not in (7, 18) group by 1, 2, 3)"""
# Ground is filled from the nearest known cell before heights are taken.
GROUNDED = CELLS + """, gap as (select a.tx, a.cx, a.cy, min(row((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2, b.cy, b.cx, b.dem)) as best
        from c a join c b on a.tx = b.tx where a.dem is null and b.dem is not null group by all),
    gr as (select c.tx, c.cx, c.cy, coalesce(c.dem, best[4]) as dem, dsm from c left join gap on c.tx = gap.tx and c.cx = gap.cx and c.cy = gap.cy)"""
CANOPY = GROUNDED + """, h as (select tx, cx, cy, greatest(dsm - dem, 0) as chm from gr where dsm is not null)"""


def elevation(spark, sf):
    return raster.elevation_cells(fixture(spark, sf, "fx_points"), N, N, 100, x="x_cm", y="y_cm", z="z_cm")


def canopy(spark, sf):
    """Canopy of the cells with a surface return (the others have height 0), above the filled ground."""
    return raster.canopy_cells(raster.fill_gaps(elevation(spark, sf), N)).filter("dsm is not null").select("tx", "cx", "cy", "chm")


@query("flagship_tree_stems", f"""
    with {CANOPY}, m as (select a.tx, a.cx, a.cy, a.chm, max(b.chm) as lm from h a join h b
         on a.tx = b.tx and b.cx between a.cx - 3 and a.cx + 3 and b.cy between a.cy - 3 and a.cy + 3 group by all)
    select tx, count(*) as stems, max(chm) as max_h_cm, sum(chm)::bigint as sum_h
    from m where chm = lm and chm between 300 and 3500 group by tx""")
def flagship(spark, sf):
    return (trees.local_stems(canopy(spark, sf), N, N, RULES).groupBy("tx")
            .agg(F.count("*").alias("stems"), F.max("chm").alias("max_h_cm"), F.sum("chm").alias("sum_h")))


@query("src1_clipped_points", """
    select tx, x_cm, y_cm, cls, z_cm, count(*) as n from {fx_points}
    where x_cm >= 500 and x_cm < 6000 and y_cm >= 800 and y_cm < 5900 and cls not in (7, 18) group by all""")
def src1(spark, sf):
    from tilescape.sources import clip_points
    return (clip_points(fixture(spark, sf, "fx_points"), (500, 800, 6000, 5900), x="x_cm", y="y_cm")
            .groupBy("tx", "x_cm", "y_cm", "cls", "z_cm").agg(F.count("*").alias("n")))


@query("fl1_class_roles", """
    select tx, case cls when 2 then 'ground' when 9 then 'water' when 17 then 'bridge' else 'above' end as role, count(*) as n
    from {fx_points} group by 1, 2""")
def fl1(spark, sf):
    return fixture(spark, sf, "fx_points").groupBy("tx", raster.point_role("cls").alias("role")).agg(F.count("*").alias("n"))


@query("fl2_density_gate", """
    select tx, cls, count(*) as n from {fx_points}
    where tx in (select tx from {fx_points} where cls = 2 group by tx having count(*) >= 9000) group by 1, 2""")
def fl2(spark, sf):
    kept = raster.density_gate(fixture(spark, sf, "fx_points"), 9000, where=F.col("cls") == 2)
    return kept.groupBy("tx", "cls").agg(F.count("*").alias("n"))


@query("fl3_implausible_counts", f"""
    with {CANOPY} select tx, count(*) as n, count(*) > 2000 as implausible from h where chm >= 300 group by tx""")
def fl3(spark, sf):
    from tilescape.operators import qa
    return qa.implausible_counts(canopy(spark, sf).filter("chm >= 300"), 2000)


@query("ag1_elevation_cells", f"with {CELLS} select tx, cx, cy, dem, dsm from c")
def ag1(spark, sf):
    return elevation(spark, sf)


@query("ag2_canopy_height", f"""
    with {GROUNDED} select tx, cx, cy, greatest(coalesce(dsm, dem) - dem, 0) as chm from gr""")
def ag2(spark, sf):
    return raster.canopy_cells(raster.fill_gaps(elevation(spark, sf), N)).select("tx", "cx", "cy", "chm")


DENSE = f"""{CELLS}, g as (select tx, a as cx, b as cy from (select distinct tx from c) t, range(64) x(a), range(64) y(b)),
    d as (select g.tx, g.cx, g.cy, c.dem from g left join c on g.tx = c.tx and g.cx = c.cx and g.cy = c.cy),
    nf as (select a.tx, a.cx, a.cy, min(row((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2, b.cy, b.cx, b.dem)) as best
           from d a join d b on a.tx = b.tx and b.dem is not null where a.dem is null group by all)"""


@query("wn4_nearest_fill", f"""
    with {DENSE} select d.tx, d.cx, d.cy, coalesce(d.dem, best[4]) as dem, cast(best[1] as bigint) as fill_d2
    from d left join nf on d.tx = nf.tx and d.cx = nf.cx and d.cy = nf.cy""")
def wn4(spark, sf):
    grid = raster.dense_grid(elevation(spark, sf).select("tx", "cx", "cy", "dem"), N, N)
    return raster.fill_nearest(grid, N)


@query("ag3_terrain_tile", f"""
    with {DENSE}, f as (select d.tx, d.cx, d.cy, coalesce(d.dem, best[4], 0) / 100e0 + 32768 as v
        from d left join nf on d.tx = nf.tx and d.cx = nf.cx and d.cy = nf.cy)
    select tx, cx as px, cy as py, cast(floor(v / 256) as bigint) as r, cast(floor(v) as bigint) % 256 as g,
           cast(floor((v - floor(v)) * 256) as bigint) as b from f""")
def ag3(spark, sf):
    from tilescape.sinks import terrain_rows
    ground = fixture(spark, sf, "fx_points").withColumn("z_cm", F.col("z_cm"))
    cells = raster.elevation_cells(ground, N, N, 100, x="x_cm", y="y_cm", z="z_cm").select("tx", "cx", "cy", "dem")
    filled = raster.fill_nearest(raster.dense_grid(cells, N, N), N)
    return terrain_rows(filled.withColumn("elev", F.coalesce(F.col("dem") / 100.0, F.lit(0.0))), tile=("tx",))


@query("ag4_class_histogram", """
    select coalesce(cast(tx as varchar), 'all') as tile, coalesce(cast(cls as varchar), 'all') as cls, count(*) as n,
           round(count(*) filter (cls not in (7, 18)) / count(*)::double, 6) as kept
    from {fx_points} group by rollup (tx, cls)""")
def ag4(spark, sf):
    from tilescape.operators import qa
    return qa.class_histogram(fixture(spark, sf, "fx_points"))


# Closure of the touching relation inside islands; the smallest (row, column) names a component.
COMPONENTS = f"""{CANOPY}, m as (select tx, cx, cy, chm from h where chm >= 300),
    reach as (select tx, cx, cy, cy as ly, cx as lx from m
        union select m.tx, m.cx, m.cy, reach.ly, reach.lx from reach join m on m.tx = reach.tx
             and abs(m.cx - reach.cx) + abs(m.cy - reach.cy) = 1),
    k as (select tx, cx, cy, min(ly * 1000 + lx) as comp from reach group by 1, 2, 3),
    st as (select k.tx, comp, count(*) as area, max(chm) as top, min(chm) as low, max(chm) - min(chm) as span
           from k join m using (tx, cx, cy) group by 1, 2)"""


def components(spark, sf):
    return graph.label_components(canopy(spark, sf).filter("chm >= 300"), ["cy", "cx"])


@query("it1_components", f"with recursive {COMPONENTS} select tx, cx, cy, comp // 1000 as row0, comp % 1000 as col0 from k")
def it1(spark, sf):
    return components(spark, sf).select("tx", "cx", "cy", F.col("component.cy").alias("row0"), F.col("component.start").alias("col0"))


@query("ag5_component_stats", f"with recursive {COMPONENTS} select tx, comp // 1000 as row0, comp % 1000 as col0, area, top, low, span from st")
def ag5(spark, sf):
    return graph.component_stats(components(spark, sf), "chm").select(
        "tx", F.col("component.cy").alias("row0"), F.col("component.start").alias("col0"), "area", "top", "low", "span")


BAD = "(area < 3 or (area > 25 and area <= 50 and span < 400) or (area > 50 and span < 60))"


@query("ag6_component_rejection", f"""
    with recursive {COMPONENTS} select tx, comp // 1000 as row0, comp % 1000 as col0, area, span from st where {BAD}""")
def ag6(spark, sf):
    stats = graph.component_stats(components(spark, sf), "chm")
    return trees.rejected(stats, RULES).select("tx", F.col("component.cy").alias("row0"), F.col("component.start").alias("col0"), "area", "span")


@query("wn1_local_maxima", f"""
    with {CANOPY} select a.tx, a.cx, a.cy, a.chm, max(b.chm) as local_max from h a join h b
         on a.tx = b.tx and b.cx between a.cx - 3 and a.cx + 3 and b.cy between a.cy - 3 and a.cy + 3
    group by all having a.chm = max(b.chm) and a.chm between 300 and 3500""")
def wn1(spark, sf):
    return trees.local_stems(canopy(spark, sf), N, N, RULES)


FOCAL = """f as (select a.tx, a.cx, a.cy, a.chm, max(b.chm) as local_max,
         max(case when abs(b.cx - a.cx) <= 1 and abs(b.cy - a.cy) <= 1 then b.chm end) as near_max,
         case when count(case when abs(b.cx - a.cx) <= 1 and abs(b.cy - a.cy) <= 1 then 1 end)
                   = (least(a.cx + 1, 63) - greatest(a.cx - 1, 0) + 1) * (least(a.cy + 1, 63) - greatest(a.cy - 1, 0) + 1)
              then min(case when abs(b.cx - a.cx) <= 1 and abs(b.cy - a.cy) <= 1 then b.chm end) else 0 end as near_min
    from {src} a join {src} b on a.tx = b.tx and b.cx between a.cx - 3 and a.cx + 3 and b.cy between a.cy - 3 and a.cy + 3
    group by a.tx, a.cx, a.cy, a.chm)"""


@query("wn2_continuity", f"""
    with {CANOPY}, {FOCAL.replace('{src}', 'h')} select tx, cx, cy, chm, local_max, near_max, near_min from f
    where chm = local_max and chm > 0 and chm between 300 and 3500 and near_min >= chm * 0.1e0 and near_max - near_min >= 150""")
def wn2(spark, sf):
    return trees.continuous_stems(canopy(spark, sf), N, N, RULES)


CROWNS = """ring as (select dx, dy, cast(floor(sqrt(dx * dx + dy * dy) + 0.5) as bigint) as r
         from (select unnest(generate_series(-11, 11)) as dx) a, (select unnest(generate_series(-11, 11)) as dy) b),
    means as (select s.tx, s.cx, s.cy, s.chm, ring.r, sum(coalesce(v.chm, 0)) / count(*)::double as mean
         from {stems} s join ring on ring.r between 1 and 10 and s.cx + dx between 0 and 63 and s.cy + dy between 0 and 63
         left join {src} v on v.tx = s.tx and v.cx = s.cx + dx and v.cy = s.cy + dy group by 1, 2, 3, 4, 5),
    crown as (select tx, cx, cy, chm, greatest(1.5e0, coalesce(min(case when mean < chm * 0.5e0 then r end), 10)) as crown_r
         from means group by 1, 2, 3, 4)"""


@query("wn3_crown_radius", f"""
    with {CANOPY}, s as (select tx, cx, cy, chm from (select a.tx, a.cx, a.cy, a.chm, max(b.chm) as lm from h a join h b
         on a.tx = b.tx and b.cx between a.cx - 3 and a.cx + 3 and b.cy between a.cy - 3 and a.cy + 3 group by all)
         where chm = lm and chm between 300 and 3500), {CROWNS.replace('{stems}', 's').replace('{src}', 'h')}
    select * from crown""")
def wn3(spark, sf):
    cells = canopy(spark, sf)
    stems = trees.local_stems(cells, N, N, RULES).drop("local_max")
    return trees.with_crowns(stems, cells, N, N, RULES)


@query("trees_per_tile", f"""
    with recursive {COMPONENTS}, v as (select h.* from h left join (select k.tx, k.cx, k.cy from k join st using (tx, comp) where {BAD}) x
         on h.tx = x.tx and h.cx = x.cx and h.cy = x.cy where x.tx is null), {FOCAL.replace('{src}', 'v')},
    s as (select tx, cx, cy, chm from f where chm = local_max and chm > 0 and chm between 300 and 3500
          and near_min >= chm * 0.1e0 and near_max - near_min >= 150), {CROWNS.replace('{stems}', 's').replace('{src}', 'v')}
    select tx, cx, cy, chm, crown_r from crown""")
def trees_per_tile(spark, sf):
    return trees.extract_trees(canopy(spark, sf), N, N, None, RULES)


@query("fl9_tile_ownership", """
    select fid, tx, ty from (select fid, tx, ty, (tx * 4096 + u0) // 4096 as ox, (ty * 4096 + v0) // 4096 as oy from {fx_features}) q
    where ox = tx and oy = ty""")
def fl9(spark, sf):
    f = fixture(spark, sf, "fx_features")
    lon = geo.tile_lon(F.col("tx") + (F.col("u0") + 0.25) / 4096.0, 14)
    lat = geo.tile_lat(F.col("ty") + (F.col("v0") + 0.25) / 4096.0, 14)
    placed = f.withColumns({"lon": lon, "lat": lat})
    return placed.filter((geo.tile_x("lon", 14) == F.col("tx")) & (geo.tile_y("lat", 14) == F.col("ty"))).select("fid", "tx", "ty")


# -- Elevation tiles ----------------------------------------------------------

# exp(-d^2 / 0.72) / (1 + 2 exp(-1 / 0.72) + 2 exp(-4 / 0.72)) for d = 0, 1, 2
@query("wn5_gaussian", """
    with g as (select tx, ty, x as px, y as py from (select distinct tx, ty from {fx_pixels}) t, range(64) a(x), range(64) b(y)),
         d as (select g.*, e.elev_dm from g left join {fx_pixels} e on e.tx = g.tx and e.ty = g.ty and e.px = g.px and e.py = g.py),
         nf as (select a.tx, a.ty, a.px, a.py, min(row((a.px - b.px) ** 2 + (a.py - b.py) ** 2, b.py, b.px, b.elev_dm)) as best
                from d a join d b on a.tx = b.tx and a.ty = b.ty and b.elev_dm is not null where a.elev_dm is null group by all),
         p as (select d.tx, d.ty, d.px, d.py, coalesce(d.elev_dm, best[4]) as elev_dm from d left join nf on d.tx = nf.tx and d.ty = nf.ty and d.px = nf.px and d.py = nf.py),
         k as (select unnest(generate_series(-2, 2)) as d), s as (select 1 + 2 * exp(-1 / 0.72e0) + 2 * exp(-4 / 0.72e0) as total), w as (select d, exp(-d * d / 0.72e0) / total as w from k, s),
         a as (select p.tx, p.ty, p.px, p.py, sum(q.elev_dm * w) as v from p, w, p q where q.tx = p.tx and q.ty = p.ty and q.px = p.px
               and q.py = case when p.py + d < 0 then -1 - (p.py + d) when p.py + d > 63 then 127 - (p.py + d) else p.py + d end group by 1, 2, 3, 4),
         b as (select a.tx, a.ty, a.px, a.py, sum(q.v * w) as v from a, w, a q where q.tx = a.tx and q.ty = a.ty and q.py = a.py
               and q.px = case when a.px + d < 0 then -1 - (a.px + d) when a.px + d > 63 then 127 - (a.px + d) else a.px + d end group by 1, 2, 3, 4)
    select tx, ty, px, py, cast(round(v * 100) as bigint) as smooth_mm from b""")
def wn5(spark, sf):
    px = fixture(spark, sf, "fx_pixels").select("tx", "ty", F.col("px").alias("cx"), F.col("py").alias("cy"), F.col("elev_dm").cast("double").alias("dem"))
    tile = ("tx", "ty")
    out = raster.smooth_tiles(px, N, N, tile=tile)
    return out.select("tx", "ty", F.col("cx").alias("px"), F.col("cy").alias("py"), F.round(F.col("dem") * 100).cast("bigint").alias("smooth_mm"))


BILINEAR = """
    select {keep}, coalesce(sum(v.elev_dm * c.wx * c.wy), 0) as elev, count(v.elev_dm) > 0 as covered from (
        select q.*, x0 + dx as cpx, y0 + dy as cpy, case dx when 0 then 1 - ax else ax end as wx, case dy when 0 then 1 - ay else ay end as wy from (
            select *, greatest(0, least(1, px - x0)) as ax, greatest(0, least(1, py - y0)) as ay from (
                select *, cast(greatest(0, least(62, floor(px))) as bigint) as x0, cast(greatest(0, least(62, floor(py))) as bigint) as y0 from (
                    select *, cast(floor(fx) as bigint) as itx, cast(floor(fy) as bigint) as ity,
                           (fx - floor(fx)) * 64 - 0.5e0 as px, (fy - floor(fy)) * 64 - 0.5e0 as py from {src}) a) b) q,
        (select unnest([0, 1]) as dx) d1, (select unnest([0, 1]) as dy) d2) c
    left join {fx_pixels} v on v.tx = c.itx and v.ty = c.ity and v.px = c.cpx and v.py = c.cpy group by {keep}"""


def bilinear_sql(src: str, keep: str) -> str:
    return BILINEAR.replace("{src}", src).replace("{keep}", keep)


def pixels(spark, sf):
    return fixture(spark, sf, "fx_pixels").withColumnRenamed("elev_dm", "value")


@query("jn6_bilinear_sample", f"""
    select probe_id, round(elev, 6) as elev, covered from ({bilinear_sql('{fx_probes}', 'probe_id')}) s""")
def jn6(spark, sf):
    out = raster.sample_bilinear(fixture(spark, sf, "fx_probes"), pixels(spark, sf), "fx", "fy", N, keep=["probe_id"])
    return out.select("probe_id", F.round("elev", 6).alias("elev"), F.col("elev_covered").alias("covered"))


@query("jn7_nearest_sample", """
    select probe_id, r, g, b from {fx_probes} p left join {fx_wash} w on w.tx = floor(fx) and w.ty = floor(fy)
        and w.px = floor((fx - floor(fx)) * 64) and w.py = floor((fy - floor(fy)) * 64)""")
def jn7(spark, sf):
    out = raster.sample_nearest(fixture(spark, sf, "fx_probes"), fixture(spark, sf, "fx_wash"), "fx", "fy", N, ["r", "g", "b"])
    return out.select("probe_id", "r", "g", "b")


def geo_probes(spark, sf):
    """Probes as degrees in a zoom-3 world, whose tiles are the fixture tiles."""
    return fixture(spark, sf, "fx_probes").select("probe_id", geo.tile_lon("fx", 3).alias("lon"), geo.tile_lat("fy", 3).alias("lat"))


LATTICE = """l0 as (select probe_id, fx, fy, floor(fx) as itx, floor(fy) as ity, degrees(atan(sinh(pi() * (1 - 2 * fy / 8)))) as lat,
        degrees(atan(sinh(pi() * (1 - 2 * floor(fy) / 8)))) as north, degrees(atan(sinh(pi() * (1 - 2 * (floor(fy) + 1) / 8)))) as south from {probes}),
    l1 as (select *, (fx - itx) * {G} as gx, (lat - north) / (south - north) * {G} as gy from l0),
    l2 as (select *, floor(gx) as ix, floor(gy) as iy, gx - floor(gx) as rx, gy - floor(gy) as ry from l1),
    l3 as (select *, case when rx + ry <= 1 then case when ox = 0 and oy = 0 then 1 - rx - ry when ox = 1 and oy = 0 then rx when ox = 0 then ry else 0 end
                 else case when ox = 1 and oy = 1 then rx + ry - 1 when ox = 0 and oy = 1 then 1 - rx when ox = 1 then 1 - ry else 0 end end as lw
           from l2, (select unnest([0, 1]) as ox) d1, (select unnest([0, 1]) as oy) d2),
    l4 as (select probe_id, ox, oy, lw, itx + (ix + ox) / {G} as fx,
                  case iy + oy when 0 then ity when {G} then ity + 1 else 8 * (0.5e0 - ln((1 + sin(radians(clat))) / (1 - sin(radians(clat)))) / (4 * pi())) end as fy
           from (select *, north + (south - north) * ((iy + oy) / {G}) as clat from l3) q where lw <> 0)"""


def lattice_sql(grid: int, probes: str = "{fx_probes}") -> str:
    return LATTICE.replace("{G}", f"{grid}e0").replace("{probes}", probes)


@query("jn8_lattice_sample", f"""
    with {lattice_sql(64)}, s as ({bilinear_sql('l4', 'probe_id, ox, oy, lw')})
    select probe_id, round(sum(elev * lw), 3) as surface from s group by probe_id""")
def jn8(spark, sf):
    out = raster.sample_surface(geo_probes(spark, sf), pixels(spark, sf), "lon", "lat", 3, size=N, grid=64)
    return out.select("probe_id", F.round("surface", 3).alias("surface"))


@query("jn9_fine_over_coarse", f"""
    with fine as (select probe_id, fx * 2 as fx, fy * 2 as fy from {{fx_probes}}),
         a as ({bilinear_sql('fine', 'probe_id')}), b as ({bilinear_sql('{fx_probes}', 'probe_id')})
    select probe_id, round(case when a.covered then a.elev else b.elev end, 3) as elev, a.covered or b.covered as covered
    from a join b using (probe_id)""")
def jn9(spark, sf):
    # The same tiles serve as the fine layer one zoom below.
    out = raster.sample_preferred(geo_probes(spark, sf), pixels(spark, sf), pixels(spark, sf),
                                  geo.tile_frac_x("lon", 3), geo.tile_frac_y("lat", 3), 1, N)
    return out.select("probe_id", F.round("elev", 3).alias("elev"), F.col("elev_covered").alias("covered"))


@query("wn31_terrain_lattice", f"""
    with v as (select tx, ty, ix, iy, ix / 32e0 as u, tx + ix / 32e0 as fx,
                degrees(atan(sinh(pi() * (1 - 2 * ty / 8e0)))) as north, degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 8e0)))) as south
               from (select distinct tx, ty from {{fx_pixels}}) t, (select unnest(generate_series(0, 32)) as ix) a, (select unnest(generate_series(0, 32)) as iy) b),
         w as (select *, north + (south - north) * (iy / 32e0) as lat from v),
         x as (select tx, ty, ix, iy, lat, fx, case iy when 0 then ty when 32 then ty + 1 else 8 * (0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) end as fy from w),
         s as ({bilinear_sql('x', 'tx, ty, ix, iy, lat').replace('select tx, ty, ix, iy, lat,', 'select c.tx, c.ty, c.ix, c.iy, c.lat,').replace('group by tx, ty, ix, iy, lat', 'group by c.tx, c.ty, c.ix, c.iy, c.lat')})
    select tx, ty, cast(ix as int) as ix, cast(iy as int) as iy, round(elev, 3) as h,
           round(coalesce(lead(elev) over r, elev) - coalesce(lag(elev) over r, elev), 3) as dh_x,
           round(coalesce(lead(elev) over k, elev) - coalesce(lag(elev) over k, elev), 3) as dh_y,
           round(coalesce(lead(lat) over k, lat) - coalesce(lag(lat) over k, lat), 6) as d_lat,
           round((least(ix + 1, 32) - greatest(ix - 1, 0)) / 32e0 * 45, 6) as d_lon
    from s window r as (partition by tx, ty, iy order by ix), k as (partition by tx, ty, ix order by iy)""")
def wn31(spark, sf):
    px = pixels(spark, sf)
    tiles = px.select("tx", "ty").distinct()
    out = raster.lattice_vertices(tiles, px, 3, grid=32, size=N)
    return out.select("tx", "ty", "ix", "iy", *[F.round(c, 3).alias(c) for c in ("h", "dh_x", "dh_y")], *[F.round(c, 6).alias(c) for c in ("d_lat", "d_lon")])


@query("jn25_surface_normal", f"""
    with o as (select probe_id, fx, fy, k, case k when 0 then 0.0625e0 when 1 then -0.0625e0 else 0 end as dx,
                      case k when 2 then 0.0625e0 when 3 then -0.0625e0 else 0 end as dy from {{fx_probes}}, (select unnest([0, 1, 2, 3]) as k) kk),
         p as (select probe_id, k, fx + dx as fx, fy + dy as fy from o), s as ({bilinear_sql('p', 'probe_id, k')}),
         n as (select probe_id, -(max(case when k = 0 then elev end) - max(case when k = 1 then elev end)) / 10 as nx,
                      -(max(case when k = 2 then elev end) - max(case when k = 3 then elev end)) / 10 as nz from s group by 1)
    select probe_id, round(nx / sqrt(nx * nx + nz * nz + 1), 5) as nx, round(1 / sqrt(nx * nx + nz * nz + 1), 5) as ny,
           round(nz / sqrt(nx * nx + nz * nz + 1), 5) as nz from n""")
def jn25(spark, sf):
    # 80 m tiles, so the 5 m step is 1/16 tile.
    probes = fixture(spark, sf, "fx_probes").select("probe_id", (F.col("fx") * 80).alias("x"), (F.col("fy") * 80).alias("z"))
    sample = lambda df: raster.sample_bilinear(df, pixels(spark, sf), F.col("_sx") / 80, F.col("_sz") / 80, N, out="surface")
    out = raster.surface_normal(probes, sample, "x", "z", 5.0)
    return out.select("probe_id", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query("cp2_terrarium_round_trip", """
    with v as (select tx, ty, elev_dm / 30e0 as e, elev_dm / 30e0 + 32768 as v from {fx_pixels}),
         d as (select tx, ty, e, floor(v / 256) * 256 + floor(v) % 256 + floor((v - floor(v)) * 256) / 256e0 - 32768 as back from v)
    select tx, ty, round(min(back), 6) as low, round(max(back), 6) as high, max(abs(back - e)) <= 1 / 256e0 as within from d group by tx, ty""")
def cp2(spark, sf):
    from tilescape.operators import qa
    px = fixture(spark, sf, "fx_pixels").withColumn("elev", F.col("elev_dm") / 30.0)
    return qa.terrarium_round_trip(px, "elev", ("tx", "ty"))


# -- Imagery ------------------------------------------------------------------

@query("ag17_contrast_stretch", """
    with v as (select tx, ty, px, py, band, unnest([r, g, b][band:band]) as v from {fx_wash}, range(1, 4) t(band)),
         h as (select tx, ty, band, v, count(*) as n from v group by 1, 2, 3, 4),
         c as (select *, sum(n) over (partition by tx, ty, band order by v) as up, sum(n) over (partition by tx, ty, band order by v desc) as down,
                      sum(n) over (partition by tx, ty, band) as total from h),
         l as (select tx, ty, band, min(case when up > total * 1 // 100 then v end) as lo, max(case when down > total * 3 // 100 then v end) as hi from c group by 1, 2, 3),
         o as (select tx, ty, px, py, band, cast(case when hi <= lo then v else greatest(0, least(255, trunc(v * (255e0 / (hi - lo)) - lo * (255e0 / (hi - lo))))) end as bigint) as v
               from v join l using (tx, ty, band))
    select tx, ty, px, py, max(v) filter (band = 1) as r, max(v) filter (band = 2) as g, max(v) filter (band = 3) as b from o group by 1, 2, 3, 4""")
def ag17(spark, sf):
    out = raster.contrast_stretch(fixture(spark, sf, "fx_wash"), ["r", "g", "b"])
    return out.select("tx", "ty", "px", "py", *[F.col(c).cast("bigint").alias(c) for c in "rgb"])


@query("ag18_downsample", """
    select tx, ty, px // 2 as px, py // 2 as py, avg(r) as r, avg(g) as g, avg(b) as b from {fx_wash} group by 1, 2, 3, 4""")
def ag18(spark, sf):
    return raster.box_downsample(fixture(spark, sf, "fx_wash"), 2, ["r", "g", "b"], parts=parts_for(spark_table(spark, sf, "customer")))
