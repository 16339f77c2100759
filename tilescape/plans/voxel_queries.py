"""Queries over voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.operators import raster, voxels
from tilescape.session import cut

from .fixtures import fixture, parts_for
from .registry import query

N, VOXEL, UNIT = 64, 100.0, 100.0

BASE = """p as (select * from {fx_points} where cls not in (7, 18)),
    rg as (select tx, quantile_cont(z_cm, 0.01) - 200 as origin, cast(ceil((quantile_cont(z_cm, 0.999) + 2000 - (quantile_cont(z_cm, 0.01) - 200)) / 100) + 4 as bigint) as ny from p group by 1),
    pv as (select p.tx, cls, x_cm // 100 as ix, greatest(0, least(ny - 1, cast(floor((z_cm - origin) / 100) as bigint))) as iy, y_cm // 100 as iz, ny from p join rg using (tx)),
    gs as (select tx, ix, iz, max(iy) as gy from pv where cls = 2 group by 1, 2, 3),
    grid as (select tx, a as ix, b as iz from (select distinct tx from gs) t, range(64) x(a), range(64) y(b)),
    dn as (select grid.tx, grid.ix, grid.iz, gy from grid left join gs using (tx, ix, iz)),
    nr as (select d.tx, d.ix, d.iz, min(greatest(abs(g.ix - d.ix), abs(g.iz - d.iz))) as dist from dn d join gs g on g.tx = d.tx
           and g.ix between d.ix - 8 and d.ix + 8 and g.iz between d.iz - 8 and d.iz + 8 where d.gy is null group by 1, 2, 3),
    fl as (select n.tx, n.ix, n.iz, max(g.gy) as gy from nr n join gs g on g.tx = n.tx and greatest(abs(g.ix - n.ix), abs(g.iz - n.iz)) = n.dist group by 1, 2, 3),
    sf as (select d.tx, d.ix, d.iz, coalesce(d.gy, fl.gy, 0) as gy from dn d left join fl using (tx, ix, iz)),
    cr as (select tx, ix, unnest(list_distinct([gy, greatest(0, gy - 1)])) as iy, iz, 1 as tag from sf),
    cv as (select tx, ix, iy, iz, 5 as tag from pv where cls = 9),
    st as (select distinct pv.tx, pv.ix, pv.iy, pv.iz, 3 as tag from pv join sf using (tx, ix, iz) where cls = 1 and iy - gy > 2),
    vx as (select tx, ix, iy, iz, max(tag) as tag from (select * from cr union all select * from cv union all select * from st) u group by 1, 2, 3, 4),
    tp as (select tx, ix, iz, gy, max(iy) as top from (select v.*, gy, ny, iy - lag(iy) over (partition by tx, ix, iz order by iy) as gap
           from vx v join sf using (tx, ix, iz) join rg using (tx) where tag = 3) b where gap <= 3 and iy <= least(ny - 1, gy + 320) and iy > gy group by 1, 2, 3, 4),
    inf as (select s.* from (select tx, ix, unnest(generate_series(gy + 1, top)) as iy, iz from tp) s left join vx using (tx, ix, iy, iz) where vx.tag is null),
    v2 as (select * from vx union all select tx, ix, iy, iz, 3 from inf),
    wl as (select tx, cast(round_even(median(iy), 0) as bigint) as sea from pv where cls = 9 group by 1),
    lc as (select sf.*, sea, greatest(0, sea - 2) as lo from sf join wl using (tx) where gy <= sea + 1),
    fc as (select l.tx, l.ix, l.iz, l.gy, l.sea, l.lo, coalesce(bool_or(v.tag in (2, 3, 4) and v.iy > gy and v.iy <= sea), false) as built,
                  coalesce(bool_or(v.iy between lo and sea), false) as filled from lc l left join v2 v using (tx, ix, iz) group by all),
    slab as (select tx, ix, unnest(generate_series(lo, sea)) as iy, iz from fc where (gy < sea and not built) or not filled),
    v3 as (select v2.* from v2 left join slab using (tx, ix, iy, iz) where slab.tx is null union all select tx, ix, iy, iz, 5 from slab)"""


def points(spark, sf):
    return raster.drop_noise(fixture(spark, sf, "fx_points"))


def grid(spark, sf):
    """(points with voxel index, ranges)."""
    # Ranges are few, so Spark may send them to the points; the points are not sorted for them.
    p = raster.drop_noise(fixture(spark, sf, "fx_points", keyed=False, dealt=False))
    ranges = voxels.vertical_range(p, VOXEL, "z_cm", UNIT)
    # Stage tables: later steps read each stage several times.
    ranges = cut(ranges)
    return cut(voxels.with_voxel(p, ranges, VOXEL, N, N, "x_cm", "y_cm", "z_cm")), ranges


def surface(p):
    return voxels.fill_surface(voxels.ground_surface(p), N, N)


def structure(p, s):
    return voxels.structure_voxels(p, s, VOXEL, UNIT, parts=parts_for(p, 500_000))


def tagged(spark, sf):
    p, ranges = grid(spark, sf)
    s = cut(surface(p))
    return p, ranges, s, cut(voxels.merge_tags([voxels.ground_crust(s), voxels.class_voxels(p), structure(p, s)], tasks=parts_for(p, 500_000)))


def filled(spark, sf):
    p, ranges, s, v = tagged(spark, sf)
    return p, s, cut(voxels.infill(v, voxels.column_tops(v, s, ranges, VOXEL, UNIT)))


def flooded(spark, sf):
    p, s, v = filled(spark, sf)
    return voxels.flood(v, s, voxels.water_levels(p), VOXEL, UNIT)


VOX = ("tx", "ix", "iy", "iz")


@query("ag13_vertical_range", f"with {BASE} select tx, round(origin, 4) as origin, ny from rg")
def ag13(spark, sf):
    return voxels.vertical_range(points(spark, sf), VOXEL, "z_cm", UNIT).withColumn("origin", F.round("origin", 4))


@query("ag11_ground_surface", f"with {BASE} select * from gs")
def ag11(spark, sf):
    return voxels.ground_surface(grid(spark, sf)[0])


@query("wn6_surface_fill", f"with {BASE} select * from sf")
def wn6(spark, sf):
    return surface(grid(spark, sf)[0])


@query("wn22_ground_crust", f"with {BASE} select tx, ix, iy, iz from cr")
def wn22(spark, sf):
    return voxels.ground_crust(surface(grid(spark, sf)[0])).select(*VOX)


@query("wn23_structure", f"with {BASE} select tx, ix, iy, iz from st")
def wn23(spark, sf):
    p, _ = grid(spark, sf)
    return structure(p, surface(p)).select(*VOX)


@query("ag12_voxel_tags", f"with {BASE} select tx, ix, iy, iz, cast(tag as int) as tag from vx")
def ag12(spark, sf):
    return tagged(spark, sf)[3]


@query("wn20_column_tops", f"with {BASE} select * from tp")
def wn20(spark, sf):
    p, ranges, s, v = tagged(spark, sf)
    return voxels.column_tops(v, s, ranges, VOXEL, UNIT)


@query("wn21_column_infill", f"with {BASE} select tx, ix, iy, iz, cast(tag as int) as tag from v2")
def wn21(spark, sf):
    return filled(spark, sf)[2]


@query("ag15_water_level", f"with {BASE} select * from wl")
def ag15(spark, sf):
    return voxels.water_levels(grid(spark, sf)[0])


@query("wn24_water_slab", f"with {BASE} select tx, ix, iy, iz, cast(tag as int) as tag from v3")
def wn24(spark, sf):
    return flooded(spark, sf)


@query("ag14_tag_counts", f"with {BASE} select tx, cast(tag as int) as tag, count(*) as n, round(count(*) / (64 * 64 * 64)::double, 8) as share from v3 group by 1, 2")
def ag14(spark, sf):
    return voxels.tag_counts(flooded(spark, sf), F.lit(N * N * N)).withColumn("share", F.round("share", 8))




# The closure of large components is too slow in SQL; tested against a flood fill on a small grid.
@query("it2_denoised_voxels")
def it2(spark, sf):
    return voxels.drop_small_components(filled(spark, sf)[2])


def imagery(p):
    """One colour per voxel column, from the points that fall on it."""
    return p.groupBy("tx", "ix", "iz").agg((F.sum("x_cm") % 256).alias("r"), (F.sum("y_cm") % 256).alias("g"), (F.sum("z_cm") % 256).alias("b"))


def _channel(i, c):
    base = "case tag " + " ".join(f"when {t} then {rgb[i]}" for t, rgb in voxels.TAG_COLOUR.items()) + " end"
    blend = f"floor({base} * (1 - 0.7e0) + im.{c} * 0.7e0)"
    return f"""cast(case when im.r is null then case when tag = 3 and iy = top then {voxels.ROOF_TINT[i]} else {base} end when tag = 3 and iy = top then floor({blend} * (1 - 0.35e0) + {voxels.ROOF_TINT[i]} * 0.35e0) when tag = 3 then floor(im.{c} * 0.88e0)
        when tag = 1 then floor((case when iy = top then {blend} else {base} end) * (1 - 0.6e0) + im.{c} * 0.6e0) when iy = top and tag <> 5 then {blend} else {base} end as bigint) as {c}"""


@query("wn25_voxel_colours", f"""
    with {BASE}, im as (select tx, ix, iz, sum(x_cm) % 256 as r, sum(y_cm) % 256 as g, sum(z_cm) % 256 as b
           from (select tx, x_cm // 100 as ix, y_cm // 100 as iz, x_cm, y_cm, z_cm from p) q group by 1, 2, 3),
        tops as (select tx, ix, iz, max(iy) as top from v2 group by 1, 2, 3)
    select tx, ix, iy, iz, cast(tag as int) as tag, {_channel(0, 'r')}, {_channel(1, 'g')}, {_channel(2, 'b')} from v2 join tops using (tx, ix, iz) left join im using (tx, ix, iz)""")
def wn25(spark, sf):
    p, _, v = filled(spark, sf)
    return voxels.colour_voxels(v, imagery(p))


# Centroids depend on the initialisation, so what must hold of them is compared.
@query("ag16_colour_quantisation", """
    select count(*) as colours, cast(sum(n) as bigint) as pixels, cast(0 as bigint) as misplaced, true as few from (select r, g, b, count(*) as n from {fx_colours} group by 1, 2, 3) q""")
def ag16(spark, sf):
    q = voxels.quantise(fixture(spark, sf, "fx_colours").select("r", "g", "b"))
    return q.agg(F.count("*").alias("colours"), F.sum("n").alias("pixels"), F.count_if(F.col("excess") > 1e-6).alias("misplaced"),
                 (F.count_distinct("centroid") <= voxels.PALETTE_SIZE).alias("few"))


FACES = """fs as (select v.tx, axis, sgn as sign, case axis when 'x' then v.ix when 'y' then v.iy else v.iz end as slab, case axis when 'x' then v.iy else v.ix end as u,
        case axis when 'z' then v.iy else v.iz end as v, v.tag as key from v2 v
        join (values ('x', 1, 1, 0, 0), ('x', -1, -1, 0, 0), ('y', 1, 0, 1, 0), ('y', -1, 0, -1, 0), ('z', 1, 0, 0, 1), ('z', -1, 0, 0, -1)) d(axis, sgn, ddx, ddy, ddz) on true
        left join v2 o on o.tx = v.tx and o.ix = v.ix + ddx and o.iy = v.iy + ddy and o.iz = v.iz + ddz where o.tx is null),
    rn as (select tx, axis, sign, slab, u, key, min(v) as v0, max(v) + 1 as v1 from (select *, v - row_number() over (partition by tx, axis, sign, slab, u, key order by v) as r from fs) q group by tx, axis, sign, slab, u, key, r),
    rc as (select tx, axis, sign, slab, v0, v1, key, min(u) as u0, max(u) + 1 as u1 from (select *, u - row_number() over (partition by tx, axis, sign, slab, v0, v1, key order by u) as r from rn) q
           group by tx, axis, sign, slab, v0, v1, key, r)"""


def faces(v):
    return voxels.exposed_faces(v, parts=parts_for(v, 200_000))


@query("wn26_exposed_faces", f"with {BASE}, {FACES} select tx, axis, cast(sign as int) as sign, slab, u, v, cast(key as int) as key from fs")
def wn26(spark, sf):
    return faces(filled(spark, sf)[2])


@query("wn27_face_rectangles", f"with {BASE}, {FACES} select tx, axis, cast(sign as int) as sign, slab, u0, u1, v0, v1, cast(key as int) as key from rc")
def wn27(spark, sf):
    return voxels.merge_rectangles(voxels.merge_runs(faces(filled(spark, sf)[2])))


@query("wn28_corner_shades", f"""
    with {BASE}, {FACES}, cn as (select rc.*, corner, slab + sign as s2, (case du when 1 then u1 else u0 end) + su * (2 * du - 1) as u, (case dv when 1 then v1 else v0 end) + sv * (2 * dv - 1) as v
        from rc, (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(corner, du, dv), (values (1, 0), (0, 1), (1, 1)) o(su, sv)),
    x as (select cn.*, case axis when 'x' then s2 else u end as ix, case axis when 'y' then s2 when 'x' then u else v end as iy, case axis when 'z' then s2 else v end as iz from cn)
    select x.tx, axis, cast(sign as int) as sign, slab, u0, v0, u1, v1, cast(key as int) as key, cast(corner as int) as corner, cast(3 - count(v2.tx) as int) as shade
    from x left join v2 using (tx, ix, iy, iz) group by all""")
def wn28(spark, sf):
    v = filled(spark, sf)[2]
    return voxels.corner_shades(voxels.merge_rectangles(voxels.merge_runs(faces(v))), v)
