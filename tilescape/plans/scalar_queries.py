"""Queries over the scalar column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import classify, colours, fixedpoint, geo, rings, scatter
from tilescape.functions._base import whole

from .fixtures import fixture, rectangle, spark_table, tag_map
from .registry import query

ORIGIN_LON, ORIGIN_LAT = -122.4, 37.8


def milli(c):
    return F.round(c * 1000).cast("bigint")


def micro(c):
    return F.round(c * 1e6).cast("bigint")


def nodes(spark, sf):
    return fixture(spark, sf, "fx_crossings").select(
        "node_id", fixedpoint.from_e7("lon_e7").alias("lon"), fixedpoint.from_e7("lat_e7").alias("lat"))


NODES = "(select node_id, lon_e7 / 1e7 as lon, lat_e7 / 1e7 as lat from {fx_crossings}) n"
MX = "radians(lon) * 6378137"
MY = "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137"


@query("sc1_mercator", f"""
    select node_id, cast(round({MX} * 1000) as bigint) as x_mm, cast(round({MY} * 1000) as bigint) as y_mm,
           cast(round(lon * 1e7) as bigint) as lon_e7, cast(round(lat * 1e7) as bigint) as lat_e7,
           cast(round(1e6 / cos(radians(lat))) as bigint) as scale_u
    from {NODES}""")
def sc1(spark, sf):
    x, y = geo.mercator_x("lon"), geo.mercator_y("lat")
    return nodes(spark, sf).select("node_id", milli(x).alias("x_mm"), milli(y).alias("y_mm"),
                                   F.round(geo.mercator_lon(x) * 1e7).cast("bigint").alias("lon_e7"),
                                   F.round(geo.mercator_lat(y) * 1e7).cast("bigint").alias("lat_e7"),
                                   micro(geo.mercator_scale("lat")).alias("scale_u"))


@query("sc2_boxes", f"""
    select node_id, cast(round({MX} * 1000) as bigint) as west_mm,
           cast(round(ln(tan(pi() / 4 + radians(lat + 0.01e0) / 2)) * 6378137000) as bigint) as north_mm,
           cast(round(({MX} - 250 / cos(radians(lat))) * 1000) as bigint) as sq_west_mm,
           cast(round(({MY} + 250 / cos(radians(lat))) * 1000) as bigint) as sq_north_mm
    from {NODES}""")
def sc2(spark, sf):
    box = geo.mercator_box("lon", "lat", F.col("lon") + 0.01, F.col("lat") + 0.01)
    square = geo.ground_square("lon", "lat", 500.0)
    return nodes(spark, sf).select("node_id", milli(box["min_x"]).alias("west_mm"), milli(box["max_y"]).alias("north_mm"),
                                   milli(square["min_x"]).alias("sq_west_mm"), milli(square["max_y"]).alias("sq_north_mm"))


@query("sc3_tiles", f"""
    select tx, ty, count(*) as n from (
        select greatest(0, least(16383, cast(floor((lon + 180) / 360 * 16384) as bigint))) as tx,
               greatest(0, least(16383, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) as bigint))) as ty
        from {NODES}) t group by tx, ty""")
def sc3(spark, sf):
    return (nodes(spark, sf).groupBy(geo.tile_x("lon", 14).alias("tx"), geo.tile_y("lat", 14).alias("ty"))
            .agg(F.count("*").alias("n")))


@query("sc4_tile_fraction", f"""
    select node_id, cast(round((lon + 180) / 360 * 4096 * 1e6) as bigint) as fx_u,
           cast(round((0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 4096 * 1e6) as bigint) as fy_u
    from {NODES}""")
def sc4(spark, sf):
    return nodes(spark, sf).select("node_id", micro(geo.tile_frac_x("lon", 12)).alias("fx_u"),
                                   micro(geo.tile_frac_y("lat", 12)).alias("fy_u"))


@query("sc5_tile_bounds", """
    select distinct tx, ty, cast(round((tx / 65536.0 * 360 - 180) * 1e6) as bigint) as west_u,
           cast(round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 65536.0)))) * 1e6) as bigint) as south_u,
           cast(round((-20037508.342789244 + (tx + 1) * (2 * 20037508.342789244 / 65536)) * 1000) as bigint) as east_mm,
           cast(round((20037508.342789244 - ty * (2 * 20037508.342789244 / 65536)) * 1000) as bigint) as north_mm
    from {fx_coverage}""")
def sc5(spark, sf):
    b, m = geo.tile_bounds("tx", "ty", 16), geo.tile_mercator_bounds("tx", "ty", 16)
    return (fixture(spark, sf, "fx_coverage").select("tx", "ty").distinct()
            .select("tx", "ty", micro(b["west"]).alias("west_u"), micro(b["south"]).alias("south_u"),
                    milli(m["max_x"]).alias("east_mm"), milli(m["max_y"]).alias("north_mm")))


COVER = f"""
    select node_id, unnest(generate_series(x0, x1)) as tx, y0, y1 from (
        select node_id, cast(floor((lon + 180) / 360 * 16384) as bigint) as x0,
               cast(floor((lon + 0.03e0 + 180) / 360 * 16384) as bigint) as x1,
               cast(floor((1 - asinh(tan(radians(lat + 0.02e0))) / pi()) / 2 * 16384) as bigint) as y0,
               cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) as bigint) as y1 from {NODES}) b"""


@query("sc6_covering_tiles", f"select node_id, tx, unnest(generate_series(y0, y1)) as ty from ({COVER}) c")
def sc6(spark, sf):
    boxes = nodes(spark, sf).select("node_id", F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"),
                                    (F.col("lon") + 0.03).alias("max_lon"), (F.col("lat") + 0.02).alias("max_lat"))
    return geo.tiles_covering(boxes, 14).select("node_id", "tx", "ty")


@query("sc7_tile_family", """
    with p as (select distinct tx // 16 as px, ty // 16 as py from {fx_coverage}),
         c as (select px, py, px * 16 + a as tx, py * 16 + b as ty from p, range(16) x(a), range(16) y(b))
    select px, py, count(*) as children, sum(tx)::bigint as sum_x, max(ty) as max_y from c group by px, py""")
def sc7(spark, sf):
    parents = (fixture(spark, sf, "fx_coverage")
               .select(geo.tile_parent("tx", 4).alias("px"), geo.tile_parent("ty", 4).alias("py")).distinct())
    return (geo.tile_children(parents, 4, "px", "py").groupBy("px", "py")
            .agg(F.count("*").alias("children"), F.sum("child_x").alias("sum_x"), F.max("child_y").alias("max_y")))


@query("sc8_local_frame", f"""
    select node_id, cast(round((lon + 122.4e0) * 111319.49079327357 * cos(radians(37.8e0)) * 1000) as bigint) as x_mm,
           cast(round((37.8e0 - lat) * 111319.49079327357 * 1000) as bigint) as z_mm,
           cast(round(lon * 1e6) as bigint) as lon_u, cast(round(lat * 1e6) as bigint) as lat_u
    from {NODES}""")
def sc8(spark, sf):
    x, z = geo.enu_x("lon", ORIGIN_LON, ORIGIN_LAT), geo.enu_z("lat", ORIGIN_LAT)
    return nodes(spark, sf).select("node_id", milli(x).alias("x_mm"), milli(z).alias("z_mm"),
                                   micro(geo.enu_lon(x, ORIGIN_LON, ORIGIN_LAT)).alias("lon_u"),
                                   micro(geo.enu_lat(z, ORIGIN_LAT)).alias("lat_u"))


@query("sc9_tile_units", """
    select fid, cast(round((((tx + (u0 + w) / 4096e0) / 16384 * 360 - 180) + 122.4e0) * 111319.49079327357 * cos(radians(37.8e0)) * 1000) as bigint) as x_mm,
           cast(round((37.8e0 - degrees(atan(sinh(pi() * (1 - 2 * (ty + (v0 + h) / 4096e0) / 16384))))) * 111319.49079327357 * 1000) as bigint) as z_mm,
           cast(4 as bigint) as vertices
    from {fx_features}""")
def sc9(spark, sf):
    ring = F.array(*[F.struct((F.col("u0") + a).alias("u"), (F.col("v0") + b).alias("v"))
                     for a, b in ((F.lit(0), F.lit(0)), (F.col("w"), F.lit(0)), (F.col("w"), F.col("h")), (F.lit(0), F.col("h")))])
    out = geo.ring_units_to_enu(ring, "tx", "ty", 14, 4096.0, ORIGIN_LON, ORIGIN_LAT)
    return (fixture(spark, sf, "fx_features").withColumn("ring", out)
            .select("fid", milli(F.col("ring")[2]["x"]).alias("x_mm"), milli(F.col("ring")[2]["z"]).alias("z_mm"),
                    F.size("ring").cast("bigint").alias("vertices")))


@query("sc10_encode", """
    select l_partkey, l_linenumber, count(*) as n,
           cast(min(round_even(l_partkey / 20e0 * 10, 0)) as bigint) as dm,
           cast(min(round_even((l_partkey / 7e0) * 1e7, 0)) as bigint) as e7,
           min(cast(round_even(l_partkey * l_linenumber / 40e0 * 100, 0) as bigint) % 36000) as cdeg
    from lineitem group by l_partkey, l_linenumber""")
def sc10(spark, sf):
    return (spark_table(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber")
            .agg(F.count("*").alias("n"), F.min(fixedpoint.to_dm(F.col("l_partkey") / 20.0)).alias("dm"),
                 F.min(fixedpoint.to_e7(F.col("l_partkey") / 7.0)).alias("e7"),
                 F.min(fixedpoint.to_cdeg(F.col("l_partkey") * F.col("l_linenumber") / 40.0)).alias("cdeg")))


@query("sc11_decode", """
    select node_id, lon_e7 / 1e7 as lon, lat_e7 / 1e7 as lat, node_id / 10e0 as metres, node_id / 100e0 as degrees
    from {fx_crossings}""")
def sc11(spark, sf):
    return fixture(spark, sf, "fx_crossings").select(
        "node_id", fixedpoint.from_e7("lon_e7").alias("lon"), fixedpoint.from_e7("lat_e7").alias("lat"),
        fixedpoint.from_dm("node_id").alias("metres"), fixedpoint.from_cdeg("node_id").alias("degrees"))


@query("sc12_terrarium_encode", """
    with v as (select *, elev_dm / 10e0 - 100 + 32768 as v from {fx_pixels})
    select tx, ty, px, py, cast(floor(v / 256) as bigint) as r, cast(floor(v) as bigint) % 256 as g,
           cast(floor((v - floor(v)) * 256) as bigint) as b from v""")
def sc12(spark, sf):
    rgb = fixedpoint.terrarium_encode(F.col("elev_dm") / 10.0 - 100)
    return (fixture(spark, sf, "fx_pixels").withColumn("c", rgb)
            .select("tx", "ty", "px", "py", "c.r", "c.g", "c.b"))


@query("sc13_terrarium_decode", """
    select tx, ty, px, py, r * 256e0 + g + b / 256e0 - 32768 as elev from {fx_wash}""")
def sc13(spark, sf):
    return fixture(spark, sf, "fx_wash").select("tx", "ty", "px", "py", fixedpoint.terrarium_decode("r", "g", "b").alias("elev"))


@query("sc14_int16_elevation", """
    select tx, ty, count(*) as n, sum(greatest(-32768, least(32767, cast(floor(elev_dm * 1.5e0 * 10 + 0.5) as bigint))))::bigint as total_dm
    from {fx_pixels} group by tx, ty""")
def sc14(spark, sf):
    return (fixture(spark, sf, "fx_pixels").groupBy("tx", "ty")
            .agg(F.count("*").alias("n"), F.sum(fixedpoint.elevation_int16_dm(F.col("elev_dm") * 1.5)).alias("total_dm")))


def road_rings(spark, sf):
    """Road vertices as one array per road; four vertices each, so the group is fixed-size."""
    v = F.struct("seq", F.col("lon_e7").cast("double").alias("x"), F.col("lat_e7").cast("double").alias("y"))
    return (fixture(spark, sf, "fx_roads").groupBy("road_id").agg(F.sort_array(F.collect_list(v)).alias("v"))
            .select("road_id", F.transform("v", lambda p: F.struct(p["x"], p["y"])).alias("ring")))


@query("sc15_ring_area", """
    with e as (select road_id, lon_e7 as x, lat_e7 as y,
                      coalesce(lead(lon_e7) over w, first_value(lon_e7) over w) as nx,
                      coalesce(lead(lat_e7) over w, first_value(lat_e7) over w) as ny
               from {fx_roads} window w as (partition by road_id order by seq))
    select road_id, cast(sum(nx * y - x * ny) as bigint) as signed2, cast(abs(sum(nx * y - x * ny)) as bigint) as area2
    from e group by road_id""")
def sc15(spark, sf):
    return road_rings(spark, sf).select("road_id", F.round(rings.signed_area("ring") * 2).cast("bigint").alias("signed2"),
                                        F.round(rings.ring_area("ring") * 2).cast("bigint").alias("area2"))


@query("sc16_ring_measures", """
    select road_id, cast(round(avg(lon_e7) * 4) as bigint) as cx4, cast(round(avg(lat_e7) * 4) as bigint) as cy4,
           min(lon_e7) as min_x, max(lon_e7) as max_x, min(lat_e7) as min_y, max(lat_e7) as max_y,
           least(max(lon_e7) - min(lon_e7), max(lat_e7) - min(lat_e7)) as short_side
    from {fx_roads} group by road_id""")
def sc16(spark, sf):
    d = road_rings(spark, sf).select("road_id", rings.ring_centroid("ring").alias("c"), rings.ring_bounds("ring").alias("b"))
    big = lambda c: c.cast("bigint")
    return d.select("road_id", F.round(F.col("c.x") * 4).cast("bigint").alias("cx4"), F.round(F.col("c.y") * 4).cast("bigint").alias("cy4"),
                    *[big(F.col(f"b.{n}")).alias(n) for n in ("min_x", "max_x", "min_y", "max_y")],
                    big(rings.short_side(F.col("b"))).alias("short_side"))


@query("sc17_winding", """
    with e as (select road_id, seq, lon_e7 as x, lat_e7 as y,
                      coalesce(lead(lon_e7) over w, first_value(lon_e7) over w) as nx,
                      coalesce(lead(lat_e7) over w, first_value(lat_e7) over w) as ny
               from {fx_roads} window w as (partition by road_id order by seq)),
         a as (select road_id, sum(nx * y - x * ny) as s, max(case when seq = 0 then x end) as x0,
                      max(case when seq = 3 then x end) as x3 from e group by road_id)
    select road_id, case when s < 0 then x3 else x0 end as outer_first, case when s > 0 then x3 else x0 end as hole_first from a""")
def sc17(spark, sf):
    first = lambda r: r[0]["x"].cast("bigint")
    return road_rings(spark, sf).select("road_id", first(rings.wind_outer("ring")).alias("outer_first"),
                                        first(rings.wind_hole("ring")).alias("hole_first"))


def feature_rings(spark, sf):
    """Outer rectangle, a hole half its size, and for one part in three a second outer."""
    u, v, w, h = (F.col(c) for c in ("u0", "v0", "w", "h"))
    outer = rings.ring_of((u, v), (u + w, v), (u + w, v + h), (u, v + h))
    hole = rings.ring_of((u + 10, v + 10), (u + 10, v + 20), (u + 20, v + 20), (u + 20, v + 10))
    second = rings.ring_of((u + w + 5, v), (u + w + 15, v), (u + w + 15, v + 8), (u + w + 5, v + 8))
    parts = (F.when(F.col("parts") == 0, F.array(outer)).when(F.col("parts") == 1, F.array(outer, hole))
             .otherwise(F.array(outer, hole, second)))
    return fixture(spark, sf, "fx_features").withColumn("rings", parts)


@query("sc18_polygon_assembly", """
    select fid, cast(0 as bigint) as polygon_no, cast(case when parts = 0 then 0 else 1 end as bigint) as holes,
           cast(w * h as bigint) as outer_area, cast(case when parts = 0 then 0 else -100 end as bigint) as hole_area from {fx_features}
    union all select fid, 1, 0, 80, 0 from {fx_features} where parts = 2""")
def sc18(spark, sf):
    hole_area = F.aggregate(F.transform("holes", rings.signed_area), F.lit(0.0), lambda a, b: a + b)
    return (rings.explode_polygons(feature_rings(spark, sf))
            .select("fid", F.col("polygon_no").cast("bigint").alias("polygon_no"), F.size("holes").cast("bigint").alias("holes"),
                    rings.signed_area("outer").cast("bigint").alias("outer_area"), hole_area.cast("bigint").alias("hole_area")))


@query("sc19_anchor_owner", """
    select fid from {fx_features} where u0 >= 0 and u0 < 4096 and v0 >= 0 and v0 < 4096""")
def sc19(spark, sf):
    return feature_rings(spark, sf).filter(rings.anchor_in_tile("rings", 4096)).select("fid")


def road_paths(spark, sf):
    return road_rings(spark, sf).select("road_id", F.transform("ring", lambda p: F.struct(
        (p["x"] / 1e7).alias("lon"), (p["y"] / 1e7).alias("lat"))).alias("path"))


BEARING = """select road_id, degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) as d
    from (select road_id, lon_e7 / 1e7 as lon, lat_e7 / 1e7 as lat from {fx_roads} where seq = 0) a
    join (select road_id, lon_e7 / 1e7 as lon, lat_e7 / 1e7 as lat from {fx_roads} where seq = 3) b using (road_id)"""


@query("sc20_way_bearing", f"""
    select road_id, cast(round((d + 360) * 1000) as bigint) % 360000 as mdeg from ({BEARING}) q""")
def sc20(spark, sf):
    return road_paths(spark, sf).select("road_id", (F.round((classify.way_bearing("path") + 360) * 1000).cast("bigint") % 360000).alias("mdeg"))


@query("sc21_compass", f"""
    select road_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(cast(floor(((d + 360) % 360) / 45 + 0.5) as int) % 8) + 1] as label
    from ({BEARING}) q""")
def sc21(spark, sf):
    return road_paths(spark, sf).select("road_id", classify.compass_label(classify.way_bearing("path")).alias("label"))


KIND = """case when footway = 'sidewalk' or (highway = 'footway' and coalesce(footway, '') <> 'crossing') then 'sidewalk'
    when highway = 'path' then 'path' when highway = 'pedestrian' and area = 'yes' then 'plaza'
    when leisure = 'pitch' then 'court' when amenity = 'parking' and coalesce(area, '') <> 'no' then 'parking'
    when natural_ = 'beach' then 'sand' when man_made = 'pier' then 'pier_deck' end"""


@query("sc22_footway_kind", f"select id, {KIND} as kind from {{fx_elements}}")
def sc22(spark, sf):
    return tag_map(fixture(spark, sf, "fx_elements")).select("id", classify.footway_kind("tags").alias("kind"))


def element_paths(spark, sf, deal=lambda df: df):
    """Elements with a four- or five-vertex path; `closed` repeats the first vertex. `deal` may shuffle them before they have one."""
    p = lambda k: F.struct(((F.col("lon_e7") + k * 100) / 1e7).alias("lon"), ((F.col("lat_e7") + (k % 2) * 100) / 1e7).alias("lat"))
    start = [p(0), p(1), p(2), p(3)]
    path = F.when(F.col("closed") == 1, F.array(*start, p(0))).otherwise(F.array(*start))
    return tag_map(deal(fixture(spark, sf, "fx_elements"))).withColumn("geometry", path)


@query("sc23_paint_shape", f"""
    select id, kind, kind in ('plaza', 'court', 'parking', 'sand', 'pier_deck') and closed = 1 as polygon,
           case kind when 'sidewalk' then 3e0 when 'path' then 2e0 when 'pier_deck' then 8e0 else 2e0 end as width_m
    from (select *, {KIND} as kind from {{fx_elements}}) k where kind is not null""")
def sc23(spark, sf):
    return (element_paths(spark, sf).withColumn("kind", classify.footway_kind("tags")).filter("kind is not null")
            .select("id", "kind", classify.painted_as_polygon("kind", "geometry").alias("polygon"),
                    classify.paint_width("kind").alias("width_m")))


HEIGHTS = r"""select fid, area_m2, hide_3d, h, m from (
    select *, greatest(1, least(500, coalesce(try_cast(regexp_extract(render_height, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') as double), 5))) as h,
           try_cast(regexp_extract(render_min_height, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') as double) as m
    from {fx_heights}) q where coalesce(hide_3d, '') not in ('1', 'true') and coalesce(m < h, true)"""


def height_props(spark, sf):
    keys = ("render_height", "render_min_height", "hide_3d")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in keys])
    return (fixture(spark, sf, "fx_heights")
            .withColumn("props", F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))).drop(*keys))


@query("sc24_building_heights", f"""
    select fid, h as height, greatest(0, least(h - 0.5e0, coalesce(m, 0))) as base from ({HEIGHTS}) x""")
def sc24(spark, sf):
    return (height_props(spark, sf).withColumn("hb", classify.building_heights("props")).filter("hb is not null")
            .select("fid", "hb.height", "hb.base"))


@query("sc25_sane_height", f"""
    select fid, case when h > 400 then 5 when h > 150 and area_m2 < 100 then 5
                     when h > 50 and area_m2 > 25000 then least(h, 20) else h end as height from ({HEIGHTS}) x""")
def sc25(spark, sf):
    return (height_props(spark, sf).withColumn("hb", classify.building_heights("props")).filter("hb is not null")
            .select("fid", classify.sane_height("hb.height", "area_m2").alias("height")))


@query("sc26_eave_trust", """
    select rec_id, eave_dm / 10e0 >= 2 and eave_dm / 10e0 >= (rec_id % 50) * 0.4e0 as trusted from {fx_records}""")
def sc26(spark, sf):
    return fixture(spark, sf, "fx_records").select("rec_id", classify.eave_trusted(F.col("eave_dm") / 10.0, (F.col("rec_id") % 50).cast("double")).alias("trusted"))


LABEL = """concat_ws(', ', head, case when city2 <> head or head is null then city2 end)"""
LABELS = f"""select id, query_id, lon, lat, {LABEL} as label from (
    select *, coalesce(housenumber || ' ' || street, street, name) as head, coalesce(city, county) as city2 from {{fx_places}}) q"""


def labelled_places(spark, sf):
    none = F.lit(None).cast("string")
    label = classify.place_label("housenumber", "street", "name", "city", none, none, "county", none)
    return fixture(spark, sf, "fx_places").withColumn("label", label)


@query("sc27_place_label", f"select id, label from ({LABELS}) l")
def sc27(spark, sf):
    return labelled_places(spark, sf).select("id", "label")


def hash_sql(*args: str) -> str:
    h = str(0x811C9DC5)
    for a in args:
        for part in (a, f"({a}) * 1000"):
            h = f"((xor({h}, ({part}) & 4294967295) * 16777619) & 4294967295)"
    return h


@query("sc28_hash32", f"""
    select fid, {hash_sql('x0_cm - 3000', 'y0_cm')} as h from {{fx_footprints}}""")
def sc28(spark, sf):
    return fixture(spark, sf, "fx_footprints").select("fid", colours.hash32(F.col("x0_cm") - 3000, "y0_cm").alias("h"))


def _lin(hex6):
    return colours._linear(hex6)


def _family_sql(channel: int) -> str:
    return "[" + ", ".join(repr(_lin(h)[channel]) for h in colours.ROOF_FAMILY) + "]"


@query("sc29_building_colour", f"""
    with s as (select fid, {hash_sql('x0_cm', 'y0_cm', 'h_cm')} as h from {{fx_footprints}}),
         j as (select fid, h, 1 + (((h >> 5) & 255) / 255e0 - 0.5e0) * 0.12e0 as j, cast(h % 6 as int) + 1 as k from s)
    select fid, cast(round({_family_sql(0)}[k]::double * j * 1e6) as bigint) as r, cast(round({_family_sql(1)}[k]::double * j * 1e6) as bigint) as g,
           cast(round({_family_sql(2)}[k]::double * j * 1e6) as bigint) as b from j""")
def sc29(spark, sf):
    c = colours.building_colour(colours.hash32("x0_cm", "y0_cm", "h_cm"))
    return fixture(spark, sf, "fx_footprints").select("fid", *[micro(c[k]).alias(k) for k in "rgb"])


def _ramp_sql(ch: int) -> str:
    stops = [(h, _lin(c)[ch]) for h, c in colours.TERRAIN_STOPS]
    out = f"case when e <= 0 then {stops[0][1]!r}"
    for (h0, a), (h1, b) in zip(stops, stops[1:]):
        out += f" when e < {h1!r} then {a!r} + ({b!r} - {a!r}) * ((e - {h0!r}) / ({h1!r} - {h0!r}))"
    return f"cast(round(({out} else {stops[-1][1]!r} end) * 1e6) as bigint)"


@query("sc30_terrain_ramp", f"""
    select tx, ty, px, py, {_ramp_sql(0)} as r, {_ramp_sql(1)} as g, {_ramp_sql(2)} as b
    from (select *, elev_dm / 4e0 - 20 as e from {{fx_pixels}}) q""")
def sc30(spark, sf):
    c = colours.terrain_colour(F.col("elev_dm") / 4.0 - 20)
    return fixture(spark, sf, "fx_pixels").select("tx", "ty", "px", "py", *[micro(c[k]).alias(k) for k in "rgb"])


def _case(column: str, table: dict, quote=True) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then " + (f"'{v}'" if quote else f"{v}e0") for k, v in table.items()) + " end"


@query("sc31_ground_classes", f"""
    with f as (select o_orderkey as fid, ['landuse', 'landcover', 'park'][cast(o_orderkey % 3 as int) + 1] as layer,
                      ['residential', 'commercial', 'wood', 'grass', 'sand', 'hospital', 'quarry', 'university'][cast(o_custkey % 8 as int) + 1] as cls,
                      ['motorway', 'minor', 'service', 'ferry', 'aeroway', 'path'][cast(o_custkey % 6 as int) + 1] as road from orders)
    select fid, case layer when 'landuse' then {_case('cls', colours.LANDUSE_COLOUR)} when 'landcover' then {_case('cls', colours.LANDCOVER_COLOUR)} else '93B77A' end as colour,
           case layer when 'landuse' then 0 when 'landcover' then 1 else 2 end as paint_order,
           {_case('road', colours.ROAD_COLOUR)} as road_colour, {_case('road', colours.ROAD_HALF_WIDTH_M, False)} as half_width, road <> 'aeroway' as drawable from f""")
def sc31(spark, sf):
    pick = lambda names, c: F.get(F.array(*[F.lit(n) for n in names]), (F.col(c) % len(names)).cast("int"))
    f = spark_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("fid"), pick(("landuse", "landcover", "park"), "o_orderkey").alias("layer"),
        pick(("residential", "commercial", "wood", "grass", "sand", "hospital", "quarry", "university"), "o_custkey").alias("cls"),
        pick(("motorway", "minor", "service", "ferry", "aeroway", "path"), "o_custkey").alias("road"))
    return f.select("fid", colours.ground_colour("layer", "cls").alias("colour"), colours.paint_order("layer").alias("paint_order"),
                    colours.road_colour("road").alias("road_colour"), colours.road_half_width("road").alias("half_width"),
                    colours.road_drawable("road").alias("drawable"))


@query("sc32_paint_colour", f"""
    select kind, {_case('kind', colours.PAINT_COLOUR)} as colour, count(*) as n
    from (select {KIND} as kind from {{fx_elements}}) k where kind is not null group by kind""")
def sc32(spark, sf):
    return (tag_map(fixture(spark, sf, "fx_elements")).withColumn("kind", classify.footway_kind("tags")).filter("kind is not null")
            .groupBy("kind").agg(F.count("*").alias("n")).withColumn("colour", colours.paint_colour("kind")))


@query("sc33_dream_grade", """
    with p as (select distinct r, g, b from {fx_colours}),
         a as (select *, least(power(r / 255e0, 0.72e0) * 1.06e0 + 0.02e0, 1) as x, power(g / 255e0, 0.72e0) as y, power(b / 255e0, 0.72e0) * 0.94e0 as z from p),
         l as (select *, 0.30e0 * x + 0.59e0 * y + 0.11e0 * z as m from a)
    select r, g, b, greatest(58, cast(floor(greatest(0, least(1, m + 1.18e0 * (x - m))) * 255 + 1e-9) as bigint)) as r2,
           greatest(53, cast(floor(greatest(0, least(1, m + 1.18e0 * (y - m))) * 255 + 1e-9) as bigint)) as g2,
           greatest(48, cast(floor(greatest(0, least(1, m + 1.18e0 * (z - m))) * 255 + 1e-9) as bigint)) as b2 from l""")
def sc33(spark, sf):
    c = colours.dream_grade("r", "g", "b")
    return (fixture(spark, sf, "fx_colours").select("r", "g", "b").distinct()
            .select("r", "g", "b", c["r"].alias("r2"), c["g"].alias("g2"), c["b"].alias("b2")))


@query("sc34_warm_shift", """
    with p as (select distinct r, g, b from {fx_colours}),
         a as (select *, least(round_even(r * 1.06e0 + 5, 0), 255) as x, g as y, round_even(b * 0.94e0, 0) as z from p),
         l as (select *, 0.299e0 * x + 0.587e0 * y + 0.114e0 * z as m from a)
    select r, g, b, cast(greatest(58, least(255, round_even(m + (x - m) * 1.15e0, 0))) as bigint) as r2,
           cast(greatest(53, least(255, round_even(m + (y - m) * 1.15e0, 0))) as bigint) as g2,
           cast(greatest(48, least(255, round_even(m + (z - m) * 1.15e0, 0))) as bigint) as b2 from l""")
def sc34(spark, sf):
    c = colours.warm_shift("r", "g", "b")
    return (fixture(spark, sf, "fx_colours").select("r", "g", "b").distinct()
            .select("r", "g", "b", c["r"].alias("r2"), c["g"].alias("g2"), c["b"].alias("b2")))


@query("sc35_wash_multiplier", """
    select tx, ty, px, py, round(0.6e0 + (r / 255e0) * 0.8e0, 6) as mr, round(0.6e0 + (b / 255e0) * 0.8e0, 6) as mb from {fx_wash}""")
def sc35(spark, sf):
    return fixture(spark, sf, "fx_wash").select("tx", "ty", "px", "py", F.round(colours.wash_multiplier("r"), 6).alias("mr"),
                                                F.round(colours.wash_multiplier("b"), 6).alias("mb"))


@query("sc36_octree_cells", """
    with n as (select distinct 4 as d, x_cm // 400 as nx, y_cm // 400 as ny, z_cm // 400 as nz from {fx_points})
    select nx, ny, nz, nx * 400 as min_x, (ny + 1) * 400 as max_y,
           nx * 400 <= 2000 and (nx + 1) * 400 >= 900 and ny * 400 <= 3300 and (ny + 1) * 400 >= 1000 as touches from n""")
def sc36(spark, sf):
    cells = (fixture(spark, sf, "fx_points")
             .select(F.lit(4).alias("d"), *[F.expr(f"{a}_cm div 400").alias(f"n{a}") for a in "xyz"]).distinct())
    window = F.struct(*[F.lit(v).alias(n) for v, n in ((900.0, "min_x"), (1000.0, "min_y"), (2000.0, "max_x"), (3300.0, "max_y"))])
    b = geo.octree_bounds("d", "nx", "ny", "nz", (0, 0, 0, 6400, 6400, 6400))
    return cells.select("nx", "ny", "nz", b["min_x"].cast("bigint").alias("min_x"), b["max_y"].cast("bigint").alias("max_y"),
                        geo.boxes_touch_xy(b, window).alias("touches"))


@query("sc37_detail_tier", """
    select seq, least(2, (case when d <= 1 then 0 when d <= 3 then 1 else 2 end) + (case when speed_c > 400 then 1 else 0 end)) as tier,
           least(2, (case when d <= 1 then 0 when d <= 3 then 1 else 2 end) + (case when speed_c > 400 then 1 else 0 end)) < 1 as visible
    from (select *, greatest(abs(x_m // 500 - 4), abs(z_m // 500 - 4)) as d from {fx_poses}) q""")
def sc37(spark, sf):
    tier = classify.detail_tier(F.expr("x_m div 500"), F.expr("z_m div 500"), F.lit(4), F.lit(4), "speed_c")
    return fixture(spark, sf, "fx_poses").select("seq", tier.alias("tier"), classify.layer_visible(tier, F.lit(1)).alias("visible"))


@query("sc38_pin_label_height", """
    select pin_id, round(greatest(5, least(175, x_m * 0.042e0)) * case tier when 1 then 1.5e0 when 2 then 1e0 else 0.78e0 end, 6) as h from {fx_pins}""")
def sc38(spark, sf):
    return fixture(spark, sf, "fx_pins").select("pin_id", F.round(classify.pin_label_height("x_m", "tier"), 6).alias("h"))


@query("sc39_map_fraction", f"""
    select node_id, cast(round((lon + 123.1e0) / 1.5e0 * 1e6) as bigint) as fx, cast(round((38.2e0 - lat) / 1e0 * 1e6) as bigint) as fy from {NODES}""")
def sc39(spark, sf):
    return nodes(spark, sf).select("node_id", micro(geo.map_fraction_x("lon", -123.1, -121.6)).alias("fx"),
                                   micro(geo.map_fraction_y("lat", 37.2, 38.2)).alias("fy"))


@query("sc40_angles", """
    with a as (select seq, x_m / 100e0 - 20 as a, z_m / 100e0 - 20 as b, speed_c % 100 / 100e0 as t from {fx_poses}),
         d as (select *, fmod(b - a, 2 * pi()) as d from a)
    select seq, round(sin(a), 6) as hx, round(-cos(a), 6) as hz,
           round(a + t * case when d > pi() then d - 2 * pi() when d < -pi() then d + 2 * pi() else d end, 6) as blended,
           round(fmod(fmod(a + pi(), 2 * pi()) + 2 * pi(), 2 * pi()) - pi(), 6) as wrapped from d""")
def sc40(spark, sf):
    d = fixture(spark, sf, "fx_poses").select("seq", (F.col("x_m") / 100.0 - 20).alias("a"), (F.col("z_m") / 100.0 - 20).alias("b"),
                                              (F.col("speed_c") % 100 / 100.0).alias("t"))
    return d.select("seq", F.round(classify.heading_x("a"), 6).alias("hx"), F.round(classify.heading_z("a"), 6).alias("hz"),
                    F.round(classify.blend_angle("a", "b", "t"), 6).alias("blended"), F.round(classify.wrap_angle("a"), 6).alias("wrapped"))


def step_sql(s: str) -> str:
    return f"cast((cast({s} as hugeint) * 668265261 + 2654435769) % 4294967296 as bigint)"


@query("sc41_seed_sequence", f"""
    with recursive r as (select fid, cast(0 as bigint) as k, cast(x0_cm * 100000 as bigint) as s from {{fx_footprints}}
        union all select fid, k + 1, {step_sql('s')} from r where k < 8)
    select fid, k, s from r where k > 0""")
def sc41(spark, sf):
    return (fixture(spark, sf, "fx_footprints")
            .select("fid", F.posexplode(scatter.seed_sequence(F.col("x0_cm") * 100000, 8)).alias("k", "s"))
            .select("fid", (F.col("k") + 1).cast("bigint").alias("k"), "s"))


@query("sc42_tree_instances", f"""
    with a as (select fid, h_cm / 100e0 as metres, {step_sql(step_sql('x0_cm * 100000'))} as s from {{fx_footprints}})
    select fid, greatest(0.4e0, least(3.2e0, metres / 4.4e0)) as scale, s & 255 < 100 as conifer,
           round(s / 4294967296e0 * 2 * pi(), 6) as yaw, round(((s >> 8) / 16777216e0 - 0.5e0) * 0.14e0, 6) as tint from a""")
def sc42(spark, sf):
    d = fixture(spark, sf, "fx_footprints").withColumn("s", scatter.next_seed(scatter.next_seed(F.col("x0_cm") * 100000)))
    return d.select("fid", scatter.instance_scale(F.col("h_cm") / 100.0).alias("scale"), scatter.is_conifer("s").alias("conifer"),
                    F.round(scatter.instance_yaw("s"), 6).alias("yaw"), F.round(scatter.instance_tint("s"), 6).alias("tint"))


@query("sc43_heading_speed", """
    select seq, round(fmod(fmod(degrees(x_m / 100e0 - 20), 360) + 360, 360), 6) as heading, round(speed_c / 100e0 * 3.6e0, 6) as kmh from {fx_poses}""")
def sc43(spark, sf):
    return fixture(spark, sf, "fx_poses").select("seq", F.round(classify.yaw_to_compass(F.col("x_m") / 100.0 - 20), 6).alias("heading"),
                                                 F.round(classify.kmh(F.col("speed_c") / 100.0), 6).alias("kmh"))
