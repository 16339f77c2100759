"""Queries over places, painted ground, documents, nodes and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilescape import sinks, sources
from tilescape.functions import classify
from tilescape.operators import graph, paint, places, qa, raster
from tilescape.session import checkpoint_dir, cut

from .fixtures import fixture, parts_for, spark_table, tag_map
from .registry import query
from .scalar_queries import KIND, LABELS, element_paths, labelled_places

RANGES = "case tier when 1 then 5200 when 2 then 1900 else 750 end"


# -- Places -------------------------------------------------------------------

NEAREST = f"""with d as (select seq, pin_id, (p.x_m - q.x_m) ** 2 + (p.z_m - q.z_m) ** 2 as d2, tier from {{fx_view_poses}} q join {{fx_view_pins}} p on abs(p.x_m - q.x_m) <= 5200),
         r as (select seq, pin_id, d2, row_number() over (partition by seq order by d2, pin_id) as rank from d where d2 <= ({RANGES}) ** 2)"""


def nearest_pins(spark, sf):
    return places.nearest_pins(fixture(spark, sf, "fx_view_poses"), fixture(spark, sf, "fx_view_pins"), "seq", "pin_id", "x_m", "z_m")


@query("jn17_pins_in_view", f"{NEAREST} select seq, pin_id, cast(d2 as bigint) as d2 from r where rank <= 48")
def jn17(spark, sf):
    return nearest_pins(spark, sf).select("seq", "pin_id", F.col("d2").cast("bigint").alias("d2"))


@query("tk1_nearest_pins", f"{NEAREST} select seq, pin_id, cast(rank as int) as rank from r where rank <= 48")
def tk1(spark, sf):
    return nearest_pins(spark, sf).select("seq", "pin_id", "rank")


@query("jn18_nearest_preset", """
    with d as (select seq, pin_id, sqrt((p.x_m - q.x_m) ** 2 + (p.z_m - q.z_m) ** 2) as d from {fx_view_poses} q join {fx_view_pins} p on true),
         b as (select seq, min(row(d, pin_id)) as b from d where d < 400 group by 1)
    select seq, b[2] as pin_id, round(b[1], 6) as distance from b""")
def jn18(spark, sf):
    xy = {"x_m": "x", "z_m": "y"}
    out = places.nearest_within(fixture(spark, sf, "fx_view_poses").withColumnsRenamed(xy), fixture(spark, sf, "fx_view_pins").withColumnsRenamed(xy), "seq", "pin_id", 400.0)
    return out.withColumn("distance", F.round("distance", 6))


@query("fl11_search_box", "select id from {fx_places} where lon between -123.1e0 and -121.6e0 and lat between 37.2e0 and 38.2e0")
def fl11(spark, sf):
    return places.in_bounds(fixture(spark, sf, "fx_places"), "query_id").select("id")


@query("wn32_first_per_label", f"select query_id, label, min(id) as id from ({LABELS}) l group by 1, 2")
def wn32(spark, sf):
    return places.first_per_label(labelled_places(spark, sf).select("query_id", "label", "id"), "query_id", "label", "id")


@query("tk2_first_results", "select query_id, id from (select *, row_number() over (partition by query_id order by id) as rn from {fx_places}) q where rn <= 5")
def tk2(spark, sf):
    return places.first_k(fixture(spark, sf, "fx_places"), "query_id", "id", 5).select("query_id", "id")


# -- Painted ground -----------------------------------------------------------

@query("fl5_marked_crossings", """
    select id from {fx_elements} where type = 'node' and (highway = 'crossing' or crossing is not null) and coalesce(crossing, '') not in ('unmarked', 'no')""")
def fl5(spark, sf):
    return paint.crossings(element_paths(spark, sf)).select("id")


@query("fl7_usable_paint", """
    select 'ribbon' as part, count(*) as n from {fx_elements} where closed = 0 and lon_e7 % 7 > 0 union all
    select 'decal', count(*) from {fx_elements} where lat_e7 % 5 > 0 and lon_e7 % 3 <> 0 union all select 'polygon', count(*) from {fx_elements} where closed = 1""")
def fl7(spark, sf):
    e = element_paths(spark, sf)
    short = e.withColumns({"width_dm": F.abs(F.expr("cast(round(geometry[0].lon * 1e7) as bigint)")) % 7 * -1,
                           "path": F.when(F.col("closed") == 0, F.col("geometry")).otherwise(F.slice("geometry", 1, 1))})
    short = short.withColumn("width_dm", F.expr("cast(round(geometry[0].lon * 1e7) as bigint) % 7"))
    decal = e.select(F.when(F.expr("cast(round(geometry[0].lon * 1e7) as bigint) % 3") != 0, 5).alias("bearing_cdeg"),
                     F.expr("cast(round(geometry[0].lat * 1e7) as bigint) % 5").alias("len_dm"), F.lit(4).alias("width_dm"))
    ring = e.withColumn("ring", F.when(F.col("closed") == 1, F.col("geometry")).otherwise(F.slice("geometry", 1, 2)))
    tally = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return (tally(paint.usable_ribbons(short), "ribbon").unionByName(tally(paint.usable_decals(decal), "decal"))
            .unionByName(tally(paint.usable_polygons(ring), "polygon")))


WAY = """(footway = 'sidewalk' or highway in ('footway', 'path', 'pedestrian', 'residential') or leisure = 'pitch' or (amenity = 'parking' and coalesce(area, '') <> 'no')
    or natural_ = 'beach' or man_made = 'pier')"""


@query("fl10_element_selection", f"""
    select id, 'paint' as use from {{fx_elements}} where ((type = 'way' and coalesce({WAY}, false)) or (type = 'node' and (highway = 'crossing' or crossing in ('zebra', 'marked', 'unmarked'))))
    union all select id, 'building' from {{fx_elements}} where type <> 'node' and building is not null""")
def fl10(spark, sf):
    e = element_paths(spark, sf)
    world = (-90, -180, 90, 180)
    return (paint.select_elements(e, world).select("id", F.lit("paint").alias("use"))
            .unionByName(paint.select_elements(e, world, buildings=True).select("id", F.lit("building").alias("use"))))


TILE14 = """greatest(0, least(16383, cast(floor((lon_e7 / 1e7 + 180) / 360 * 16384) as bigint))) as tx,
    greatest(0, least(16383, cast(floor((1 - asinh(tan(radians(lat_e7 / 1e7))) / pi()) / 2 * 16384) as bigint))) as ty"""


@query("st4_owner_tile", f"""
    select kind, tx, ty, count(*) as n from (select {KIND} as kind, {TILE14} from {{fx_elements}} where type = 'way') q where kind is not null group by 1, 2, 3""")
def st4(spark, sf):
    return paint.owner_tile(paint.way_features(element_paths(spark, sf))).groupBy("kind", "tx", "ty").agg(F.count("*").alias("n"))


@query("paint_crosswalk_decals", f"""
    with r as (select id, k as seg, (lon_e7 + k * 100) / 1e7 as ax, (lat_e7 + k % 2 * 100) / 1e7 as ay, (lon_e7 + (k + 1) % (case when closed = 1 then 4 else 9 end) * 100) / 1e7 as bx,
                      (lat_e7 + (k + 1) % (case when closed = 1 then 4 else 9 end) % 2 * 100) / 1e7 as by_ from {{fx_elements}}, (select unnest([0, 1, 2, 3]) as k) kk
               where type = 'way' and highway = 'residential' and k < 3 + closed),
         n as (select id, lon_e7 / 1e7 as lon, lat_e7 / 1e7 as lat from {{fx_elements}} where type = 'node' and (highway = 'crossing' or crossing is not null) and coalesce(crossing, '') not in ('unmarked', 'no')),
         t as (select n.id as node, lon, lat, r.*, bx - ax as vx, by_ - ay as vy from n cross join r where r.id <> n.id),
         p as (select *, greatest(0, least(1, ((lon - ax) * vx + (lat - ay) * vy) / (vx * vx + vy * vy))) as t from t),
         d as (select node, min(sqrt(((ax + t * vx - lon) * cos(radians(lat))) ** 2 + (ay + t * vy - lat) ** 2)) as d from p group by 1)
    select count(*) as n, round(sum(d), 6) as total from d""")
def decals(spark, sf):
    from tilescape.operators import lines
    e = element_paths(spark, sf)
    out = lines.nearest_road_bearing(paint.crossings(e), paint.roads(e), "id", "road_id")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("total"))


# -- Documents ----------------------------------------------------------------

def small_trees(spark, sf):
    """Tree rows in tiles of 50 records."""
    return fixture(spark, sf, "fx_records").select(F.expr("rec_id div 50").alias("tx"), (F.col("tx") - 2616).alias("ty"), F.col("x_cm").alias("lon_e7"),
                                                   F.col("y_cm").alias("lat_e7"), F.col("eave_dm").alias("height_dm"), F.col("shape").cast("bigint").alias("crown_dm"))


TREE_ROWS = "select rec_id // 50 as tx, tx - 2616 as ty, x_cm as a, y_cm as b, eave_dm as c, cast(shape as bigint) as d from {fx_records}"


@query("snk1_tree_documents", f"""
    with t as ({TREE_ROWS}), w as (select distinct p_partkey // 40 as tx, p_partkey // 500 as ty from part),
         j as (select tx, ty, '{{"trees":[' || string_agg('[' || a || ',' || b || ',' || c || ',' || d || ']', ',' order by a, b, c, d) || ']}}' as json, count(*) as n from t group by 1, 2)
    select w.tx, w.ty, coalesce(json, '{{"trees":[]}}') as json, cast(coalesce(n, 0) as int) as n from w left join j using (tx, ty)""")
def snk1(spark, sf):
    wanted = spark_table(spark, sf, "part").select(F.expr("p_partkey div 40").alias("tx"), F.expr("p_partkey div 500").alias("ty")).distinct()
    return sinks.tree_documents(small_trees(spark, sf), wanted).select("tx", "ty", "json", "n")


@query("snk1_crowded_tile_parts", f"""
    select tx - 2616 as tx, count(*) as entries, cast(4 as bigint) as parts from {{fx_records}} group by 1""")
def snk1_parts(spark, sf):
    """Crowded tiles written in four documents that together hold every entry."""
    rows = fixture(spark, sf, "fx_records").select((F.col("tx") - 2616).alias("tx"), F.lit(0).alias("ty"), F.col("x_cm").alias("lon_e7"), F.col("y_cm").alias("lat_e7"),
                                                   F.col("eave_dm").alias("height_dm"), F.col("shape").cast("bigint").alias("crown_dm"))
    docs = sinks.tree_documents(rows, buckets=4)
    return docs.groupBy("tx").agg(F.sum("n").alias("entries"), F.count("*").alias("parts"))


ROOF_JSON = """'{"at":[' || x_cm || ',' || y_cm || '],"shape":' || shape || ',"eave_dm":' || eave_dm || ',"rise_dm":' || rec_id % 9 || ',"ridge_cdeg":' || rec_id * 7 % 36000 || '}'"""


def small_roofs(spark, sf):
    return fixture(spark, sf, "fx_records").select(F.expr("rec_id div 50").alias("tx"), (F.col("tx") - 2616).alias("ty"), F.col("x_cm").alias("lon_e7"), F.col("y_cm").alias("lat_e7"),
                                                   "shape", "eave_dm", (F.col("rec_id") % 9).alias("rise_dm"), (F.col("rec_id") * 7 % 36000).alias("ridge_cdeg"))


@query("snk3_roof_documents", f"""
    select rec_id // 50 as tx, tx - 2616 as ty, '{{{{"roofs":[' || string_agg({ROOF_JSON}, ',' order by x_cm, y_cm, shape, eave_dm, rec_id % 9, rec_id * 7 % 36000) || ']}}}}' as json, cast(count(*) as int) as n
    from {{fx_records}} group by 1, 2""".replace("{{", "{").replace("}}", "}"))
def snk3(spark, sf):
    return sinks.roof_documents(small_roofs(spark, sf)).select("tx", "ty", "json", "n")


def path_sql():
    point = lambda k: f"'[' || lon_e7 + {k * 100} || ',' || lat_e7 + {k % 2 * 100} || ']'"
    return "'[' || " + " || ',' || ".join(point(k) for k in range(4)) + f" || case when closed = 1 then ',' || {point(0)} else '' end || ']'"


@query("snk2_paint_documents", f"""
    with e as (select *, {KIND} as kind, {TILE14} from {{fx_elements}}),
         w as (select *, kind in ('plaza', 'court', 'parking', 'sand', 'pier_deck') and closed = 1 as polygon, case kind when 'sidewalk' then 30 when 'pier_deck' then 80 else 20 end as width from e where type = 'way' and kind is not null),
         r as (select tx, ty, string_agg('{{"kind":"' || kind || '","width_dm":' || width || ',"path":' || {path_sql()} || '}}', ',' order by kind, width, lon_e7, lat_e7, closed) as s, count(*) as n from w where not polygon group by 1, 2),
         p as (select tx, ty, string_agg('{{"kind":"' || kind || '","ring":' || {path_sql()} || '}}', ',' order by kind, lon_e7, lat_e7, closed) as s, count(*) as n from w where polygon group by 1, 2),
         d as (select tx, ty, string_agg('{{"kind":"crosswalk","at":[' || lon_e7 || ',' || lat_e7 || '],"bearing_cdeg":1234,"len_dm":120,"width_dm":50}}', ',' order by lon_e7, lat_e7) as s, count(*) as n from e
               where type = 'node' and (highway = 'crossing' or crossing is not null) and coalesce(crossing, '') not in ('unmarked', 'no') group by 1, 2)
    select tx, ty, '{{"ribbons":[' || coalesce(r.s, '') || '],"polygons":[' || coalesce(p.s, '') || '],"decals":[' || coalesce(d.s, '') || ']}}' as json,
           cast(coalesce(r.n, 0) + coalesce(p.n, 0) + coalesce(d.n, 0) as int) as n from r full join p using (tx, ty) full join d using (tx, ty)""")
def snk2(spark, sf):
    return all_paint(spark, sf).select("tx", "ty", "json", "n")


def all_paint(spark, sf):
    e = element_paths(spark, sf)
    ways = paint.owner_tile(paint.way_features(e))
    nodes = paint.crossings(e).withColumns({"kind": F.lit("crosswalk"), "bearing_deg": F.lit(12.34), "path": F.array(F.struct("lon", "lat"))})
    return sinks.paint_documents(ways.filter("not polygon"), ways.filter("polygon"), paint.owner_tile(nodes))


@query("snk4_terrain_rows", """
    select tx, ty, px, py, cast(floor((elev_dm / 10e0 + 32768) / 256) as bigint) as r, cast(floor(elev_dm / 10e0 + 32768) as bigint) % 256 as g,
           cast(floor((elev_dm / 10e0 + 32768 - floor(elev_dm / 10e0 + 32768)) * 256) as bigint) as b from {fx_pixels}""")
def snk4(spark, sf):
    pixels = fixture(spark, sf, "fx_pixels").select("tx", "ty", F.col("px").alias("cx"), F.col("py").alias("cy"), (F.col("elev_dm") / 10.0).alias("elev"))
    return sinks.terrain_rows(pixels, tile=("tx", "ty"))


MANIFEST = """select layer, '{"zoom":' || case layer when 'terrain' then 16 else 14 end || ',"tiles":[' || string_agg('"' || tx || '/' || ty || '"', ',' order by tx || '/' || ty) || ']}' as json
    from {fx_coverage} group by 1"""


def asset_paths(spark, sf):
    c = fixture(spark, sf, "fx_coverage")
    zoom = F.when(F.col("layer") == "terrain", "16").otherwise("14")
    return c.select(F.concat_ws("/", F.lit("root"), "layer", zoom, "tx", F.concat(F.col("ty").cast("string"), F.lit(".json"))).alias("path"))


@query("snk5_manifest", MANIFEST)
def snk5(spark, sf):
    return sinks.manifest_entries(sinks.coverage_of_paths(asset_paths(spark, sf)))


@query("tk3_sorted_manifest_keys", """
    select layer, min(tx || '/' || ty) as first_key, max(tx || '/' || ty) as last_key, count(*) as n from {fx_coverage} group by 1""")
def tk3(spark, sf):
    return sinks.manifest_key_range(sinks.coverage_of_paths(asset_paths(spark, sf)))


@query("snk5_manifest_lines", """
    with t as (select distinct layer, case layer when 'terrain' then 16 else 14 end as zoom, tx, ty from {fx_coverage}),
         a as (select layer, zoom, zoom - 6 as level, tx // 64 as px, ty // 64 as py, count(*) as n, string_agg('"' || tx || '/' || ty || '"', ',' order by tx || '/' || ty) as s from t group by 1, 2, 3, 4, 5),
         b as (select layer, zoom, level - 6 as level, px // 64 as px, py // 64 as py, sum(n)::bigint as n, string_agg('"' || level || '/' || px || '/' || py || '"', ',' order by level || '/' || px || '/' || py) as s from a group by 1, 2, 3, 4, 5),
         c as (select layer, zoom, 0 as level, px // (1 << level) as px, py // (1 << level) as py, sum(n)::bigint as n, string_agg('"' || level || '/' || px || '/' || py || '"', ',' order by level || '/' || px || '/' || py) as s from b group by 1, 2, 3, 4, 5),
         u as (select *, 'tiles' as what from a union all select *, 'parts' from b union all select *, 'parts' from c)
    select layer, zoom, level, px, py, n, '{"layer":"' || layer || '","zoom":' || zoom || ',"level":' || level || ',"parent":"' || px || '/' || py || '","n":' || n || ',"' || what || '":[' || s || ']}' as json from u""")
def snk5_lines(spark, sf):
    return sinks.manifest_lines(sinks.coverage_of_paths(asset_paths(spark, sf)))


@query("src7_manifest_lines", "select layer, tx, ty from {fx_coverage}")
def src7_lines(spark, sf):
    folder = new_folder(spark, "manifest")
    sinks.write_manifest_lines(sinks.coverage_of_paths(asset_paths(spark, sf)), folder)
    return sources.coverage_rows(sources.read_manifest_lines(spark, folder))


@query("ag19_tile_totals", f"""
    with t as ({TREE_ROWS}), j as (select tx, ty, 11 + sum(length('[' || a || ',' || b || ',' || c || ',' || d || ']')) + count(*) - 1 + 1 as bytes, count(*) as n from t group by 1, 2)
    select 'trees' as layer, ty, count(*) as documents, sum(n)::bigint as features, sum(bytes)::bigint as bytes from j group by 2""".replace("11 +", "10 +").replace("- 1 + 1", "- 1 + 2"))
def ag19(spark, sf):
    docs = sinks.tree_documents(small_trees(spark, sf)).withColumn("layer", F.lit("trees"))
    return qa.tile_totals(docs, ["ty"])


# -- Readers over derived documents -------------------------------------------

def text_docs(docs, layer):
    """Documents as (path, value) rows; one tile in four is damaged."""
    bad = F.col("tx") % 4 == 1
    damaged = F.when(bad, F.replace("json", F.lit('":[['), F.lit('":[["x",'))).otherwise(F.col("json"))
    damaged = F.when(bad, F.replace(damaged, F.lit('"shape":1'), F.lit('"shape":7'))).otherwise(damaged)
    return docs.select(F.format_string(f"/data/{layer}/14/%d/%d.json", "tx", "ty").alias("path"), damaged.alias("value"))


@query("src4_tree_rows", f"select tx, ty, a as lon_e7, b as lat_e7, c as height_dm, d as crown_dm from ({TREE_ROWS}) t where tx % 4 <> 1")
def src4(spark, sf):
    return sources.tree_rows(text_docs(sinks.tree_documents(small_trees(spark, sf)), "trees"))


@query("src4_rejected_trees", f"select distinct '/data/trees/14/' || tx || '/' || ty || '.json' as path, tx, ty from ({TREE_ROWS}) t where tx % 4 = 1")
def src4_bad(spark, sf):
    return sources.rejected_trees(text_docs(sinks.tree_documents(small_trees(spark, sf)), "trees"))


@query("src6_roof_rows", """
    with r as (select rec_id // 50 as tx, tx - 2616 as ty, x_cm as lon_e7, y_cm as lat_e7, shape, eave_dm, rec_id % 9 as rise_dm, rec_id * 7 % 36000 as ridge_cdeg from {fx_records}),
         bad as (select distinct tx, ty from r where tx % 4 = 1 and shape = 1)
    select r.* from r left join bad using (tx, ty) where bad.tx is null""")
def src6(spark, sf):
    return sources.roof_rows(text_docs(sinks.roof_documents(small_roofs(spark, sf)), "roofs"))


@query("src6_rejected_roofs", """
    select distinct '/data/roofs/14/' || rec_id // 50 || '/' || tx - 2616 || '.json' as path, 'unexpected shape' as reason from {fx_records} where rec_id // 50 % 4 = 1 and shape = 1""")
def src6_bad(spark, sf):
    return sources.rejected(text_docs(sinks.roof_documents(small_roofs(spark, sf)), "roofs"), "roofs")


@query("src5_paint_parts", f"""
    with e as (select *, {KIND} as kind, {TILE14} from {{fx_elements}}),
         w as (select tx, ty, kind, closed, kind in ('plaza', 'court', 'parking', 'sand', 'pier_deck') and closed = 1 as polygon from e where type = 'way' and kind is not null)
    select tx, ty, case when polygon then 'polygons' else 'ribbons' end as part, kind, cast(4 + closed as bigint) as vertices, count(*) as n from w group by 1, 2, 3, 4, 5
    union all select tx, ty, 'decals', 'crosswalk', 1, count(*) from e
    where type = 'node' and (highway = 'crossing' or crossing is not null) and coalesce(crossing, '') not in ('unmarked', 'no') group by 1, 2""")
def src5(spark, sf):
    docs = all_paint(spark, sf)
    # A missing list is fine.
    text = docs.select(F.format_string("/data/paint/14/%d/%d.json", "tx", "ty").alias("path"), F.replace("json", F.lit(',"decals":[]'), F.lit("")).alias("value"))
    out = None
    for name, rows in sources.paint_parts(text).items():
        size = F.lit(1).cast("bigint") if name == "decals" else F.size("ring" if name == "polygons" else "path").cast("bigint")
        part = rows.groupBy("tx", "ty", F.lit(name).alias("part"), "kind", size.alias("vertices")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def new_folder(spark, name):
    """A folder for one run, shared by all executors."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src4_tile_folders", f"select tx, ty, a as lon_e7, b as lat_e7, c as height_dm, d as crown_dm from ({TREE_ROWS}) t")
def src4_folders(spark, sf):
    """Written tree documents in three parts, read from their folders."""
    folder = new_folder(spark, "trees")
    sinks.write_documents(sinks.tree_documents(small_trees(spark, sf), buckets=3), folder, layer="trees", zoom=14)
    return sources.tree_rows(sources.read_tiles(spark, folder))


@query("src6_tile_folders", """
    select rec_id // 50 as tx, tx - 2616 as ty, x_cm as lon_e7, y_cm as lat_e7, shape, eave_dm, rec_id % 9 as rise_dm, rec_id * 7 % 36000 as ridge_cdeg from {fx_records} where rec_id // 50 between 3 and 17""")
def src6_folders(spark, sf):
    """Written roof documents in two parts; a range of tiles is picked by folders."""
    folder = new_folder(spark, "roofs")
    sinks.write_documents(sinks.roof_documents(small_roofs(spark, sf), buckets=2), folder, layer="roofs", zoom=14)
    return sources.roof_rows(sources.read_tiles(spark, folder).filter("layer = 'roofs' and zoom = 14 and tx between 3 and 17"))


@query("src5_tile_folders", f"""
    with e as (select *, {KIND} as kind, {TILE14} from {{fx_elements}}),
         w as (select tx, ty, kind, closed, kind in ('plaza', 'court', 'parking', 'sand', 'pier_deck') and closed = 1 as polygon from e where type = 'way' and kind is not null)
    select tx, ty, case when polygon then 'polygons' else 'ribbons' end as part, kind, count(*) as n from w group by 1, 2, 3, 4
    union all select tx, ty, 'decals', 'crosswalk', count(*) from e
    where type = 'node' and (highway = 'crossing' or crossing is not null) and coalesce(crossing, '') not in ('unmarked', 'no') group by 1, 2""")
def src5_folders(spark, sf):
    """Written paint documents, read from their folders."""
    folder = new_folder(spark, "paint")
    sinks.write_documents(all_paint(spark, sf), folder, layer="paint", zoom=14)
    parts = sources.paint_parts(sources.read_tiles(spark, folder)).items()
    counted = [rows.groupBy("tx", "ty", F.lit(name).alias("part"), "kind").agg(F.count("*").alias("n")) for name, rows in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("src7_coverage_rows", "select layer, tx, ty from {fx_coverage}")
def src7(spark, sf):
    doc = sinks.manifest_json(sinks.coverage_of_paths(asset_paths(spark, sf))).select(F.lit("manifest.json").alias("path"), F.col("json").alias("value"))
    return sources.coverage_rows(doc)


@query("src2_element_rows", "select type, id, highway, closed from {fx_elements}")
def src2(spark, sf):
    return element_facts(elements_again(spark, sf))


def element_documents(spark, sf, size, parts=None):
    """(doc, value): elements as documents of so many ids. With `parts`, rows are dealt by document to so many tasks before they have paths."""
    doc = F.expr(f"id div {size}")
    e = element_paths(spark, sf, lambda df: df.repartition(parts, doc) if parts else df)
    members = F.array(F.struct(F.lit("way").alias("type"), F.lit("outer").alias("role"), F.col("geometry")), F.struct(F.lit("way").alias("type"), F.lit("inner").alias("role"), F.col("geometry")))
    one = F.struct("type", "id", F.col("geometry")[0]["lon"].alias("lon"), F.col("geometry")[0]["lat"].alias("lat"), "tags", "geometry", members.alias("members"))
    return e.groupBy(doc.alias("doc")).agg(F.to_json(F.struct(F.collect_list(one).alias("elements"))).alias("value"))


def elements_again(spark, sf):
    """Elements written as documents of fifty and read back."""
    return sources.element_rows(element_documents(spark, sf, 50).select(F.col("doc").cast("string").alias("path"), "value"))


def element_facts(elements):
    return elements.select("type", "id", F.element_at("tags", F.lit("highway")).alias("highway"),
                           F.when(F.col("type") == "node", F.col("id") % 2).otherwise((F.size("geometry") == 5).cast("bigint")).alias("closed"))


@query("src2_split_extracts", "select type, id, highway, closed from {fx_elements}")
def src2_split(spark, sf):
    """Extracts of 5,000 ids, one file each; members of relations begin like elements do."""
    folder = new_folder(spark, "extracts")
    element_documents(spark, sf, 5000, parts_for(spark_table(spark, sf, "orders"))).write.partitionBy("doc").text(folder)
    return element_facts(sources.read_elements(spark, folder)[0])


@query("src3_building_rings", "select id, count(*) as n from {fx_elements} where type <> 'node' group by 1")
def src3(spark, sf):
    return sources.building_rings(elements_again(spark, sf)).groupBy("id").agg(F.count("*").alias("n"))


@query("src8_pin_rows", "select name, case when pin_id % 3 = 0 then 'landmark' else 'city' end as kind, cast(case when pin_id % 5 = 0 then 3 else tier end as int) as tier from {fx_pins} where pin_id % 7 <> 0")
def src8(spark, sf):
    p = fixture(spark, sf, "fx_pins")
    pin = F.struct("name", F.when(F.col("pin_id") % 3 != 0, "city").alias("kind"), F.when(F.col("pin_id") % 5 != 0, F.col("tier")).alias("tier"),
                   F.when(F.col("pin_id") % 7 != 0, F.col("x_m")).alias("lat"), F.col("z_m").alias("lon"))
    docs = p.groupBy(F.expr("pin_id div 20").alias("doc")).agg(F.to_json(F.struct(F.collect_list(pin).alias("pins"))).alias("value"))
    return sources.pin_rows(docs.select(F.col("doc").cast("string").alias("path"), "value")).select("name", "kind", "tier")


@query("src9_place_rows", "select name, street, cast(id % 30 as int) as rank, round(lon, 4) as lon from {fx_places} where id % 6 <> 0")
def src9(spark, sf):
    p = fixture(spark, sf, "fx_places")
    xy = F.when(F.col("id") % 6 == 0, F.array("lon")).otherwise(F.array("lon", "lat"))
    f = F.struct("id", F.struct(xy.alias("coordinates")).alias("geometry"), F.struct("housenumber", "street", "name", "city", "county").alias("properties"))
    docs = p.groupBy("query_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(f)).alias("features"))).alias("value"))
    return sources.place_rows(docs.select(F.col("query_id").cast("string").alias("path"), "value")).select("name", "street", "rank", F.round("lon", 4).alias("lon"))


@query("src10_trace_rows", """
    select track_id || '/' || seq // 500 as scenario, cast(row_number() over (partition by track_id, seq // 500 order by seq) - 1 as int) as sample, seq as f, x_m::double as px from {fx_poses}""")
def src10(spark, sf):
    # Traces of 500 sequence numbers, so a document stays small however long the track is.
    p = fixture(spark, sf, "fx_poses").withColumn("scenario", F.concat_ws("/", "track_id", F.expr("seq div 500")))
    s = F.struct(F.col("seq").alias("f"), F.col("x_m").alias("px"), F.col("z_m").alias("pz"))
    docs = p.groupBy("scenario").agg(F.sort_array(F.collect_list(s)).alias("samples"))
    text = docs.select(F.col("scenario").alias("path"), F.to_json(F.struct("scenario", F.lit(1).alias("totalFrames"), "samples")).alias("value"))
    return sources.trace_rows(text).select("scenario", "sample", "f", "px")


# -- Octree nodes -------------------------------------------------------------

ROOT = (0, 0, 0, 6400, 6400, 6400)


@query("jn1_node_pruning", """
    with n as (select x_cm // 400 as nx, y_cm // 400 as ny, z_cm // 400 as nz, count(*) as n from {fx_points} group by 1, 2, 3),
         b as (select x0_cm as x0, y0_cm as y0, x0_cm + w_cm as x1, y0_cm + h_cm as y1 from {fx_footprints})
    select sum(n)::bigint as points, count(*) as nodes from n where exists (select 1 from b where (nx + 1) * 400 >= x0 - 1 and nx * 400 <= x1 + 1 and (ny + 1) * 400 >= y0 - 1 and ny * 400 <= y1 + 1)""")
def jn1(spark, sf):
    at = ["x", "y", "z"]
    counted = fixture(spark, sf, "fx_points").groupBy(*[F.expr(f"{a}_cm div 400").alias(a) for a in at]).agg(F.count("*").alias("n"))
    nodes = cut(counted.select(F.concat_ws("-", F.lit("4"), *at).alias("node_key"), "n"))
    boxes = fixture(spark, sf, "fx_footprints").select(F.col("x0_cm").alias("min_x"), F.col("y0_cm").alias("min_y"),
                                                       F.expr("x0_cm + w_cm").alias("max_x"), F.expr("y0_cm + h_cm").alias("max_y"))
    kept = sources.nodes_for_boxes(nodes, boxes, ROOT, 1.0, cell=800)
    return kept.agg(F.sum("n").alias("points"), F.count("*").alias("nodes"))


@query("it3_hierarchy_walk", """
    with n as (select d, x_cm // (6400 // 2 ** d)::bigint as nx, y_cm // (6400 // 2 ** d)::bigint as ny, z_cm // (6400 // 2 ** d)::bigint as nz, count(*) as c
               from {fx_points}, (select unnest(generate_series(0, 4)) as d) s group by 1, 2, 3, 4)
    select d || '-' || nx || '-' || ny || '-' || nz as node_key, d, c as n_points from n
    where (nx + 1) * 6400 / 2 ** d >= 900 and nx * 6400 / 2 ** d <= 2100 and (ny + 1) * 6400 / 2 ** d >= 3000 and ny * 6400 / 2 ** d <= 4100""")
def it3(spark, sf):
    # Points are counted in the finest nodes once; keys are made from these sums, never per point.
    finest = cut(fixture(spark, sf, "fx_points").groupBy(*[F.floor(F.col(f"{a}_cm") / 400).alias(a) for a in "xyz"]).agg(F.count("*").alias("n")))
    pts = finest.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = lambda a, d: F.floor(F.col(a) / F.pow(F.lit(2.0), 4 - d))
    key = F.concat_ws("-", "d", *[at(a, F.col("d")) for a in "xyz"])
    counts = pts.groupBy(key.alias("node_key"), "d", *[at(a, F.lit(2)).alias(f"p{a}") for a in "xyz"]).agg(F.sum("n").alias("c"))
    parent = F.concat_ws("-", F.lit("2"), "px", "py", "pz")
    top = counts.filter("d < 2").groupBy("node_key").agg(F.sum("c").alias("n_points")).withColumn("chunk", F.lit("0-0-0-0"))
    links = counts.filter("d = 2").select(F.col("node_key"), F.lit(-1).cast("bigint").alias("n_points"), F.lit("0-0-0-0").alias("chunk"))
    nested = counts.filter("d >= 2").groupBy("node_key", parent.alias("chunk")).agg(F.sum("c").alias("n_points"))
    return graph.walk_hierarchy(top.unionByName(links).unionByName(nested), ROOT, (900, 3000, 2100, 4100))
