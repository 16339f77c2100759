"""Queries over polylines: roads, bridges, walls, stripes, scatter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import classify, colours, fixedpoint, geo, rings, scatter
from tilescape.operators import lines, raster

from .fixtures import fixture, rectangle, spark_table, tag_map
from .registry import query
from .scalar_queries import hash_sql, milli, micro, step_sql


def by_line(df, key, x, y, extra=()):
    """Vertices of each line as an array; lines have a fixed, small number of vertices here."""
    v = F.struct("seq", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *extra)
    return df.groupBy(key).agg(F.sort_array(F.collect_list(v)).alias("_v")).select(
        key, F.transform("_v", lambda p: F.struct(p["x"], p["y"])).alias("path"), "_v")


def tile_lines(spark, sf):
    return by_line(fixture(spark, sf, "fx_lines"), "line_id", "u", "v").drop("_v")


@query("fl4_road_filter", """
    select cls, kind, count(*) as n from (select ['motorway', 'minor', 'service', 'aeroway', 'path'][cast(o_custkey % 5 as int) + 1] as cls,
        case o_orderkey % 4 when 0 then 'bridge' when 1 then 'tunnel' end as brunnel,
        case when o_orderkey % 4 = 0 then 'bridge' else 'road' end as kind from orders) r
    where cls <> 'aeroway' and coalesce(brunnel, '') <> 'tunnel' group by 1, 2""")
def fl4(spark, sf):
    names = F.array(*[F.lit(n) for n in ("motorway", "minor", "service", "aeroway", "path")])
    roads = spark_table(spark, sf, "orders").select(F.get(names, (F.col("o_custkey") % 5).cast("int")).alias("cls"),
                                                    F.when(F.col("o_orderkey") % 4 == 0, "bridge").when(F.col("o_orderkey") % 4 == 1, "tunnel").alias("brunnel"))
    drawable = roads.filter(colours.road_drawable("cls") & (F.coalesce("brunnel", F.lit("")) != "tunnel"))
    return drawable.groupBy("cls", F.when(F.col("brunnel") == "bridge", "bridge").otherwise("road").alias("kind")).agg(F.count("*").alias("n"))


@query("wn7_segments", """
    with s as (select line_id, seq, sqrt((lead(u) over w - u) ** 2 + (lead(v) over w - v) ** 2) as len from {fx_lines} window w as (partition by line_id order by seq))
    select line_id, cast(seq as int) as seg, round(len, 4) as length, round(coalesce(sum(len) over (partition by line_id order by seq rows between unbounded preceding and 1 preceding), 0), 4) as before
    from s where len is not null""")
def wn7(spark, sf):
    return lines.segments(tile_lines(spark, sf)).select("line_id", "seg", F.round("length", 4).alias("length"), F.round("before", 4).alias("before"))


@query("wn8_subdivision", """
    with s as (select line_id, seq, u, v, lead(u) over w as u1, lead(v) over w as v1 from {fx_lines} window w as (partition by line_id order by seq)),
         n as (select *, greatest(1, cast(ceil(sqrt((u1 - u) ** 2 + (v1 - v) ** 2) / 300) as bigint)) as n from s where u1 is not null),
         k as (select *, unnest(generate_series(1, n)) as k from n)
    select line_id, count(*) + 1 as vertices, cast(round(sum((u + (u1 - u) * (k / n::double)) * 1000) + min(case when seq = 0 then u end) * 1000) as bigint) as sum_x,
           cast(round(max((v + (v1 - v) * (k / n::double)) * 1000)) as bigint) as max_y from k group by 1""")
def wn8(spark, sf):
    d = tile_lines(spark, sf).select("line_id", lines.subdivide("path", 300.0).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, p: a + p["x"])
    top = F.array_max(F.transform(F.slice("p", F.lit(2), F.size("p")), lambda p: p["y"]))
    return d.select("line_id", F.size("p").cast("bigint").alias("vertices"), milli(total).alias("sum_x"), milli(top).alias("max_y"))


CLIP = """s as (select line_id, seq, u, v, lead(u) over w - u as du, lead(v) over w - v as dv from {fx_lines} window w as (partition by line_id order by seq)),
    t as (select *, greatest(0e0, case when du > 0 then -u / du::double when du < 0 then (4096 - u) / du::double else 0 end,
                             case when dv > 0 then -v / dv::double when dv < 0 then (4096 - v) / dv::double else 0 end) as t0,
                    least(1e0, case when du > 0 then (4096 - u) / du::double when du < 0 then -u / du::double else 1 end,
                          case when dv > 0 then (4096 - v) / dv::double when dv < 0 then -v / dv::double else 1 end) as t1 from s where du is not null),
    c as (select *, t0 <= t1 and not (du = 0 and (u < 0 or u > 4096)) and not (dv = 0 and (v < 0 or v > 4096)) as kept from t)"""


@query("wn9_box_clip", f"""
    with {CLIP}, g as (select *, case when t0 > 0 or not coalesce(lag(kept) over w, false) or coalesce(lag(t1) over w, 1) < 1 then 1 else 0 end as starts
                       from c window w as (partition by line_id order by seq)),
         k as (select *, sum(case when kept then starts else 0 end) over (partition by line_id order by seq) as piece from g),
         f as (select line_id, piece, sum(sqrt(du * du + dv * dv) * (t1 - t0)) as len, min_by(u + t0 * du, seq) as x0, min_by(v + t0 * dv, seq) as y0,
                      max_by(u + t1 * du, seq) as x1, max_by(v + t1 * dv, seq) as y1, count(*) + 1 as vertices from k where kept and t1 > t0 group by 1, 2)
    select line_id, cast(row_number() over (partition by line_id order by piece) - 1 as int) as piece, vertices, round(len, 3) as length, round(x0, 3) as x0, round(y0, 3) as y0, round(x1, 3) as x1, round(y1, 3) as y1 from f""")
def wn9(spark, sf):
    d = tile_lines(spark, sf).select("line_id", F.posexplode_outer(lines.clip_to_box("path", 4096.0)).alias("piece", "p")).filter("piece is not null")
    total = F.aggregate(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1),
                                   lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])), F.lit(0.0), lambda a, v: a + v)
    return d.select("line_id", "piece", F.size("p").cast("bigint").alias("vertices"), F.round(total, 3).alias("length"),
                    *[F.round(F.element_at("p", i)[c], 3).alias(f"{c}{k}") for k, i in ((0, 1), (1, -1)) for c in "xy"])


def bridges(spark, sf):
    f = fixture(spark, sf, "fx_bridges").select("road_id", "seq", (F.col("x_cm") / 100.0).alias("x"), (F.col("z_cm") / 100.0).alias("y"),
                                                (F.col("terrain_cm") / 100.0).alias("terrain"))
    return by_line(f, "road_id", "x", "y", ("terrain",)).select("road_id", "path", F.transform("_v", lambda p: p["terrain"]).alias("terrain"))


DECK = """b as (select road_id, seq, x_cm / 100e0 as x, z_cm / 100e0 as y, terrain_cm / 100e0 as t from {fx_bridges}),
    leg as (select *, t <= 1.5e0 and lag(t) over w <= 1.5e0 as wet, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as len from b window w as (partition by road_id order by seq)),
    isl as (select *, sum(case when coalesce(wet, false) then 0 else 1 end) over (partition by road_id order by seq) as grp from leg),
    run as (select road_id, max(r) as run from (select road_id, grp, sum(case when wet then len else 0 end) as r from isl group by 1, 2) q group by 1),
    raw as (select b.*, run, case when run > 300 and t <= 1.5e0 then greatest(15 + least(1, run / 2000) * 40, t + 7) else t + 7 end as h from b join run using (road_id)),
    deck as (select r.road_id, r.seq, r.x, r.y, r.t, r.run, sum(o.h) / 5 as deck from raw r, (select unnest(generate_series(-2, 2)) as k) k, raw o
             where o.road_id = r.road_id and o.seq = greatest(0, least(7, r.seq + k)) group by all)"""


@query("wn10_water_run", f"with {DECK} select road_id, round(run, 4) as run from run")
def wn10(spark, sf):
    return bridges(spark, sf).select("road_id", F.round(lines.water_run("path", "terrain"), 4).alias("run"))


@query("wn11_deck_profile", f"with {DECK} select road_id, cast(seq as int) as seq, round(deck, 4) as deck from deck")
def wn11(spark, sf):
    return (lines.with_deck(bridges(spark, sf)).select("road_id", F.posexplode_outer("deck").alias("seq", "deck"))
            .withColumn("deck", F.round("deck", 4)))


def decks(spark, sf):
    return lines.deck_boxes(lines.with_deck(bridges(spark, sf)), F.lit(4.0), ["road_id"])


@query("wn12_deck_boxes", f"""
    with {DECK}, s as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(deck) over w as d1 from deck window w as (partition by road_id order by seq)),
         l as (select *, sqrt((x1 - x) ** 2 + (y1 - y) ** 2) as len from s where x1 is not null)
    select road_id, cast(seq as int) as seg, round(len, 4) as length, round(greatest(deck, d1), 4) as top, round(least(deck, d1) - 1.5e0, 4) as bottom,
           round(x, 4) as ax, round(y, 4) as ay, round(x1, 4) as bx, round(y1, 4) as by, round((x1 - x) / len, 4) as tx_, round((y1 - y) / len, 4) as ty_,
           round((x + x1) / 2 - abs(x1 - x) / 2 - abs(y1 - y) / len * 4, 4) as min_x, round((x + x1) / 2 + abs(x1 - x) / 2 + abs(y1 - y) / len * 4, 4) as max_x,
           round((y + y1) / 2 - abs(y1 - y) / 2 - abs(x1 - x) / len * 4, 4) as min_y, round((y + y1) / 2 + abs(y1 - y) / 2 + abs(x1 - x) / len * 4, 4) as max_y
    from l where len >= 1e-4""")
def wn12(spark, sf):
    return decks(spark, sf).select("road_id", "seg", *[F.round(c, 4).alias(c) for c in ("length", "top", "bottom", "ax", "ay", "bx", "by", "tx_", "ty_", "min_x", "max_x", "min_y", "max_y")])


@query("wn13_piers", f"""
    with {DECK}, c as (select *, coalesce(sum(len) over (partition by road_id order by seq), 0) as cum from (
             select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as len from deck window w as (partition by road_id order by seq)) q),
         tot as (select road_id, max(cum) as total from c group by 1),
         st as (select road_id, k as pier, 40 + 80 * k as station from tot, (select unnest(generate_series(0, 30)) as k) g where 40 + 80 * k < total),
         v as (select st.road_id, pier, station, count(*) as idx from st join c on c.road_id = st.road_id and c.seq > 0 and c.cum < station group by 1, 2, 3
               union all select road_id, pier, station, 0 from st where not exists (select 1 from c where c.road_id = st.road_id and c.seq > 0 and c.cum < station))
    select v.road_id, pier, station::double as station, round(c.x, 4) as x, round(c.y, 4) as y, round(least(t, 0) - 2, 4) as base, round(deck, 4) as deck_y
    from v join c on c.road_id = v.road_id and c.seq = v.idx where deck - (least(t, 0) - 2) >= 4""")
def wn13(spark, sf):
    return lines.piers(lines.with_deck(bridges(spark, sf)), ["road_id"]).select(
        "road_id", "pier", F.col("station").cast("double").alias("station"), *[F.round(c, 4).alias(c) for c in ("x", "y", "base", "deck_y")])


@query("wn14_ribbon_sides", """
    with n as (select line_id, seq, u, v, coalesce(lead(u) over w, u) - coalesce(lag(u) over w, u) as tx, coalesce(lead(v) over w, v) - coalesce(lag(v) over w, v) as ty
               from {fx_lines} window w as (partition by line_id order by seq)),
         m as (select *, case when tx = 0 and ty = 0 then 1 else sqrt(tx * tx + ty * ty) end as len from n)
    select line_id, cast(seq as int) as seq, round(u - ty / len * 5.5e0, 4) as lx, round(v + tx / len * 5.5e0, 4) as ly, round(u + ty / len * 5.5e0, 4) as rx, round(v - tx / len * 5.5e0, 4) as ry,
           round(u - ty / len * 5.1e0, 4) as edge_lx, round(v + tx / len * 5.1e0, 4) as edge_ly, round(u + ty / len * 5.1e0, 4) as edge_rx, round(v - tx / len * 5.1e0, 4) as edge_ry from m""")
def wn14(spark, sf):
    d = tile_lines(spark, sf).withColumn("s", lines.side_offsets("path", 5.5)).withColumn("e", lines.edge_lines("path", 5.5))
    d = d.select("line_id", F.posexplode_outer(F.arrays_zip("s", F.col("e.left").alias("el"), F.col("e.right").alias("er"))).alias("seq", "z"))
    return d.select("line_id", "seq", F.round("z.s.left.x", 4).alias("lx"), F.round("z.s.left.y", 4).alias("ly"),
                    F.round("z.s.right.x", 4).alias("rx"), F.round("z.s.right.y", 4).alias("ry"),
                    *[F.round(f"z.e{side}.{c}", 4).alias(f"edge_{side}{c}") for side in "lr" for c in "xy"])


def footprint_rings(spark, sf):
    """Footprints in metres, outer ring wound with positive area."""
    f = fixture(spark, sf, "fx_footprints")
    ring = rings.wind_outer(F.transform(rectangle("x0_cm", "y0_cm", "w_cm", "h_cm"), lambda p: F.struct((p["x"] / 100).alias("x"), (p["y"] / 100).alias("y"))))
    return f.withColumn("ring", ring)


# The wound rectangle runs (x0,y1) (x1,y1) (x1,y0) (x0,y0).
WALLS = """w as (select tx, fid, 0 as edge, x0_cm as ax, y0_cm + h_cm as ay, x0_cm + w_cm as bx, y0_cm + h_cm as by_ from {fx_footprints}
    union all select tx, fid, 1, x0_cm + w_cm, y0_cm + h_cm, x0_cm + w_cm, y0_cm from {fx_footprints}
    union all select tx, fid, 2, x0_cm + w_cm, y0_cm, x0_cm, y0_cm from {fx_footprints}
    union all select tx, fid, 3, x0_cm, y0_cm, x0_cm, y0_cm + h_cm from {fx_footprints})"""


@query("wn15_wall_edges", f"""
    with {WALLS} select tx, fid, edge, ax, ay, bx, by_, cast(-sign(by_ - ay) as bigint) as nx, cast(sign(bx - ax) as bigint) as ny,
        cast(abs(bx - ax) + abs(by_ - ay) as bigint) as length from w""")
def wn15(spark, sf):
    e = lines.wall_edges(footprint_rings(spark, sf), "ring", ["tx", "fid"])
    cm = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return e.select("tx", "fid", "edge", *[cm(c) for c in ("ax", "ay", "bx", "length")], cm("by").alias("by_"), F.round("nx").cast("bigint").alias("nx"), F.round("ny").cast("bigint").alias("ny"))


@query("wn16_party_walls", f"""
    with {WALLS}, k as (select *, (ax * 4 + 50) // 100 as qax, (ay * 4 + 50) // 100 as qay, (bx * 4 + 50) // 100 as qbx, (by_ * 4 + 50) // 100 as qby from w),
         o as (select *, row_number() over (partition by least(row(qax, qay), row(qbx, qby)), greatest(row(qax, qay), row(qbx, qby)) order by tx, fid, edge) as rn from k)
    select tx, fid, edge from o where rn = 1""")
def wn16(spark, sf):
    e = lines.wall_edges(footprint_rings(spark, sf), "ring", ["tx", "fid"])
    # Only ends and order are sorted; other measures of an edge stay behind.
    ends = e.select("tx", "fid", "edge", "ax", "ay", "bx", "by")
    return lines.first_claims(ends, ["tx", "fid", "edge"]).select("tx", "fid", "edge")


@query("wn17_tile_cap", """
    select tx, fid from (select tx, fid, row_number() over (partition by tx order by fid) as rn from {fx_footprints}) q where rn <= 150""")
def wn17(spark, sf):
    return lines.first_per_tile(fixture(spark, sf, "fx_footprints").select("tx", "fid"), ["tx"], ["fid"], 150)


def nth(n, s):
    for _ in range(n):
        s = step_sql(s)
    return s


@query("wn18_street_trees", f"""
    with s as (select line_id, seq, u as ax, v as ay, lead(u) over w as bx, lead(v) over w as by_ from {{fx_lines}} window w as (partition by line_id order by seq)),
         l as (select *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) as len from s where bx is not null),
         c as (select *, coalesce(sum(len) over (partition by line_id order by seq rows between unbounded preceding and 1 preceding), 0) as before from l),
         st as (select *, unnest(generate_series(cast(floor(before / 240) as bigint) + 1, cast(floor((before + len) / 240) as bigint))) as station from c where len >= 1e-3),
         h as (select *, {hash_sql('line_id', 'station')} as h from st),
         r as (select *, {step_sql('h')} as s1 from h), r2 as (select *, {step_sql('s1')} as s2 from r), r3 as (select *, {step_sql('s2')} as s3 from r2),
         a as (select *, greatest(0, least(len, station * 240 - before + (s1 / 4294967296e0 - 0.5e0) * 8)) as along,
                      (case when s2 % 2 = 0 then 1 else -1 end) * (5 + (s3 / 4294967296e0 - 0.5e0) * 2) as side from r3)
    select line_id, station, round(ax + (bx - ax) / len * along - (by_ - ay) / len * side, 3) as x, round(ay + (by_ - ay) / len * along + (bx - ax) / len * side, 3) as y,
           {step_sql('s3')} & 255 < 100 as conifer from a""")
def wn18(spark, sf):
    out = lines.street_trees(tile_lines(spark, sf), "line_id", spacing=240.0)
    return out.select("line_id", "station", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "conifer")


@query("wn19_park_scatter", f"""
    with p as (select line_id, min(u) as x0, max(u) as x1, min(v) as y0, max(v) as y1 from {{fx_lines}} group by 1),
         n as (select *, 2 * least(200, greatest(1, ((x1 - x0) * (y1 - y0)) // 350)) as n from p),
         d as (select *, unnest(generate_series(1, n)) as draw from n), h as (select *, {hash_sql('line_id', 'draw')} as h from d),
         s1 as (select *, {step_sql('h')} as s1 from h), s2 as (select *, {step_sql('s1')} as s2 from s1),
         q as (select line_id, draw, x0 + s1 / 4294967296e0 * (x1 - x0) as x, y0 + s2 / 4294967296e0 * (y1 - y0) as y from s2),
         e as (select line_id, u as ax, v as ay, coalesce(lead(u) over w, first_value(u) over w) as bx, coalesce(lead(v) over w, first_value(v) over w) as by_
               from {{fx_lines}} window w as (partition by line_id order by seq))
    select q.line_id, draw, round(x, 3) as x, round(y, 3) as y from q join e using (line_id)
    group by 1, 2, 3, 4 having sum(case when (ay > y) <> (by_ > y) and x < (bx - ax) * (y - ay) / (by_ - ay)::double + ax then 1 else 0 end) % 2 = 1""".replace("group by 1, 2, 3, 4 having", "group by q.line_id, draw, q.x, q.y having"))
def wn19(spark, sf):
    parks = tile_lines(spark, sf).withColumnRenamed("path", "ring")
    return lines.park_trees(parks, "line_id").select("line_id", "draw", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("wn29_crosswalk_stripes", """
    with c as (select node_id, lon_e7 % 100000 / 10e0 as x, lat_e7 % 100000 / 10e0 as y, (node_id * 37) % 360 as deg, 2 + node_id % 50 as len, 3 + node_id % 4 as w from {fx_crossings}),
         n as (select *, greatest(3, least(32, cast(floor(len / 1.2e0) as bigint))) as n from c),
         s as (select *, unnest(generate_series(0, n - 1)) as stripe from n),
         f as (select *, -(n * 1.2e0 - 0.6e0) / 2 + stripe * 1.2e0 as a, sin(radians(deg)) as sx, -cos(radians(deg)) as sz, cos(radians(deg)) as ax, sin(radians(deg)) as az from s)
    select node_id, stripe, round(x + sx * a - ax * w / 2e0, 4) as x0, round(y + sz * a - az * w / 2e0, 4) as y0,
           round(x + sx * (a + 0.6e0) - ax * w / 2e0, 4) as x1, round(y + sz * (a + 0.6e0) - az * w / 2e0, 4) as y1,
           round(x + sx * (a + 0.6e0) + ax * w / 2e0, 4) as x2, round(y + sz * (a + 0.6e0) + az * w / 2e0, 4) as y2,
           round(x + sx * a + ax * w / 2e0, 4) as x3, round(y + sz * a + az * w / 2e0, 4) as y3 from f""")
def wn29(spark, sf):
    c = fixture(spark, sf, "fx_crossings").select("node_id", (F.expr("lon_e7 % 100000") / 10.0).alias("x"), (F.expr("lat_e7 % 100000") / 10.0).alias("y"),
                                                  (F.col("node_id") * 37 % 360).alias("bearing_deg"), (F.col("node_id") % 50 + 2).alias("len_m"), (F.col("node_id") % 4 + 3).alias("width_m"))
    out = lines.crosswalk_stripes(c, ["node_id"])
    return out.select("node_id", "stripe", *[F.round(F.col("corners")[i][c], 4).alias(f"{c}{i}") for i in range(4) for c in "xy"])


@query("wn30_roof_facets", f"""
    with {WALLS}, r as (select fid, tx, x0_cm / 100e0 as x0, (x0_cm + w_cm) / 100e0 as x1, y0_cm / 100e0 as y0, (y0_cm + h_cm) / 100e0 as y1, fid % 3 as shape, (fid % 80) / 10e0 as rise, (fid * 7) % 180 as deg from {{fx_footprints}}),
         c as (select *, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, sin(radians(deg)) as dx, -cos(radians(deg)) as dy,
                      least(rise, least(x1 - x0, y1 - y0) * 0.5e0, 12) as rise2 from r where shape <> 0 and rise > 0),
         t as (select *, least(case when abs(dx) > 1e-6 then (x1 - x0) / 2 / abs(dx) else 1e9 end, case when abs(dy) > 1e-6 then (y1 - y0) / 2 / abs(dy) else 1e9 end) as t from c),
         e as (select t.*, w.edge, (w.ax + w.bx) / 200e0 as mx, (w.ay + w.by_) / 200e0 as my from t join w using (fid)),
         d as (select *, (mx - (cx - dx * t)) ** 2 + (my - (cy - dy * t)) ** 2 as d0, (mx - (cx + dx * t)) ** 2 + (my - (cy + dy * t)) ** 2 as d1 from e)
    select fid, edge, round(case when shape <> 1 then cx when abs(d0 - d1) < 1e-6 then null when d0 < d1 then cx - dx * t else cx + dx * t end, 4) as apex_x, round(10 + rise2, 4) as top, shape = 1 as gable from d""")
def wn30(spark, sf):
    roofs = footprint_rings(spark, sf).select("fid", "ring", (F.col("fid") % 3).alias("shape"), (F.col("fid") % 80 / 10.0).alias("rise_m"),
                                              (F.col("fid") * 7 % 180).alias("ridge_deg"), F.lit(10.0).alias("eave_y"))
    out = lines.roof_facets(roofs, "ring", ["fid", "ridge_deg"])
    # On an axis-parallel ridge two edges are equally far from both ends; either end is right there.
    tie = F.col("gable") & (((F.col("ridge_deg") % 90 == 0) & (F.col("edge") % 2 == F.when(F.col("ridge_deg") == 90, 0).otherwise(1))))
    return out.select("fid", "edge", F.when(~tie, F.round("apex.x", 4)).alias("apex_x"), F.round("top", 4).alias("top"), "gable")


@query("jn5_road_bearing", """
    with r as (select road_id, seq, lon_e7 / 1e7 as ax, lat_e7 / 1e7 as ay, lead(lon_e7 / 1e7) over w as bx, lead(lat_e7 / 1e7) over w as by_ from {fx_roads} window w as (partition by road_id order by seq)),
         n as (select node_id, lon_e7 / 1e7 as lon, lat_e7 / 1e7 as lat from {fx_crossings}),
         t as (select n.*, r.*, bx - ax as vx, by_ - ay as vy from n cross join r where bx is not null),
         p as (select *, case when vx * vx + vy * vy = 0 then 0 else greatest(0, least(1, ((lon - ax) * vx + (lat - ay) * vy) / (vx * vx + vy * vy))) end as t from t),
         d as (select node_id, min(row(sqrt(((ax + t * vx - lon) * cos(radians(lat))) ** 2 + (ay + t * vy - lat) ** 2), road_id, seq,
                   degrees(atan2(vx * cos(radians((ay + by_) / 2)), vy)))) as b from p group by 1)
    select node_id, cast(round((b[4] + 360) * 1000) as bigint) % 360000 as mdeg, round(b[1], 9) as distance from d""")
def jn5(spark, sf):
    from .scalar_queries import nodes, road_paths
    out = lines.nearest_road_bearing(nodes(spark, sf), road_paths(spark, sf), "node_id", "road_id")
    return out.select("node_id", (F.round((F.col("bearing") + 360) * 1000).cast("bigint") % 360000).alias("mdeg"), F.round("distance", 9).alias("distance"))


@query("wn33_drape", """
    select seq, round(case layer when 'water' then 0.5e0 else s + case layer when 'road' then 0.6e0 when 'lane' then 0.63e0 when 'green' then 0.15e0 when 'landuse' then 0.12e0 else 0.55e0 end end, 6) as y
    from (select seq, speed_c / 100e0 as s, ['road', 'lane', 'green', 'landuse', 'crosswalk', 'water'][cast(seq % 6 as int) + 1] as layer from {fx_poses}) q""")
def wn33(spark, sf):
    names = F.array(*[F.lit(n) for n in ("road", "lane", "green", "landuse", "crosswalk", "water")])
    v = fixture(spark, sf, "fx_poses").select("seq", (F.col("speed_c") / 100.0).alias("surface"), F.get(names, (F.col("seq") % 6).cast("int")).alias("layer"))
    return lines.drape(v, "layer").select("seq", F.round("y", 6).alias("y"))
