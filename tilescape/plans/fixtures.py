"""Geospatial inputs derived from the driver tables by integer arithmetic.

Each recipe is one SQL text that both engines read: `{D}` is integer division and
`{X}(a, b){Y}` unnests an inclusive integer range. Row counts follow the driver
tables, and the number of tiles grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilescape.session import by_keys

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RECIPES: dict[str, str] = {
    # Classified points in 64 m tiles: 8 m islands of canopy, flat roof and clutter.
    "fx_points": """
        select tx, x_cm, y_cm, cls,
               case when cls = 2 then l_partkey % 50 when kind = 0 then 300 + qty * 60
                    when kind = 1 then 800 + l_partkey % 30 else 400 + qty * 10 end as z_cm
        from (select *, case when l_linenumber in (1, 2) then 2 when l_linenumber = 6 then 9
                             when l_linenumber = 7 then 7
                             when ((x_cm {D} 800) % 2 = 1 and (y_cm {D} 800) % 2 = 1) then 1 else 2 end as cls,
                     ((x_cm {D} 1600) + (y_cm {D} 1600)) % 3 as kind
              from (select 2616 + l_orderkey {D} 3750 as tx, l_linenumber, l_partkey,
                           cast(l_quantity as bigint) as qty,
                           (l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 611953) % 6400 as x_cm,
                           (l_suppkey * 7907 + l_orderkey * 15485863 + l_linenumber * 32452843) % 6400 as y_cm
                    from {lineitem}) a) b""",
    # Rectangular footprints, 500 per 64 m tile.
    "fx_footprints": """
        select p_partkey as fid, 2616 + p_partkey {D} 500 as tx,
               (p_partkey * 7919) % 5600 as x0_cm, (p_partkey * 611953) % 5600 as y0_cm,
               300 + p_size * 10 as w_cm, 300 + (p_partkey % 40) * 10 as h_cm
        from {part}""",
    # Four-vertex polylines; one 0.16 x 0.107 degree box per 1500 roads.
    "fx_roads": """
        select road_id, seq, box,
               -1225140000 + box * 1600000 + (road_id * 104729 + seq * (3000 + road_id % 700)) % 1600000 as lon_e7,
                377080000 + (road_id * 15485863 + seq * (2000 + road_id % 900)) % 1070000 as lat_e7
        from (select c_custkey as road_id, c_custkey {D} 1500 as box, {X}(0, 3){Y} as seq from {customer}) a""",
    # Crossing nodes close to the first vertices of the roads.
    "fx_crossings": """
        select p_partkey as node_id,
               -1225140000 + road {D} 1500 * 1600000 + (road * 104729 + p_partkey % 700) % 1600000 as lon_e7,
                377080000 + (road * 15485863 + p_size * 13) % 1070000 as lat_e7
        from (select p_partkey, p_size, p_partkey * 3 {D} 4 as road from {part}) a""",
    "fx_pins": """
        select s_suppkey as pin_id, s_name as name, cast(1 + s_suppkey % 3 as int) as tier,
               (s_suppkey * 7919) % 8000 as x_m, (s_suppkey * 611953) % 8000 as z_m
        from {supplier}""",
    "fx_poses": """
        select user_id as track_id, event_id as seq, (event_id * 7919 + user_id * 104729) % 4000 as x_m,
               (event_id * 611953 + user_id * 15485863) % 4000 as z_m,
               cast(floor(value * 100) as bigint) as speed_c,
               event_type in ('error', 'click') as contact
        from {events}""",
    # A world that grows with the tables: 100 pins and 10,000 poses per 8 km square, squares out of each other's range.
    "fx_view_pins": "select pin_id, name, tier, x_m + pin_id {D} 100 * 14000 as x_m, z_m from {fx_pins}",
    "fx_view_poses": "select seq, x_m + seq {D} 10000 * 14000 as x_m, z_m from {fx_poses}",
    "fx_requests": """
        select user_id as viewer, event_id as seq, user_id % 20 as tile, event_type as etype,
               case when event_type = 'error' then 0 else 1 end as ok
        from {events}""",
    # Dense 64 x 64 elevation tiles, 64 customers per tile.
    "fx_pixels": """
        select tx, ty, px, py,
               (px * 7 + py * 13 + px * py + (tx * 8 + ty) * 31) % 2800 as elev_dm
        from (select c_custkey {D} 64 % 8 as tx, c_custkey {D} 512 as ty, c_custkey % 64 as py,
                     {X}(0, 63){Y} as px from {customer}) a""",
    # Probes in fractional tile coordinates, 1/4096 tile steps.
    "fx_probes": """
        select o_orderkey as probe_id, ((o_orderkey * 7919 + o_custkey) % 32768 + 0.3718281828e0) / 4096e0 as fx,
               ((o_custkey * 104729 + o_orderkey) % 16384 + 0.6173205081e0) / 4096e0 as fy
        from {orders}""",
    "fx_places": """
        select c_custkey as id, c_custkey {D} 30 as query_id,
               case when c_custkey % 3 = 0 then cast(c_custkey % 900 as varchar(10)) end as housenumber,
               case when c_custkey % 4 <> 0 then concat(n_name, ' St') end as street, c_name as name,
               case when c_custkey % 5 <> 0 then c_mktsegment end as city, n_name as county,
               -123.2e0 + (c_custkey * 7919 % 2000) / 1000e0 as lon, 37e0 + (c_custkey * 611953 % 1500) / 1000e0 as lat
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    # Map elements with sparse tags and short paths; about half the paths are closed.
    "fx_elements": """
        select o_orderkey as id, case o_orderkey % 5 when 0 then 'node' when 4 then 'relation' else 'way' end as type,
               case o_orderkey % 7 when 0 then 'footway' when 1 then 'path' when 2 then 'pedestrian'
                    when 3 then 'residential' when 4 then 'crossing' end as highway,
               case o_custkey % 6 when 0 then 'sidewalk' when 1 then 'crossing' end as footway,
               case when o_custkey % 11 = 0 then 'pitch' end as leisure,
               case when o_custkey % 13 = 0 then 'parking' end as amenity,
               case when o_custkey % 17 = 0 then 'beach' end as natural_,
               case when o_custkey % 19 = 0 then 'pier' end as man_made,
               case o_orderkey % 3 when 0 then 'yes' when 1 then 'no' end as area,
               case o_orderkey % 9 when 0 then 'zebra' when 1 then 'unmarked' when 2 then 'marked' end as crossing,
               case when o_custkey % 4 = 0 then 'yes' end as building,
               o_orderkey % 2 as closed,
               -1225140000 + (o_custkey * 104729 + o_orderkey * 31) % 1600000 as lon_e7,
               377080000 + (o_custkey * 15485863 + o_orderkey * 17) % 1070000 as lat_e7
        from {orders}""",
    # Polygon features in tile units: an outer rectangle, a hole, sometimes a second polygon.
    "fx_features": """
        select p_partkey as fid, 2616 + p_partkey {D} 500 as tx, 6331 as ty,
               (p_partkey * 7919) % 4600 - 300 as u0, (p_partkey * 611953) % 4600 - 300 as v0,
               40 + p_size * 4 as w, 40 + (p_partkey % 40) * 4 as h, p_partkey % 3 as parts
        from {part}""",
    # Five-vertex polylines in tile units that cross the 0..4096 box.
    "fx_lines": """
        select line_id, seq, (line_id * 7919 + seq * (1511 + line_id % 97)) % 6000 - 900 as u,
               (line_id * 104729 + seq * (1303 + line_id % 89)) % 6000 - 900 as v
        from (select c_custkey as line_id, {X}(0, 4){Y} as seq from {customer}) a""",
    # Byte colours, one per line item.
    "fx_colours": """
        select l_orderkey, l_linenumber, l_partkey * 7 % 256 as r, l_suppkey * 13 % 256 as g,
               (l_orderkey + l_linenumber * 37) % 256 as b
        from {lineitem}""",
    # 64 x 64 imagery tiles.
    "fx_wash": """
        select tx, ty, px, py, (px * 3 + py + tx * 17) % 200 + 20 as r, (px + py * 2 + ty * 11) % 180 + 30 as g,
               (px * py + tx * 5) % 160 + 40 as b
        from (select c_custkey {D} 64 % 8 as tx, c_custkey {D} 512 as ty, c_custkey % 64 as py,
                     {X}(0, 63){Y} as px from {customer}) a""",
    # Bridge decks: eight vertices on a straight line with a terrain height.
    "fx_bridges": """
        select road_id, seq, seq * (20 + road_id % 90) * 100 as x_cm, seq * (5 + road_id % 40) * 100 as z_cm,
               case when (road_id + seq * seq) % 4 = 0 then 900 + road_id % 300
                    when (road_id {D} 3) % 3 = 0 then 50 else 100 + (road_id * 7 + seq * 31) % 90 end as terrain_cm
        from (select c_custkey as road_id, {X}(0, 7){Y} as seq from {customer}) a""",
    # Solids to probe: footprints with a height interval.
    "fx_prisms": """
        select fid, tx, x0_cm, y0_cm, w_cm, h_cm, -300 + (fid % 7) * 50 as base_cm, 500 + (fid * 37) % 2500 as top_cm
        from {fx_footprints}""",
    "fx_rays": """
        select event_id as ray_id, 2616 + event_id {D} 2500 as tx, (event_id * 7919 + user_id * 31) % 6400 as x_cm,
               (event_id * 611953 + user_id * 17) % 6400 as y_cm,
               cast(200 + (event_id * 13) % 3500 as bigint) as from_cm, 2000 + (user_id % 10) * 100 as drop_cm,
               (event_id * 7) % 120 as ground_cm
        from {events}""",
    # Roof records: footprint centroids shifted by up to 5.5 m on each axis.
    "fx_records": """
        select fid as rec_id, tx, x0_cm + w_cm {D} 2 + (fid * 13) % 1100 - 550 as x_cm,
               y0_cm + h_cm {D} 2 + (fid * 29) % 1100 - 550 as y_cm, cast(fid % 3 as int) as shape,
               20 + (fid * 11) % 300 as eave_dm
        from {fx_footprints}""",
    # Building properties as text, some of it unusable.
    "fx_heights": """
        select p_partkey as fid,
               case p_partkey % 6 when 0 then cast(p_size * 13 as varchar(10)) when 1 then concat(cast(p_size as varchar(10)), '.5 m')
                    when 2 then 'tall' when 3 then cast(p_size * 2 as varchar(10)) when 4 then '0.25' end as render_height,
               case p_partkey % 4 when 0 then cast(p_partkey % 40 as varchar(10)) when 1 then '3' when 2 then '-2' end as render_min_height,
               case p_partkey % 10 when 0 then 'true' when 1 then '0' end as hide_3d,
               (p_partkey * 37) % 30000 as area_m2
        from {part}""",
    "fx_coverage": """
        select distinct layer, tx, ty
        from (select case o_orderkey % 5 when 0 then 'trees' when 1 then 'roofs' when 2 then 'paint'
                          when 3 then 'terrain' else 'wash' end as layer,
                     41856 + o_custkey % 64 + (o_orderkey {D} 15000) * 64 as tx, 101296 + o_orderkey % 48 as ty
              from {orders}) a""",
    "fx_disk": """
        select distinct case l_orderkey % 5 when 0 then 'trees' when 1 then 'roofs' when 2 then 'paint'
                             when 3 then 'terrain' else 'wash' end as layer,
               41856 + l_partkey % 64 + (l_orderkey {D} 15000) * 64 as tx, 101296 + l_orderkey % 48 as ty
        from {lineitem}""",
}

# Inputs of CPU-heavy geometry, always dealt out to all partitions.
SPREAD = ("fx_points", "fx_rays", "fx_lines", "fx_probes")
# Small files that leave many rows or much work: dealt out before the rows are added, as one task reads such a file.
# The number of parts grows with the file, so a task gets no more of it from a larger one.
SOURCE_ROWS = 15_000
SPREAD_SOURCE = ("fx_pixels", "fx_wash", "fx_bridges", "fx_roads", "fx_footprints")

_NAME = re.compile(r"\{(\w{2,})\}")


def needs(text: str) -> list[str]:
    """Fixtures a text refers to, dependencies first."""
    out: list[str] = []
    for name in _NAME.findall(text):
        if name in RECIPES:
            out += [n for n in needs(RECIPES[name]) + [name] if n not in out]
    return out


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(table: DataFrame, rows: int | None = None) -> int:
    """Shuffle partitions of the session, or more where a part would get over `rows` (SOURCE_ROWS) rows of `table` (counted in its footers)."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // (rows or SOURCE_ROWS)))


def fixture(spark: SparkSession, sf_dir: str, name: str, keyed: bool = True, dealt: bool = True) -> DataFrame:
    """A derived input as a DataFrame over the driver's Parquet files, joined by sorting unless `keyed` is off.

    `dealt` off leaves the rows where they were read, for light work on them.
    """
    text = RECIPES[name]
    args, parts = {}, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for ref in dict.fromkeys(_NAME.findall(text)):
        args[ref] = fixture(spark, sf_dir, ref) if ref in RECIPES else spark_table(spark, sf_dir, ref)
    if name in SPREAD_SOURCE:
        args = {ref: df.repartition(parts_for(df)) for ref, df in args.items()}
    text = text.replace("{D}", "div").replace("{X}(", "explode(sequence(").replace("){Y}", "))")
    out = spark.sql(text, **args)
    out = out.repartition(parts) if name in SPREAD and dealt else out
    return by_keys(out) if keyed else out


def duckdb_sql(text: str) -> str:
    """Recipe text in the other dialect."""
    text = text.replace("{D}", "//").replace("{X}(", "unnest(generate_series(").replace("){Y}", "))")
    return _NAME.sub(lambda m: m.group(1), text)


def with_fixtures(sql: str) -> str:
    """Prefix the fixtures an oracle text names as `{fx_...}`."""
    ctes = [f"{name} as ({duckdb_sql(RECIPES[name])})" for name in needs(sql)]
    body = duckdb_sql(sql).strip()
    lead = ""
    match = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if match:
        lead, body = ("recursive " if match.group(1) else ""), body[match.end():]
        return f"with {lead}{', '.join(ctes + [''])}{body}" if ctes else f"with {lead}{body}"
    return f"with {', '.join(ctes)} {body}" if ctes else body


# -- Shapes the operators take ------------------------------------------------

def tag_map(df: DataFrame) -> DataFrame:
    """fx_elements with its sparse columns folded into a `tags` map, absent keys left out."""
    keys = {"highway": "highway", "footway": "footway", "leisure": "leisure", "amenity": "amenity",
            "natural_": "natural", "man_made": "man_made", "area": "area", "crossing": "crossing",
            "building": "building"}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for c, k in keys.items()])
    return df.withColumn("tags", F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))).drop(*keys)


def rectangle(x0, y0, w, h):
    """Ring of a rectangle, vertices in order (x0,y0) (x1,y0) (x1,y1) (x0,y1)."""
    from tilescape.functions.rings import ring_of
    x0, y0, w, h = F.col(x0), F.col(y0), F.col(w), F.col(h)
    return ring_of((x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h))
