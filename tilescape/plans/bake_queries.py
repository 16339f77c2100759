"""Whole bakes as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import geo
from tilescape.operators import bakes, footprints, trees

from .fixtures import fixture
from .raster_queries import BAD, COMPONENTS, CROWNS, FOCAL, N, RULES
from .registry import query
from .solid_queries import MASK, rings_cm

ROW = 6331  # every tile lies in this row of zoom 14


@query("bake_tree_documents", f"""
    with recursive {COMPONENTS}, v as (select h.* from h left join (select k.tx, k.cx, k.cy from k join st using (tx, comp) where {BAD}) x
         on h.tx = x.tx and h.cx = x.cx and h.cy = x.cy where x.tx is null), {FOCAL.replace('{src}', 'v')}, {MASK},
    s as (select f.tx, f.cx, f.cy, f.chm from f left join mask m on m.tx = f.tx and m.cx = f.cx and m.cy = f.cy where m.tx is null and chm = local_max and chm > 0
          and chm between 300 and 3500 and near_min >= chm * 0.1e0 and near_max - near_min >= 150), {CROWNS.replace('{stems}', 's').replace('{src}', 'v')},
    gate as (select tx from {{fx_points}} where cls not in (7, 18) group by 1 having count(*) >= 2500),
    t as (select tx, cast(round_even(((tx + (cx + 0.5e0) / 64) / 16384 * 360 - 180) * 1e7, 0) as bigint) as a,
                 cast(round_even(degrees(atan(sinh(pi() * (1 - 2 * ({ROW} + (cy + 0.5e0) / 64) / 16384)))) * 1e7, 0) as bigint) as b,
                 cast(round_even(chm / 100e0 * 10, 0) as bigint) as c, cast(round_even(crown_r * 10, 0) as bigint) as d from crown semi join gate using (tx)),
    j as (select tx, '{{"trees":[' || string_agg('[' || a || ',' || b || ',' || c || ',' || d || ']', ',' order by a, b, c, d) || ']}}' as json, count(*) as n from t group by 1)
    select tx, {ROW} as ty, coalesce(json, '{{"trees":[]}}') as json, cast(coalesce(n, 0) as int) as n from (select distinct tx from {{fx_points}}) w left join j using (tx)""".replace('{{"trees"', '{"trees"').replace("]}}'", "]}'"))
def bake_trees(spark, sf):
    points = fixture(spark, sf, "fx_points").withColumn("ty", F.lit(ROW).cast("bigint"))
    inside = footprints.cells_in_rings(rings_cm(spark, sf), ["tx"], N, N, 100)
    mask = trees.building_mask(inside, 2, N, N).withColumn("ty", F.lit(ROW).cast("bigint"))
    place = lambda: (geo.tile_lon(F.col("tx") + (F.col("cx") + 0.5) / N, 14), geo.tile_lat(F.col("ty") + (F.col("cy") + 0.5) / N, 14))
    docs = bakes.bake_tree_documents(points, points.select("tx", "ty").distinct(), N, N, 100, place, mask=mask, minimum=2500, rules=RULES, metre=100.0,
                                     x="x_cm", y="y_cm", z="z_cm")
    return docs.select("tx", "ty", "json", "n")
