"""Small cases of the findings of round 3."""

from pyspark.sql import functions as F

from tilescape.functions import geo


def test_degrees_come_back_from_the_local_frame_far_from_its_origin(spark):
    # Halves of a millionth of a degree: the last bit decides how they are rounded.
    rows = spark.range(20000).select((F.col("id") * 48010 - 1225140005).alias("e7")).withColumn("lon", F.col("e7") / 1e7)
    back = geo.enu_lon(geo.enu_x("lon", -122.4, 37.8), -122.4, 37.8)
    south = rows.withColumn("lat", (F.col("e7") % 800000005) / 1e7)
    lat = geo.enu_lat(geo.enu_z("lat", 37.8), 37.8)
    assert rows.filter(back != F.col("lon")).count() == 0
    assert south.filter(lat != F.col("lat")).count() == 0


def test_selection_holds_elements_of_the_whole_world(spark, sf):
    from tilescape.plans import QUERIES
    from tilescape.plans.fixtures import fixture

    chosen = QUERIES["fl10_element_selection"](spark, sf).filter("use = 'building'")
    wanted = fixture(spark, sf, "fx_elements").filter("type <> 'node' and building is not null")
    east = wanted.filter("lon_e7 > -1224400000").select("id")
    assert east.count() > 0 and east.join(chosen, "id", "left_anti").count() == 0
    assert chosen.count() == wanted.count()


def test_corner_shades_send_one_row_per_rectangle(spark):
    from tilescape.operators import voxels

    # A floor of 3 x 3 with a column on one corner; negative neighbours and words of 64 are crossed along z.
    cells = [(7, x, 0, z, 1) for x in range(3) for z in range(62, 67)] + [(7, 2, 1, 66, 1)]
    v = spark.createDataFrame(cells, "tx bigint, ix bigint, iy bigint, iz bigint, tag int")
    rects = voxels.merge_rectangles(voxels.merge_runs(voxels.exposed_faces(v)))
    out = voxels.corner_shades(rects, v)
    taken = {c[1:4] for c in cells}
    for r in out.collect():
        du, dv = voxels.CORNERS[r.corner]
        cu, cv, at = (r.u1 if du else r.u0), (r.v1 if dv else r.v0), r.slab + r.sign
        near = [(cu + su * (2 * du - 1), cv + sv * (2 * dv - 1)) for su, sv in ((1, 0), (0, 1), (1, 1))]
        place = {"x": lambda a, b: (at, a, b), "y": lambda a, b: (a, at, b), "z": lambda a, b: (a, b, at)}[r.axis]
        assert r.shade == 3 - sum(place(a, b) in taken for a, b in near)
    assert out.count() == 4 * rects.count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan[:plan.index("Join")].count("Aggregate") == 0  # rectangles are not gathered again after the look-up


def test_dense_short_roads_meet_few_pieces(spark, monkeypatch):
    from tilescape.operators import lines, nearest

    path = lambda k: [((k % 60) / 6000 + d / 1e5, k // 60 / 6000 + d / 1e5) for d in (0, 1)]
    roads = spark.createDataFrame([(k, path(k)) for k in range(3600)], "road_id bigint, path array<struct<lon: double, lat: double>>")
    nodes = spark.createDataFrame([(k, (k % 20) / 2000 + 1e-5, k // 20 / 2000) for k in range(400)], "id bigint, lon double, lat double")
    pairs, real = [], nearest.candidate_pairs
    monkeypatch.setattr(nearest, "candidate_pairs", lambda *a, **k: pairs.append(real(*a, **k)) or pairs[-1])
    out = lines.nearest_road_bearing(nodes, roads, "id", "road_id")
    assert out.count() == 400 and pairs[0].count() < 400 * 300


def test_exploded_sides_are_never_broadcast(spark, sf):
    from tilescape.plans import QUERIES

    for name in ("ag17_contrast_stretch", "jn3_points_in_footprints", "jn6_bilinear_sample", "jn7_nearest_sample", "jn10_candidate_pairs", "wn5_gaussian"):
        assert "BroadcastExchange" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name


def test_probes_meet_one_strip_each(spark):
    from tilescape.operators import raster

    # 20 x 20 pixels with holes: whole rows, strip ends and single pixels are absent.
    kept = {(x, y): x * 7 + y * 31 + x * y for x in range(20) for y in range(20) if y not in (4, 11) and (x, y) not in ((7, 2), (8, 2), (8, 3), (16, 9)) and not (x > 11 and y > 15)}
    pixels = spark.createDataFrame([(0, 0, x, y, v) for (x, y), v in kept.items()], "tx bigint, ty bigint, px bigint, py bigint, value bigint")
    places = [(k, (k * 37 % 400) / 400 + 0.0011, (k * 91 % 397) / 397 + 0.0007) for k in range(800)] + [(900, 1.5, 0.5)] * 2
    out = raster.sample_bilinear(spark.createDataFrame(places, "p bigint, fx double, fy double"), pixels, "fx", "fy", 20, keep=["p"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join")]  # probes are not gathered again after the look-up
    want = []
    for p, fx, fy in places:
        ax, ay = (fx - int(fx)) * 20 - 0.5, (fy - int(fy)) * 20 - 0.5
        x0, y0 = (int(max(0, min(18, a // 1))) for a in (ax, ay))
        wx, wy = (max(0, min(1, a - a0)) for a, a0 in ((ax, x0), (ay, y0)))
        met = [(kept.get((x0 + dx, y0 + dy)) if fx < 1 else None, (wx if dx else 1 - wx) * (wy if dy else 1 - wy)) for dy in (0, 1) for dx in (0, 1)]
        want.append((p, round(sum(v * w for v, w in met if v is not None), 6), any(v is not None for v, _ in met)))
    assert sorted((r.p, round(r.elev, 6), r.elev_covered) for r in out.collect()) == sorted(want)


def test_footprints_are_dealt_out(spark, sf):
    from tilescape.plans import QUERIES
    from tilescape.plans.fixtures import fixture

    plan = fixture(spark, sf, "fx_footprints")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan  # a small file of many rings is one task's otherwise
    assert "BroadcastExchange" not in QUERIES["jn16_building_mask"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_smoothed_without_a_join(spark):
    from tilescape.operators import raster

    cells = [(t, x, y, float((x * 31 + y * 17 + t) % 23)) for t in (1, 2) for x in range(9) for y in range(7) if (x * y + t) % 4] + [(3, 2, 2, None)]
    df = spark.createDataFrame(cells, "tx bigint, cx bigint, cy bigint, dem double")
    out = raster.smooth_tiles(df, 9, 7)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = raster.smooth_grid(raster.fill_nearest(raster.dense_grid(df, 9, 7), 9).select("tx", "cx", "cy", "dem"), 9, 7)
    assert sorted(map(tuple, out.filter("tx < 3").collect())) == sorted(map(tuple, want.filter("tx < 3").collect()))
    assert out.filter("tx = 3 and dem is null").count() == 63
