"""Column functions on known values."""

import math

import pytest
from pyspark.sql import functions as F

from tilescape.functions import classify, colours, fixedpoint, geo, rings, scatter, sqlfuncs
from tilescape.operators import lines


def one(spark, **columns):
    """Evaluate columns on a single row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]


L = lambda v: F.lit(float(v))


def test_tile_round_trip(spark):
    r = one(spark, x=geo.tile_x(L(-122.3937), 14), y=geo.tile_y(L(37.7955), 14), lon=geo.tile_lon(geo.tile_frac_x(L(-122.3937), 14), 14),
            lat=geo.tile_lat(geo.tile_frac_y(L(37.7955), 14), 14), far=geo.tile_x(L(180), 14), top=geo.tile_y(L(89.9), 14))
    y = int((1 - math.asinh(math.tan(math.radians(37.7955))) / math.pi) / 2 * 2 ** 14)
    assert (r.x, r.y) == (int((180 - 122.3937) / 360 * 2 ** 14), y) and r.far == 2 ** 14 - 1 and r.top == 0
    assert r.lon == pytest.approx(-122.3937, abs=1e-9) and r.lat == pytest.approx(37.7955, abs=1e-9)


def test_local_frame_round_trip(spark):
    x, z = geo.enu_x(L(-122.41), -122.4, 37.8), geo.enu_z(L(37.79), 37.8)
    r = one(spark, x=x, z=z, lon=geo.enu_lon(x, -122.4, 37.8), lat=geo.enu_lat(z, 37.8))
    assert r.x < 0 < r.z and r.lon == pytest.approx(-122.41, abs=1e-9) and r.lat == pytest.approx(37.79, abs=1e-9)


@pytest.mark.parametrize("rgb,metres", [((128, 0, 0), 0.0), ((128, 100, 0), 100.0), ((127, 255, 0), -1.0), ((128, 0, 128), 0.5)])
def test_terrarium_values(spark, rgb, metres):
    r = one(spark, v=fixedpoint.terrarium_decode(*[F.lit(c) for c in rgb]), e=fixedpoint.terrarium_encode(L(metres)))
    assert r.v == metres and tuple(r.e) == rgb


@pytest.mark.parametrize("props,want", [
    ({"render_height": "12", "render_min_height": "3"}, (12.0, 3.0)), ({}, (5.0, 0.0)), ({"hide_3d": "1"}, None), ({"render_height": "abc"}, (5.0, 0.0)),
    ({"render_height": "900"}, (500.0, 0.0)), ({"render_height": "10", "render_min_height": "10"}, None), ({"render_height": "10", "render_min_height": "9.8"}, (10.0, 9.5)),
    ({"render_height": "0.2"}, (1.0, 0.0)), ({"render_height": " 7.5m"}, (7.5, 0.0)), ({"hide_3d": "0", "render_height": "4"}, (4.0, 0.0))])
def test_building_heights(spark, props, want):
    row = spark.createDataFrame([(props,)], "p map<string,string>").select(classify.building_heights("p").alias("h")).collect()[0].h
    assert (tuple(row) if row else None) == want


@pytest.mark.parametrize("h,area,want", [(401, 1e4, 5.0), (160, 99, 5.0), (160, 100, 160.0), (60, 25001, 20.0), (50, 30000, 50.0)])
def test_sane_height(spark, h, area, want):
    assert one(spark, v=classify.sane_height(L(h), L(area))).v == want


@pytest.mark.parametrize("props,want", [
    (dict(housenumber="660", street="King St", city="San Francisco"), "660 King St, San Francisco"), (dict(street="Broadway", city="Oakland"), "Broadway, Oakland"),
    (dict(name="Twin Peaks", county="San Francisco"), "Twin Peaks, San Francisco"), (dict(name="Oakland", city="Oakland"), "Oakland"), ({}, "(unnamed place)"),
    (dict(state="California"), "California"), (dict(housenumber="5", name="Pier", district="Embarcadero"), "Pier, Embarcadero"), (dict(street="", name="X"), "X")])
def test_place_label(spark, props, want):
    keys = ("housenumber", "street", "name", "city", "district", "locality", "county", "state")
    row = one(spark, v=classify.place_label(*[F.lit(props.get(k)).cast("string") for k in keys]))
    assert row.v == want


@pytest.mark.parametrize("deg,label", [(0, "N"), (22.4, "N"), (22.5, "NE"), (90, "E"), (-90, "W"), (359, "N"), (540, "S")])
def test_compass_label(spark, deg, label):
    assert one(spark, v=classify.compass_label(L(deg))).v == label


def test_angles_take_the_short_way(spark):
    r = one(spark, v=classify.blend_angle(L(3.0), L(-3.0), L(0.5)), w=classify.wrap_angle(L(4.0)))
    assert r.v == pytest.approx(math.pi, abs=1e-9) and r.w == pytest.approx(4.0 - 2 * math.pi)


def test_ring_area_sign_and_winding(spark):
    ring = rings.ring_of((L(0), L(0)), (L(2), L(0)), (L(2), L(3)), (L(0), L(3)))
    r = one(spark, s=rings.signed_area(ring), a=rings.ring_area(ring), o=rings.signed_area(rings.wind_outer(ring)), h=rings.signed_area(rings.wind_hole(ring)))
    assert (r.s, r.a, r.o, r.h) == (-6.0, 6.0, 6.0, -6.0)


def test_polygon_with_hole(spark):
    outer = rings.ring_of((L(0), L(0)), (L(10), L(0)), (L(10), L(10)), (L(0), L(10)))
    hole = rings.ring_of((L(4), L(4)), (L(4), L(6)), (L(6), L(6)), (L(6), L(4)))
    at = lambda x, y: rings.point_in_polygon(L(x), L(y), outer, F.array(hole))
    r = one(spark, a=at(2, 2), b=at(5, 5), c=at(12, 5), near=rings.point_near_ring(L(10.4), L(5), outer, 0.5), far=rings.point_near_ring(L(10.4), L(10.4), outer, 0.5))
    assert (r.a, r.b, r.c, r.near, r.far) == (True, False, False, True, False)


def test_subdivision(spark):
    path = rings.ring_of((L(0), L(0)), (L(100), L(0)), (L(100), L(10)))
    got = one(spark, p=lines.subdivide(path, 30.0)).p
    assert [(round(p.x, 6), p.y) for p in got] == [(0, 0), (25, 0), (50, 0), (75, 0), (100, 0), (100, 10)]


@pytest.mark.parametrize("points,want", [
    ([(10, 10), (90, 10)], [[(10, 10), (90, 10)]]), ([(-10, 50), (50, 50)], [[(0, 50), (50, 50)]]), ([(-10, -10), (-5, -5)], []),
    ([(50, 50), (150, 50), (150, 60), (50, 60)], [[(50, 50), (100, 50)], [(100, 60), (50, 60)]]), ([(-50, 50), (150, 50)], [[(0, 50), (100, 50)]]), ([(5, 5)], [])])
def test_box_clip(spark, points, want):
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in points],)], "p array<struct<x: double, y: double>>")
    got = df.select(lines.clip_to_box("p", 100.0).alias("c")).collect()[0].c
    assert [[(p.x, p.y) for p in piece] for piece in got] == want


def test_hash_and_seed_steps(spark):
    def ref(*args):
        h = 0x811C9DC5
        for a in args:
            for part in (a, a * 1000):
                h = ((h ^ (part & 0xFFFFFFFF)) * 0x01000193) & 0xFFFFFFFF
        return h
    step = lambda s: (s * 0x27D4EB2D + 0x9E3779B9) & 0xFFFFFFFF
    r = one(spark, h=colours.hash32(F.lit(2621), F.lit(-6332), F.lit(14)), s=scatter.seed_sequence(F.lit(4294967295), 2))
    assert r.h == ref(2621, -6332, 14)
    assert r.s == [step(4294967295), step(step(4294967295))]


@pytest.mark.parametrize("dist,tier,want", [(10, 1, 7.5), (1000, 2, 42.0), (1e5, 3, 136.5), (100, 9, 5.0)])
def test_pin_label_height(spark, dist, tier, want):
    assert one(spark, v=classify.pin_label_height(L(dist), F.lit(tier))).v == pytest.approx(want)


def test_sql_functions_agree(spark):
    names = sqlfuncs.register(spark)
    assert "tile_x" in names
    got = spark.sql("select tile_x(-122.3937D, 14) x, tile_y(37.7955D, 14) y, to_e7(-122.39D) e, terrarium_decode(128, 0, 0) t, sane_height(160D, 99D) h").collect()[0]
    assert tuple(got) == (2621, 6331, -1223900000, 0.0, 5.0)
